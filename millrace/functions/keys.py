"""Countries, company names and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dialect import jvm
from millrace.functions.text import is_blank, trim_control

#: What a location must hold for each country, tried in this order.
COUNTRY_WORDS = {
    "de": ("germany", "deutschland", ", de ", ", de,", "(de)", "berlin", "munich", "münchen", "hamburg", "frankfurt", "cologne", "köln", "stuttgart", "düsseldorf", "dusseldorf", "nuremberg", "nürnberg", "leipzig", "dresden", "hannover", "bremen", "dortmund", "essen", "duisburg", "bochum", "wuppertal", "bielefeld", "bonn", "karlsruhe", "mannheim", "augsburg", "münster", "wiesbaden", "freiburg", "potsdam", "erfurt", "rostock", "mainz", "lübeck"),
    "nl": ("netherlands", "nederland", ", nl ", ", nl,", "(nl)", "amsterdam", "rotterdam", "the hague", "den haag", "eindhoven", "utrecht", "groningen", "tilburg", "almere", "breda", "nijmegen", "haarlem", "arnhem", "amersfoort", "apeldoorn", "s-hertogenbosch", "enschede", "leiden", "maastricht", "dordrecht", "zoetermeer", "zwolle", "deventer", "delft", "alkmaar", "north holland", "south holland", "noord-holland", "zuid-holland"),
    "se": ("sweden", "sverige", ", se ", ", se,", "(se)", "gothenburg", "göteborg", "stockholm", "malmö", "malmoe", "uppsala", "västerås", "örebro", "linköping", "helsingborg", "jönköping", "norrköping", "lund", "umeå"),
    "at": ("austria", "österreich", "wien", "vienna", "graz", "linz", "salzburg", "innsbruck", ", at ", ", at,", "(at)"),
    "ch": ("switzerland", "schweiz", "zürich", "zurich", "geneva", "genf", "basel", "bern", "lausanne", ", ch ", ", ch,", "(ch)"),
    "pl": ("poland", "polska", "warsaw", "warszawa", "krakow", "kraków", "wroclaw", "wrocław", "poznan", "poznań", "gdansk", "gdańsk", ", pl ", ", pl,"),
    "es": ("spain", "españa", "madrid", "barcelona", "valencia", "seville", "sevilla", ", es ", ", es,", "(es)"),
    "fr": ("france", "paris", "lyon", "marseille", "toulouse", "nice", ", fr ", ", fr,", "(fr)"),
    "gb": ("united kingdom", "england", "london", "manchester", "birmingham", "leeds", "glasgow", "edinburgh", ", gb ", ", gb,", "(gb)", "(uk)"),
}
#: First segments that are no cities, and legal forms and what may stand beside them in company names.
NOT_CITIES = ("remote", "germany", "netherlands", "sweden", "austria", "france", "spain")
LEGAL_WORDS = r"\b(gmbh|inc|ltd|ag|llc|bv|sa|sas|srl|ug|kg|co|corp|plc|se|nv|as)\b(\s*[&+]\s*\w+\.?)?"
LEGAL_SUFFIX = r"\s+(gmbh|se|ag|inc\.?|ltd\.?|corp\.?|llc|bv|nv|sa|sas|pty|limited|co\.?)\s*$"
COUNTRY_SUFFIX = r"\s+(deutschland|germany|europe|international|global)\s*$"
SERVICE_SUFFIX = r"\s*(gmbh|se|ag|inc\.?|ltd\.?|corp\.?|llc|co\.?|plc|sarl|srl|bv|nv)\s*$"


def country(location: Column) -> Column:
    """The country whose words the location holds first, or null."""
    low = F.lower(location)
    out = None
    for iso, words in COUNTRY_WORDS.items():
        found = low.rlike("|".join(re.sub(r"([().])", r"\\\1", w) for w in words))
        out = F.when(found, iso) if out is None else out.when(found, iso)
    return out


def city(location: Column) -> Column:
    """The first segment of a location, unless it is short or a country."""
    cleaned = F.trim(F.regexp_replace(location, r"(?i)\s*\(.*\)\s*$", ""))
    first = F.trim(F.split(cleaned, "[,>/]")[0])
    return F.when((F.length(first) > 2) & ~F.lower(first).isin(*NOT_CITIES), first)


def country_key(location: Column) -> Column:
    """country(), else `remote`, else the first segment's letters and digits."""
    first = F.lower(trim_control(F.split(location, "[,;]")[0]))
    fallback = F.when(first.rlike("^(remote|onsite|hybrid|anywhere|global|worldwide)$"), "remote").otherwise(F.regexp_replace(first, "[^a-z0-9]", ""))
    return F.when(is_blank(location), "").otherwise(F.coalesce(country(location), fallback))


def plain(c: Column) -> Column:
    """Lower-cased ASCII letters, digits and single spaces; null counts as empty."""
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def discovery_company(c: Column) -> Column:
    """Without the legal form, then a country, then a legal form at the end."""
    out = trim_control(c)
    for pattern in (LEGAL_SUFFIX, COUNTRY_SUFFIX, LEGAL_SUFFIX):
        out = F.regexp_replace(out, jvm(pattern), "")
    return F.when(is_blank(c), "").otherwise(F.trim(F.lower(F.regexp_replace(trim_control(out), r"\s+", " "))))


def service_company(c: Column) -> Column:
    """Without a legal form at the end, even one that ends a word."""
    return F.when(is_blank(c), "").otherwise(trim_control(F.lower(F.regexp_replace(c, jvm(SERVICE_SUFFIX), ""))))


def scraper_company(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


ingestion_company = plain


def fingerprint(title: Column, company: Column, location: Column) -> Column:
    """16 hex digits over title, company without legal words, and country."""
    bare = F.regexp_replace(F.coalesce(company, F.lit("")), jvm(LEGAL_WORDS), "")
    return F.left(F.sha2(F.concat_ws("|", plain(title), plain(bare), country_key(location)), 256), F.lit(16))
