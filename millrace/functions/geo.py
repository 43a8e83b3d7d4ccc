"""Free-text locations to ISO country codes, by country names, codes and a dictionary of cities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dialect import any_in_lowered
from millrace.functions.text import is_blank, trim_control

#: Country names and their codes.
COUNTRY_NAMES = {
    "germany": "DE", "deutschland": "DE", "netherlands": "NL", "nederland": "NL", "the netherlands": "NL", "austria": "AT", "österreich": "AT", "oesterreich": "AT", "switzerland": "CH", "schweiz": "CH", "suisse": "CH",
    "ireland": "IE", "éire": "IE", "sweden": "SE", "sverige": "SE", "denmark": "DK", "danmark": "DK", "finland": "FI", "suomi": "FI", "spain": "ES", "españa": "ES", "espana": "ES", "united kingdom": "GB", "england": "GB",
    "united states": "US", "usa": "US", "u.s.a.": "US", "india": "IN", "china": "CN", "canada": "CA", "australia": "AU", "singapore": "SG", "japan": "JP", "france": "FR", "italy": "IT", "poland": "PL", "portugal": "PT",
    "romania": "RO", "czechia": "CZ", "czech republic": "CZ", "hungary": "HU", "belgium": "BE", "norway": "NO", "brasil": "BR", "brazil": "BR", "mexico": "MX", "argentina": "AR", "ukraine": "UA", "israel": "IL", "turkey": "TR", "türkiye": "TR",
}
CODES = ("NL", "DE", "AT", "CH", "IE", "SE", "DK", "FI", "ES", "GB", "US", "IN", "CN", "CA", "AU", "SG", "JP", "FR", "IT", "PL", "PT", "RO", "CZ", "HU", "BE", "NO", "BR", "MX", "UA", "IL", "TR")
PRIORITY = ("GB", "FR", "DE", "NL", "IT", "ES", "AT", "CH", "BE", "SE", "NO", "DK", "FI", "IE", "PL", "PT", "CZ", "HU", "RO", "UA", "US", "CA", "AU", "IN", "CN", "JP", "SG", "BR", "MX")
TARGETS, EXEMPT = ("DE", "NL", "AT", "CH", "IE", "SE", "DK", "FI", "ES"), "DE"
#: A small dictionary; a caller may pass a larger one.
CITIES = {
    "berlin": ("DE",), "munich": ("DE",), "münchen": ("DE",), "hamburg": ("DE",), "frankfurt": ("DE",), "cologne": ("DE",), "amsterdam": ("NL",), "rotterdam": ("NL",), "veghel": ("NL",), "utrecht": ("NL",), "vienna": ("AT",), "wien": ("AT",),
    "zürich": ("CH",), "zurich": ("CH",), "dublin": ("IE", "US"), "stockholm": ("SE",), "copenhagen": ("DK",), "helsinki": ("FI",), "madrid": ("ES",), "barcelona": ("ES",), "valencia": ("ES", "US"), "london": ("GB", "CA"), "york": ("GB",),
    "paris": ("FR", "US"), "rome": ("IT",), "warsaw": ("PL",), "kraków": ("PL",), "lisbon": ("PT",), "prague": ("CZ",), "toronto": ("CA",), "essen": ("DE", "NL"),
}


def best_of(codes: tuple[str, ...]) -> str:
    """One target country if there is one, the first that isn't exempt of several, else the most prominent."""
    wanted = [c for c in codes if c in TARGETS]
    if wanted:
        return next((c for c in wanted if len(wanted) == 1 or c != EXEMPT), wanted[0])
    return next((c for c in PRIORITY if c in codes), codes[0])


def _code(c: Column) -> Column:
    upper = F.upper(c)
    return F.when(upper == "UK", "GB").when(upper.isin(*CODES), upper)


def best_code(codes: Column) -> Column:
    """best_of as an expression over an array of codes."""
    wanted = F.filter(codes, lambda c: c.isin(*TARGETS))
    first = F.try_element_at(F.filter(wanted, lambda c: c != EXEMPT), F.lit(1))
    prominent = F.try_element_at(F.filter(F.array(*map(F.lit, PRIORITY)), lambda p: F.array_contains(codes, p)), F.lit(1))
    return F.when(F.size(wanted) > 0, F.coalesce(first, wanted[0])).otherwise(F.coalesce(prominent, codes[0]))


def explicit(location: Column, home: tuple[str, ...] = ()) -> Column:
    """The country that a location names itself: by a profile's own patterns of the home country, by its name (the longest),
    by a bare code, by an upper-case code among the words."""
    low, trimmed = F.lower(location), trim_control(location)
    by_length = sorted(COUNTRY_NAMES, key=lambda n: (-len(n), n))
    # each name is looked for as a text first; a pattern over all of them would try them at every character

    def longest(text: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for n in by_length:
            out = out.when(text.contains(n) & any_in_lowered(text, [rf"\b{n.replace('.', chr(92) + '.')}\b"]), COUNTRY_NAMES[n])
        return out

    names = F.transform(F.array(low), longest)[0]  # so that the text is lower-cased once
    bare = F.when(F.length(trimmed) == 2, _code(trimmed))
    words = F.filter(F.split(location, r"[,\s]+"), lambda w: w.rlike("^[A-Z]{2}$") & _code(w).isNotNull())
    found = F.coalesce(names, bare, F.try_element_at(F.transform(words, _code), F.lit(1)))
    return F.when(any_in_lowered(low, home), EXEMPT).otherwise(found) if home else found


def city_candidates(location: Column) -> Column:
    """What may be a city in a location, in the order of trial: each segment whole, in parts between dashes, by its leading
    word; lower-cased."""
    lead = lambda s: F.when(s.rlike(r"^\S{3,}\s"), F.regexp_extract(s, r"^(\S+)", 1))
    tried = lambda s: F.concat(F.array(s), F.when(s.contains("-"), F.filter(F.split(s, r"\s*-\s*"), lambda p: F.length(p) >= 3)).otherwise(F.array().cast("array<string>")), F.array(lead(s)))
    segments = F.transform(F.split(F.lower(location), r"[,\n]"), lambda s: F.trim(s))
    return F.filter(F.flatten(F.transform(segments, tried)), lambda c: c.isNotNull() & (c != ""))


def resolve(location: Column, cities: dict[str, tuple[str, ...]] | None = None, home: tuple[str, ...] = ()) -> Column:
    """The country a location names itself, else that of the first city found in a small dictionary, which is a literal map.
    operators.places has the same over a table of cities."""
    index = F.create_map(*[F.lit(x) for city, codes in (cities or CITIES).items() for x in (city, best_of(codes))])
    found = F.filter(F.transform(city_candidates(location), lambda c: F.try_element_at(index, c)), lambda x: x.isNotNull())
    return F.when(is_blank(location), None).otherwise(F.coalesce(explicit(location, home), F.try_element_at(found, F.lit(1))))


def is_target(iso: Column) -> Column:
    return F.coalesce(iso.isin(*TARGETS), F.lit(False))
