"""Fetched JSON payloads to raw postings: one description of fields for each feed, one way to read them all.

A feed is a DataFrame with a string column payload. Payloads that don't parse, and postings without the fields that a feed
demands, give no rows. Empty arrays are passed over where a feed has several. Lookups of what isn't there give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, epoch_date, iso_date, posted_ago, salary, string_hash, strip_html, tags_to_spaces, truncate
from millrace.functions.urls import absolute_url

#: What every source gives.
RAW_JOB = ("external_id", "title", "company_name", "location", "description", "apply_url", "posted_date", "salary_min", "salary_max", "salary_currency", "raw_json")
Pick = Callable[[Column], Column]


def at(path: str, kind: str = "string") -> Pick:
    return lambda v: F.try_variant_get(v, path, kind)


def plain(path: str) -> Pick:
    """A value that is a text itself, no object or array as text."""

    def pick(v: Column) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", found.cast("string"))

    return pick


def _filled(c: Column) -> Column:
    """blank_to_null of a value that is made once, however costly."""
    return F.transform(F.array(c), blank_to_null)[0]


def either(*picks: Pick) -> Pick:
    """The first value that isn't blank."""
    return lambda v: F.coalesce(*[_filled(p(v)) for p in picks])


def joined(sep: str, *picks: Pick) -> Pick:
    """The values that aren't blank, joined; null if there are none."""
    return lambda v: _filled(F.concat_ws(sep, *[_filled(p(v)) for p in picks]))


def through(f: Callable[[Column], Column], pick: Pick) -> Pick:
    return lambda v: f(pick(v))


def _range(end: int) -> Pick:
    """One end of a range in a summary such as `€60,000 – €80,000`."""
    pattern = r"([\d,]+)\D+([\d,]+)"
    return lambda v: salary(F.nullif(F.regexp_extract(F.try_variant_get(v, "$.compensation.compensationTierSummary", "string"), pattern, end), F.lit("")))


@dataclass(frozen=True)
class Feed:
    #: Paths of the array of postings; the first that is an array counts.
    arrays: tuple[str, ...]
    fields: dict[str, Pick] = field(default_factory=dict)
    demanded: tuple[str, ...] = ("external_id", "title")
    #: Where to apply, of the payload's column slug and the posting's id, for feeds that don't say.
    address: str = ""


_DATE = lambda path: through(iso_date, at(path))
_500 = lambda pick: through(lambda c: truncate(c, 500), pick)
FEEDS: dict[str, Feed] = {
    "GREENHOUSE": Feed(("$.jobs",), {"external_id": at("$.id"), "title": at("$.title"), "location": at("$.location.name"), "description": through(strip_html, at("$.content")), "apply_url": at("$.absolute_url"), "posted_date": _DATE("$.updated_at")}),
    "LEVER": Feed(("$",), {"external_id": at("$.id"), "title": _500(at("$.text")), "location": _500(at("$.categories.location")), "description": either(at("$.descriptionPlain"), through(strip_html, at("$.description"))), "apply_url": at("$.hostedUrl"), "posted_date": through(lambda c: epoch_date(c, "ms"), at("$.createdAt", "bigint"))}),
    "ASHBY": Feed(("$.jobs",), {"external_id": at("$.id"), "title": _500(at("$.title")), "location": _500(at("$.location")), "description": either(at("$.descriptionPlain"), through(strip_html, at("$.descriptionHtml"))), "apply_url": at("$.applyUrl"), "posted_date": _DATE("$.publishedDate"), "salary_currency": at("$.compensation.currency"), "salary_min": _range(1), "salary_max": _range(2)}),
    "PERSONIO": Feed(("$",), {"external_id": at("$.id"), "title": at("$.name"), "location": at("$.office"), "posted_date": _DATE("$.createdAt")}, address="https://{slug}.jobs.personio.de/job/{id}"),
    "PINPOINT": Feed(("$.data",), {"external_id": at("$.id"), "title": at("$.title"), "location": either(at("$.location.city"), at("$.location.name")), "description": joined(" ", *[through(strip_html, at(f"$.{k}")) for k in ("description", "key_responsibilities", "skills_knowledge_expertise")]), "apply_url": at("$.url"), "salary_min": through(salary, at("$.compensation_minimum")), "salary_max": through(salary, at("$.compensation_maximum")), "salary_currency": at("$.compensation_currency")}),
    "RECRUITEE": Feed(("$.offers",), {"external_id": at("$.id"), "title": at("$.title"), "location": joined(", ", at("$.city"), at("$.country")), "description": through(strip_html, at("$.description")), "apply_url": at("$.careers_url"), "posted_date": _DATE("$.published_at")}),
    "WORKABLE": Feed(("$.jobs",), {"external_id": at("$.shortcode"), "title": _500(at("$.title")), "location": joined(", ", at("$.city"), at("$.state"), at("$.country")), "description": through(tags_to_spaces, at("$.description")), "apply_url": at("$.url"), "posted_date": _DATE("$.created_at")}),
    "BREEZY": Feed(("$",), {"external_id": either(at("$.id"), at("$._id")), "title": at("$.name"), "location": lambda v: _city_country(either(at("$.location.city"), at("$.location.name"))(v), either(at("$.location.country.name"), plain("$.location.country"))(v)), "apply_url": at("$.url"), "posted_date": _DATE("$.published_date")}),
    "BAMBOOHR": Feed(("$.result",), {"external_id": at("$.id"), "title": at("$.jobOpeningName"), "location": joined(", ", at("$.location.city"), at("$.location.country"))}, address="https://{slug}.bamboohr.com/careers/{id}"),
    "JOIN": Feed(("$.items", "$"), {"external_id": at("$.id"), "title": at("$.title"), "location": joined(", ", at("$.city"), at("$.countryCode")), "apply_url": at("$.jobUrl"), "posted_date": _DATE("$.createdAt")}),
    "SMARTRECRUITERS": Feed(("$.content",), {"external_id": either(at("$.id"), at("$.uuid")), "title": _500(at("$.name")), "location": either(at("$.location.fullLocation"), joined(", ", at("$.location.city"), at("$.location.country"))), "description": joined("\n", *[through(tags_to_spaces, at(f"$.jobAd.sections.{k}.text")) for k in ("jobDescription", "qualifications", "additionalInformation")]), "posted_date": _DATE("$.releasedDate")}, address="https://jobs.smartrecruiters.com/{slug}/{id}"),
    "MEILISEARCH": Feed(("$.hits",), {"external_id": at("$.id"), "title": at("$.title"), "company_name": at("$.company"), "location": either(at('$["location.lvl1"]'), at('$["location.lvl0"]')), "apply_url": at("$.url"), "posted_date": through(epoch_date, at("$.published", "bigint"))}),
    "REST": Feed(("$.data", "$"), {"external_id": either(at("$.slug"), at("$.id")), "title": at("$.title"), "company_name": at("$.company_name"), "location": at("$.location"), "description": through(strip_html, at("$.description")), "apply_url": at("$.url"), "posted_date": through(epoch_date, at("$.created_at", "bigint"))}, ("title",)),
    "BUILTIN": Feed(("$.results",), {"external_id": at("$.id"), "title": at("$.title_raw"), "company_name": at("$.company_display_name"), "location": at("$.location_name"), "description": lambda v: blank_to_null(F.array_join(F.try_variant_get(v, "$.skills", "array<string>"), ", ")), "apply_url": at("$.posting_url"), "posted_date": through(epoch_date, at("$.first_seen", "bigint"))}),
    "CLI": Feed(("$",), {"external_id": lambda v: _link_id(v), "title": at("$.title"), "company_name": at("$.company"), "location": at("$.location"), "description": at("$.description"), "apply_url": lambda v: F.coalesce(at("$.job_url")(v), F.lit("")), "posted_date": _DATE("$.date_posted")}, ("title", "company_name")),
}
FEEDS["LEVER_EU"] = FEEDS["LEVER"]


def _city_country(city: Column, country: Column) -> Column:
    return F.when(city == country, city).otherwise(blank_to_null(F.concat_ws(", ", city, country)))


def _link_id(v: Column) -> Column:
    """The posting's id, else the key in its address, else the address's hash."""
    url = at("$.job_url")(v)
    return F.coalesce(blank_to_null(at("$.id")(v)), F.nullif(F.regexp_extract(url, r"[?&]jk=([A-Za-z0-9]+)", 1), F.lit("")), string_hash(F.coalesce(url, F.lit(""))))


#: Wrappers of postings in feeds of unknown shape, and names of their fields, each in order.
WRAPPERS = ("hits", "data", "jobs", "results", "items")
TITLES, CITIES = ("job_title", "title", "name", "position", "jobTitle"), ("city", "location", "office", "address", "country", "field_keyword_19", "field_keyword_05")
LINKS = ("slug", "url", "link", "applyUrl", "apply_url", "externalUrl", "id")


def unknown(base: Column) -> Feed:
    """Postings of a feed of unknown shape: the first wrapper that holds any, or the payload itself; fields by their usual
    names, below `_source` where there is one; links as seen from the base. The id is 16 digits of the link's SHA-256."""
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$._source", "variant"), v)
    first = lambda names: lambda v: F.coalesce(*[at(f"$.{n}")(inner(v)) for n in names])
    link = lambda v: absolute_url(base, first(LINKS)(v))
    arrays = tuple(p for w in WRAPPERS for p in (f"$.{w}", f"$.{w}.hits"))
    return Feed((*arrays, "$"), {"external_id": lambda v: F.left(F.sha2(link(v), 256), F.lit(16)), "title": first(TITLES), "location": first(CITIES), "apply_url": link}, ("title",))


def replied(as_of: Column) -> Feed:
    """Postings in a language model's reply (the JSON that json_slice finds there); ids are hashes of title, company and url."""
    text = lambda n: lambda v: F.coalesce(at(f"$.{n}")(v), F.lit(""))
    name = lambda v: string_hash(F.concat_ws("|", text("title")(v), text("company")(v), text("url")(v)))
    return Feed(("$",), {"external_id": name, "title": at("$.title"), "company_name": at("$.company"), "location": at("$.location"), "apply_url": at("$.url"), "posted_date": lambda v: as_of}, ("title",))


def workday(as_of: Column) -> Feed:
    """Workday's postings say how many days ago they were made."""
    bullets = lambda v: blank_to_null(F.array_join(F.try_variant_get(v, "$.bulletFields", "array<string>"), " | "))
    last = lambda v: F.nullif(F.regexp_extract(F.try_variant_get(v, "$.externalPath", "string"), r"([^/_]+)$", 1), F.lit(""))
    return Feed(("$.jobPostings",), {"external_id": either(at("$.bulletFields[0]"), last), "title": at("$.title"), "location": at("$.locationsText"), "description": bullets, "apply_url": at("$.externalPath"), "posted_date": through(lambda c: posted_ago(c, as_of), at("$.postedOn"))})


def parse(payloads: DataFrame, source: str | Feed, *kept: str) -> DataFrame:
    """The postings in payloads, with the kept columns of their payload and the posting's place there."""
    feed = source if isinstance(source, Feed) else FEEDS[source]
    whole = F.try_parse_json("payload")
    arrays = [F.try_variant_get(whole, p, "array<variant>") for p in feed.arrays]
    postings = F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays]) if len(arrays) > 1 else arrays[0]
    addressed = bool(feed.address) and "slug" in payloads.columns
    carried = [*kept, *(["slug"] if addressed and "slug" not in kept else [])]
    items = payloads.select(*carried, F.posexplode(postings).alias("position", "item"))
    nothing = {"posted_date": "date", "salary_min": "decimal(12,2)", "salary_max": "decimal(12,2)"}
    absent = lambda c: F.lit(None).cast(nothing.get(c, "string"))
    made = {c: (feed.fields[c](F.col("item")) if c in feed.fields else absent(c)).alias(c) for c in RAW_JOB[:-1]}
    if addressed:
        before, between, after = re.split(r"\{slug\}|\{id\}", feed.address)
        made["apply_url"] = F.concat(F.lit(before), F.col("slug"), F.lit(between), feed.fields["external_id"](F.col("item")), F.lit(after)).alias("apply_url")
    rows = items.select(*kept, "position", *made.values(), F.to_json("item").alias("raw_json"))
    for c in feed.demanded:
        rows = rows.where(F.trim(c) != "")
    return rows


def first_of_each(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first posting of each id, for feeds that are asked by several keywords."""
    from millrace.operators.postings import first_per_key

    return first_per_key(rows, ["external_id"], [F.col(c).asc() for c in order])
