"""RSS, sitemaps, JSON-LD in pages, and plain-text listings to raw postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, iso_date, once, rfc1123_date, salary, strip_html, trim_control
from millrace.sources.json_feeds import at
from millrace.sources.page_parts import SCRIPT_END

RSS_SCHEMA = "channel struct<item: array<struct<guid: string, link: string, title: string, description: string, pubDate: string, remoteStatus: string, locations: struct<location: array<struct<name: string, city: string, country: string>>>>>>"


def rss(payloads: DataFrame, trimmed: bool = True) -> DataFrame:
    """Items of an RSS document with namespaced locations, joined by `; ` with the remote status. Titles are trimmed like the other
    fields, or left as they stand."""
    plain = F.regexp_replace("payload", r"(</?)[A-Za-z]+:", "$1")
    items = payloads.select(F.explode(F.from_xml(plain, RSS_SCHEMA, {"ignoreSurroundingSpaces": "false"})["channel"]["item"]).alias("i"))
    guid, link, status = (trim_control(F.col(f"i.{n}")) for n in ("guid", "link", "remoteStatus"))
    place = F.transform("i.locations.location", lambda x: F.concat_ws(", ", *[blank_to_null(trim_control(x[n])) for n in ("city", "country")]))
    remote = F.when(F.lower(status) != "none", status)
    by_link = F.nullif(F.regexp_extract(link, r"/jobs/(\d+)", 1), F.lit(""))
    title = trim_control(F.col("i.title")) if trimmed else F.col("i.title")
    rows = items.select(F.coalesce(blank_to_null(guid), by_link).alias("external_id"), title.alias("title"), blank_to_null(F.concat_ws("; ", place, F.array(remote))).alias("location"), strip_html(F.col("i.description")).alias("description"), link.alias("apply_url"), rfc1123_date(F.col("i.pubDate")).alias("posted_date"))
    return rows.where("external_id IS NOT NULL AND trim(title) <> ''")


def sitemap(payloads: DataFrame, wanted: str, known: DataFrame | None = None) -> DataFrame:
    """url and lastmod of a sitemap's entries whose URL matches a pattern and isn't known."""
    entries = F.from_xml("payload", "url array<struct<loc: string, lastmod: string>>")["url"]
    rows = payloads.select(F.explode(entries).alias("e")).select(F.trim("e.loc").alias("url"), iso_date(F.col("e.lastmod")).alias("lastmod")).where(F.col("url").rlike(wanted))
    return rows.join(known.select("url"), "url", "left_anti") if known is not None else rows


def sitemap_index(payloads: DataFrame) -> DataFrame:
    """The addresses of the sitemaps that an index names."""
    entries = F.from_xml("payload", "sitemap array<struct<loc: string>>")["sitemap"]
    return payloads.select(F.explode(entries).alias("e")).select(F.trim("e.loc").alias("url"))


def sitemap_postings(payloads: DataFrame, pages: DataFrame, wanted: str, known: DataFrame) -> DataFrame:
    """Postings of the fetched pages (url, html) that a sitemap names, that match the pattern and that aren't known."""
    return posting_page(sitemap(payloads, wanted, known).dropDuplicates(["url"]).join(pages.select("url", "html"), "url")).drop("html")


#: Fixed value: a range of whole euros.
EURO_RANGE = "(\\d{1,3},\\d{3})\\s*[-\u2013]\\s*(\\d{1,3},\\d{3})\\s*\u20ac"


def json_ld(html: Column) -> Column:
    """The first JSON-LD block of a page that is a job posting, as a variant."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>" + SCRIPT_END), 1)
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    return F.try_element_at(F.filter(parsed, lambda v: F.try_variant_get(v, "$.@type", "string").isin("JobPosting", "JobListing")), F.lit(1))


def posting_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """title, company_name, location, description, posted_date and a salary range of pages: JSON-LD first, then the heading and
    the last `at` of the page's title. Several places are joined by commas; the range is the first in euros on the page."""
    ld = F.col("_ld")
    heading = once(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), lambda h: strip_html(F.nullif(h, F.lit(""))))
    parts = F.split(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), " at ")
    company = once(parts, lambda p: F.when(F.size(p) > 1, blank_to_null(trim_control(F.element_at(p, -1)))))
    salary_of = lambda end: salary(F.nullif(F.regexp_extract("_range", EURO_RANGE, end), F.lit("")))
    cities = F.transform(F.try_variant_get(ld, "$.jobLocation", "array<variant>"), lambda v: blank_to_null(F.try_variant_get(v, "$.address.addressLocality", "string")))
    return pages.withColumns({"_ld": json_ld(F.col(html)), "_range": F.regexp_extract(html, EURO_RANGE, 0)}).withColumns({
        "title": F.coalesce(at("$.title")(ld), heading, trim_control(parts[0])),
        "company_name": F.coalesce(at("$.hiringOrganization.name")(ld), company),
        "location": F.coalesce(at("$.jobLocation.address.addressLocality")(ld), blank_to_null(F.array_join(F.filter(cities, lambda c: c.isNotNull()), ", "))),
        "description": strip_html(at("$.description")(ld)),
        "posted_date": iso_date(at("$.datePosted")(ld)),
        "salary_min": salary_of(1),
        "salary_max": salary_of(2),
    }).drop("_ld", "_range")


def listing_lines(payloads: DataFrame, key: str) -> DataFrame:
    """Postings in line-oriented text: a title, a company, and a place with a work type in brackets, on lines that follow
    one another; the date is the first `N units ago` in the next ten lines."""
    lines = payloads.select(key, F.posexplode(F.split("payload", "\n")).alias("n", "line")).withColumn("line", trim_control(F.col("line"))).where("line <> ''")
    order = W.partitionBy(key).orderBy("n")
    ago = F.when(F.col("line").rlike(r"(?i)\d+\s*(second|minute|hour|day|week|month|year)s?\s+ago"), F.col("line"))
    near = F.first(ago, ignorenulls=True).over(order.rowsBetween(1, 10))
    placed = F.col("line").rlike(r"\((Remote|Hybrid|On-site)\)$")
    rows = lines.withColumns({"title": F.lag("line", 2).over(order), "company_name": F.lag("line", 1).over(order), "posted": near})
    return rows.where(placed & F.col("title").isNotNull()).select(key, "n", "title", "company_name", F.col("line").alias("location"), "posted")


def piped(payloads: DataFrame) -> DataFrame:
    """Lines of company|title|url."""
    parts = F.split(F.col("line"), r"\|")
    rows = payloads.select(F.explode(F.split("payload", "\n")).alias("line")).where(F.size(parts) >= 3)
    return rows.select(trim_control(parts[0]).alias("company_name"), trim_control(parts[1]).alias("title"), trim_control(parts[2]).alias("apply_url"))


def csv_records(payload: Column) -> Column:
    """The records of quoted CSV text as an array: a line break parts records only outside of quotes, that is where an even
    number of quotes stands before it. Doubled quotes count twice. The mark of a break is one that the text can't have, as its
    own marks are escaped first."""
    pieces = F.split(F.replace(payload, F.lit("\x1e"), F.lit("\x1e.")), '"')
    outside = F.transform(pieces, lambda p, k: F.when(k % 2 == 0, F.regexp_replace(p, "\r?\n", "\x1e,")).otherwise(p))
    records = F.split(F.array_join(outside, '"'), "\x1e,")
    return F.transform(records, lambda r: F.replace(r, F.lit("\x1e."), F.lit("\x1e")))


def csv_lines(payloads: DataFrame, schema: str) -> DataFrame:
    """Rows of quoted CSV text without its header line. Fields in quotes may hold line breaks, and doubled quotes for quotes."""
    records = payloads.select(F.posexplode(csv_records(F.col("payload"))).alias("n", "record")).where("n > 0 AND trim(record) <> ''")
    return records.select(F.from_csv("record", schema, {"multiLine": "true", "escape": '"'}).alias("r")).select("r.*")


def zipped(payloads: DataFrame, patterns: dict[str, str], amounts: tuple[str, ...] = ()) -> DataFrame:
    """Postings that a page holds as parallel runs of values: the first group of each pattern, matched by position; what a
    shorter run lacks is null. Amounts become decimals; 0 is null."""
    runs = [F.regexp_extract_all("payload", F.lit(p), 1).alias(name) for name, p in patterns.items()]
    rows = payloads.select(*runs).select(F.explode(F.arrays_zip(*patterns)).alias("z")).select("z.*")
    return rows.withColumns({a: F.nullif(salary(F.col(a)), F.lit(0).cast("decimal(12,2)")) for a in amounts}) if amounts else rows


#: A row of a job table: link with a numeric id and title, then further cells; and a bare link.
_ROW, _LINK = r"(?is)<tr[^>]*>(.*?)</tr>", r"""(?is)(<a[^>]*href=["'][^"']*/job/[^"']*/\d+/?["'][^>]*>.*?</a>)"""


def job_table(payloads: DataFrame, key: str) -> DataFrame:
    """Postings of HTML listings: rows of tables if a page has any with a posting, else bare links; the first of each id.
    The place stands in the second cell, or in the link before its first hyphen."""
    href = lambda c: F.regexp_extract(c, r"""(?i)href=["']([^"']*/job/[^"']*/\d+/?)["']""", 1)
    rows = F.filter(F.regexp_extract_all("payload", F.lit(_ROW), 1), lambda r: href(r) != "")
    parts = F.when(F.size(rows) > 0, rows).otherwise(F.regexp_extract_all("payload", F.lit(_LINK), 1))
    each = payloads.select(key, F.posexplode(parts).alias("n", "part")).withColumn("apply_url", href(F.col("part")))
    cell = F.regexp_extract("part", r"(?is)<td[^>]*>.*?</td>\s*<td[^>]*>(.*?)</td>", 1)
    slug = F.regexp_extract("apply_url", r"/job/([^/-]*)-", 1)
    made = each.select(key, "n", F.regexp_extract("apply_url", r"/(\d+)/?$", 1).alias("external_id"), strip_html(F.regexp_extract("part", r"(?is)<a[^>]*>(.*?)</a>", 1)).alias("title"), F.coalesce(blank_to_null(strip_html(cell)), blank_to_null(slug)).alias("location"), "apply_url")
    rank = F.row_number().over(W.partitionBy(key, "external_id").orderBy("n"))
    return made.withColumn("_r", rank).where("_r = 1").drop("_r", "n")
