"""Queries of the sources: payloads are written from the postings, a thousand in each, and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.bindings import JOBS, jobs
from millrace.sources import documents, json_feeds

EACH = 1000
#: A payload of whole texts ends where its texts reach so many bytes; a variant holds 16 MB, and JSON may escape a byte as six.
PAYLOAD_BYTES = 2_000_000


def _whole_payloads(rows: DataFrame, item: Column, array: str | None, most: int = PAYLOAD_BYTES) -> DataFrame:
    """JSON payloads of whole titles and descriptions."""
    grouped = _grouped(rows, item, most)
    return grouped.select((F.to_json("items") if array is None else F.to_json(F.struct(F.col("items").alias(array)))).alias("payload"))


def _grouped(rows: DataFrame, item: Column, most: int = PAYLOAD_BYTES) -> DataFrame:
    """Items, cut by bytes of title and description within every EACH ids: most, and one text more."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("title", "description")]
    before = W.partitionBy("_each").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    sized = rows.withColumn("_each", F.floor(F.col("id") / EACH)).withColumn("_part", F.floor(F.sum(texts[0] + texts[1]).over(before) / most))
    return sized.groupBy("_each", "_part").agg(F.collect_list(item).alias("items"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).withColumns({"title": F.concat(F.lit("T "), F.col("title")), "stamp": F.unix_timestamp(F.col("discovered_date").cast("timestamp")), "day": F.col("discovered_date").cast("string")})


def _greenhouse(text: Column) -> Column:
    return F.struct("id", "title", F.struct(F.col("location").alias("name")).alias("location"), F.concat(F.lit("<p>"), text, F.lit("</p>")).alias("content"), F.concat(F.lit("https://x/"), F.col("id")).alias("absolute_url"), F.concat(F.col("day"), F.lit("T23:30:00-05:00")).alias("updated_at"))


def _lever(text: Column) -> Column:
    return F.struct("id", F.col("title").alias("text"), F.struct("location").alias("categories"), text.alias("descriptionPlain"), F.concat(F.lit("https://x/"), F.col("id")).alias("hostedUrl"), (F.col("stamp") * 1000 + 5).alias("createdAt"))


def src10_greenhouse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole titles and descriptions through the payload, the parser and strip_html."""
    return _shown(json_feeds.parse(_whole_payloads(_rows(spark, sf_dir), _greenhouse(F.col("description")), "jobs"), "GREENHOUSE"))


def src11_lever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole titles and descriptions; the feed itself keeps 500 characters of a title."""
    return _shown(json_feeds.parse(_whole_payloads(_rows(spark, sf_dir), _lever(F.col("description")), None), "LEVER"))


def src32_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same postings, with whole titles, under two keywords; the first of each id stays."""
    return _builtin(_whole_payloads(_rows(spark, sf_dir), _builtin_item(), "results"))


def _builtin_item() -> Column:
    return F.struct("id", F.col("title").alias("title_raw"), F.col("company").alias("company_display_name"), F.col("location").alias("location_name"), F.concat(F.lit("https://x/"), F.col("id")).alias("posting_url"), F.array(F.lit("Go"), F.col("lang")).alias("skills"), F.col("stamp").alias("first_seen"))


def _builtin(payloads: DataFrame) -> DataFrame:
    asked = payloads.withColumn("keyword", F.explode(F.array(F.lit("a"), F.lit("b"))))
    parsed = json_feeds.first_of_each(json_feeds.parse(asked, "BUILTIN", "keyword"), ["keyword", "position"])
    return parsed.select("external_id", "title", "company_name", "location", "description", "apply_url", "posted_date")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("external_id", "title", "location", F.md5("description").alias("description"), "apply_url", "posted_date")


_BASE = f"WITH {JOBS}, r AS (SELECT id, 'T ' || title AS title, location, company, lang, description, discovered_date FROM jobs)"
_SHOWN = "CAST(id AS VARCHAR) AS external_id, title, location, md5({}) AS description, 'https://x/' || id AS apply_url, discovered_date AS posted_date"


#: Characters that XML 1.1 holds as numbers only, or would read as other line breaks.
_NUMBERED = r"[\x01-\x08\x0B-\x1F\x7F-\x9F\u2028]"


def _escaped(text: Column) -> Column:
    """Text as XML 1.1 holds it, control characters by their numbers; U+0000 goes, which no XML holds."""
    c = text
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\0", "")):
        c = F.replace(c, F.lit(char), F.lit(name))
    number = lambda x: F.when(x.rlike(_NUMBERED), F.concat(F.lit("&#"), F.ascii(x), F.lit(";"))).otherwise(x)
    return F.when(text.rlike(_NUMBERED), F.array_join(F.transform(F.split(c, ""), number), "")).otherwise(c)


def src23_rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents of many postings, with whole titles and whole descriptions, cut by bytes."""
    day = F.date_format("discovered_date", "EEE, dd MMM yyyy")
    item = F.concat(F.lit("<item><guid>g"), F.col("id").cast("string"), F.lit("</guid><title>T "), _escaped(F.col("title")), F.lit("</title><link>https://x/jobs/"), F.col("id").cast("string"), F.lit("</link><pubDate>"), day, F.lit(" 10:00:00 +0000</pubDate><remoteStatus>none</remoteStatus><tt:locations><tt:location><tt:city>C"), (F.col("id") % 7).cast("string"), F.lit("</tt:city><tt:country>Y</tt:country></tt:location><tt:location><tt:city>D</tt:city></tt:location></tt:locations><description>&lt;b&gt;d&lt;/b&gt; "), _escaped(F.col("description")), F.lit("</description></item>"))
    whole = F.concat(F.lit('<?xml version="1.1"?><rss xmlns:tt="t"><channel>'), F.array_join("items", ""), F.lit("</channel></rss>"))
    docs = _grouped(jobs(spark, sf_dir), item).select(whole.alias("payload"))
    return documents.rss(docs, trimmed=False).select("external_id", F.md5("title").alias("title"), "location", F.md5("description").alias("description"), "posted_date")


def src38_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text listing for each posting, in which the whole text stands before and after the posting's lines."""
    text = F.concat_ws("\n", F.lit("Results"), F.col("description"), F.concat(F.lit("Role "), F.col("id")), F.concat(F.lit("Firm "), F.col("id") % 5), F.lit("Berlin (Hybrid)"), F.lit("Promoted"), F.concat(F.col("id") % 9 + 1, F.lit(" days ago")), F.col("description"))
    return documents.listing_lines(jobs(spark, sf_dir).select("id", text.alias("payload")), "id").drop("n")


def src36_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and titles of pages without JSON-LD."""
    from millrace.session import table

    rows = documents.posting_page(table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", F.md5("title").alias("title"), "location")


#: The names that the queries of whole texts had beside cut ones.
src10_greenhouse_whole, src11_lever_whole, src32_builtin_whole = src10_greenhouse, src11_lever, src32_builtin
QUERIES = {f.__name__: f for f in (src10_greenhouse, src11_lever, src32_builtin, src23_rss, src38_lines, src36_pages)}
QUERIES |= {f"{f.__name__}_whole": f for f in (src10_greenhouse, src11_lever, src32_builtin)}

_HEADING = r"trim(regexp_replace(" + "replace(" * 7 + r"regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"
_H1, _PARAGRAPH = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)", "'<p>' || description || '</p>'"
SQL = {
    "src10_greenhouse": f"{_BASE} SELECT {_SHOWN.format(_HEADING.replace(_H1, _PARAGRAPH))} FROM r",
    "src11_lever": f"{_BASE.replace("'T ' || title", "left('T ' || title, 500)")} SELECT {_SHOWN.format("CASE WHEN regexp_matches(description, '[^\\x00-\\x20]') THEN description END")} FROM r",
    "src32_builtin": f"{_BASE} SELECT CAST(id AS VARCHAR) AS external_id, title, company AS company_name, location, 'Go, ' || lang AS description, 'https://x/' || id AS apply_url, discovered_date AS posted_date FROM r",
    "src23_rss": f"{_BASE} SELECT 'g' || id AS external_id, md5('T ' || substr(title, 3)) AS title, 'C' || id % 7 || ', Y; D' AS location, md5({_HEADING.replace(_H1, "'<b>d</b> ' || description")}) AS description, discovered_date AS posted_date FROM r",
    "src38_lines": f"{_BASE} SELECT id, 'Role ' || id AS title, 'Firm ' || id % 5 AS company_name, 'Berlin (Hybrid)' AS location, (id % 9 + 1) || ' days ago' AS posted FROM r",
    "src36_pages": f"SELECT page_id, md5({_HEADING}) AS title, CAST(NULL AS VARCHAR) AS location FROM pages",
}
SQL |= {f"{n}_whole": SQL[n] for n in ("src10_greenhouse", "src11_lever", "src32_builtin")}
