"""Listings as text whose lines belong to the title above them: a block runs from one title line to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import blank_to_null, iso_date, relative_date, trim_control

LISTING = "job_ids array<string>, references struct<search_results: array<struct<kind: string, text: string, url: string, listed_at: string>>>, sections struct<search_results: string>"
#: Lines that annotate a posting, places of work, and lines that are no company.
_ANNOTATIONS, _ANNOTATION_STARTS, _ANNOTATION_END = ("promoted", "viewed", "apply"), ("actively reviewing", "set alert", "jump to"), "alumni work here"
WORK_PLACES = ("(Hybrid)", "(Remote)", "(On-site)", "(On-Site)", "(Onsite)")
_VERIFIED = "with verification"
_AGO = r"\d+\s+(?:second|minute|hour|day|week|month|year)s?\s+ago"


def is_annotation(line: Column) -> Column:
    low = F.lower(line)
    starts = [low.startswith(s) for s in _ANNOTATION_STARTS]
    return low.isin(*_ANNOTATIONS) | starts[0] | starts[1] | starts[2] | low.endswith(_ANNOTATION_END)


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, _n (from 0) and _line, trimmed, of each text."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "_line")).withColumn("_line", trim_control(F.col("_line")))


def text_blocks(texts: DataFrame, titles: DataFrame, key: str, as_of: Column, text: str = "text") -> DataFrame:
    """key, title, company, location, posted_date and body of each block.

    A block begins with the first line of a text that is one of its titles (key, title) and ends before the next block's. The
    company stands in the line below the title and the place in the one below that, unless they are blank or annotate; the
    date is the first relative time in the block; body has the block's lines below the title. Lines above the first title
    belong to no block. The lines of a text are its own window, which spills where the text is long."""
    wanted = titles.where(F.trim("title") != "").select(key, F.col("title").alias("_line")).distinct().withColumn("_is_title", F.lit(True))
    marked = lines_of(texts, key, text).join(wanted, [key, "_line"], "left")
    first = F.row_number().over(W.partitionBy(key, "_line", "_is_title").orderBy("_n")) == 1
    begun = marked.withColumn("_begins", F.coalesce(F.col("_is_title") & first, F.lit(False)))
    begins = F.max(F.when(F.col("_begins"), F.col("_n"))).over(W.partitionBy(key).orderBy("_n").rowsBetween(W.unboundedPreceding, 0))
    below = begun.withColumn("_start", begins).where("_start IS NOT NULL").withColumn("_k", F.col("_n") - F.col("_start"))
    line_at = lambda k: F.max(F.when((F.col("_k") == k) & ~is_annotation(F.col("_line")), blank_to_null(F.col("_line"))))
    dated = F.when((F.col("_k") > 0) & F.col("_line").rlike(_AGO), F.struct("_k", "_line"))
    lines = F.array_sort(F.collect_list(F.when(F.col("_k") > 0, F.struct("_k", "_line"))))
    blocks = below.groupBy(key, "_start").agg(F.max(F.when(F.col("_k") == 0, F.col("_line"))).alias("title"), line_at(1).alias("company"), line_at(2).alias("location"), relative_date(F.min(dated)["_line"], as_of).alias("posted_date"), F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("body"))
    return blocks.drop("_start")


def structured_listing(payloads: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Postings of a structured reply: references to jobs (id in the address, else the address itself), with what the block
    of the same title in the reply's text says. Replies without job ids give none."""
    replies = payloads.select(key, F.from_json("payload", LISTING).alias("r")).where("size(r.job_ids) > 0")
    each = replies.select(key, F.posexplode("r.references.search_results").alias("position", "ref")).where("ref.kind = 'job'")
    number = F.nullif(F.regexp_extract("ref.url", r"/jobs/view/(\d+)", 1), F.lit(""))
    refs = each.select(key, "position", blank_to_null(F.col("ref.text")).alias("title"), F.coalesce(number, F.col("ref.url")).alias("external_id"), F.col("ref.url").alias("apply_url"), iso_date(F.col("ref.listed_at")).alias("_listed")).where("title IS NOT NULL")
    blocks = text_blocks(replies.select(key, F.col("r.sections.search_results").alias("text")), refs, key, as_of)
    out = refs.join(blocks, [key, "title"], "left")
    return out.select(key, "position", "external_id", "title", F.col("company").alias("company_name"), "location", "apply_url", F.coalesce("posted_date", "_listed").alias("posted_date"), F.col("body").alias("description"))


def placed_companies(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, n, company and title of texts in which the place of work follows the company: the company is the line above such
    a place, the title the nearest line above the company that isn't about verification. Lines that head or annotate a list
    are no companies."""
    order = W.partitionBy(key).orderBy("_n")
    company = F.lag("_line").over(order)
    title = F.last(F.when(~F.col("_line").endswith(_VERIFIED), F.col("_line")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -2))
    rows = lines_of(texts, key, text).withColumns({"company": company, "title": F.coalesce(title, F.lit(""))})
    place = F.lit(False)
    for words in WORK_PLACES:
        place = place | F.col("_line").contains(words)
    heads = F.col("company").contains("results") | F.col("company").startswith("Set alert") | F.col("company").startswith("Jump to") | F.col("company").endswith(_VERIFIED)
    return rows.where(place & (F.col("_n") >= 2) & (F.col("company") != "") & ~heads).select(key, F.col("_n").alias("n"), "company", "title")
