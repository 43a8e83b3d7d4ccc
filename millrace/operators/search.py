"""Which postings are shown, in which order, and as which rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.session import stored


def visible() -> Column:
    """Active, not applied to, not hidden, kept."""
    return F.col("is_active") & ~F.col("applied") & ~F.col("hidden") & (F.col("decision") == "KEEP")


def contains(columns: list[str], text: str) -> Column:
    """Any column holds the text, whatever the case."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return out


def search(jobs: DataFrame, text: str | None = None, company: str | None = None, location: str | None = None, least_score: int | None = None, aggregators: bool | None = None) -> DataFrame:
    """Visible jobs that pass every filter that is given."""
    out = jobs.where(visible())
    if text is not None:
        out = out.where(contains(["title", "company", "location"], text))
    if company is not None:
        out = out.where(F.col("company") == company)
    if location is not None:
        out = out.where(contains(["location"], location))
    if least_score is not None:
        out = out.where(F.col("match_score") >= least_score)
    if aggregators is not None:
        out = out.where(F.col("is_aggregator") == aggregators)
    return out


def page(df: DataFrame, order: list[Column], number: int = 0, size: int = 50) -> DataFrame:
    """One page of a total order."""
    return df.orderBy(*order).offset(number * size).limit(size)


def recently_posted(since: Column, today: Column) -> Column:
    """Posted since; or undated and discovered since on an own source, or today on an aggregator."""
    undated = F.col("posted_date").isNull()
    return (F.col("posted_date") >= since) | (undated & ~F.col("is_aggregator") & (F.col("discovered_date") >= since)) | (undated & F.col("is_aggregator") & (F.col("discovered_date") == today))


def short_description(least: int) -> Column:
    return F.col("description").isNull() | (F.length("description") < least)


def due_for_crawl(cutoff: Column) -> Column:
    return (F.col("ats_type") != "CUSTOM") & (F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < cutoff))


def by_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the keys, each once however often the key is asked for."""
    return df.join(keys.select(key), key, "left_semi")


def ranked_by_name(df: DataFrame, name: str, key: str) -> DataFrame:
    """Adds place (from 1) in the order of the lower-cased names, then of the names, then of the key; nulls last. Rows are sorted
    by ranges, which are stored so that both uses see the same ones, and a place is the rows in the ranges before and the place in
    its own; no task sees all rows."""
    order = [F.asc_nulls_last("_low"), F.asc_nulls_last(name), F.asc(key)]
    dealt = stored(df.sparkSession, df.withColumn("_low", F.lower(name)).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))  # a row for each range
    return own.join(F.broadcast(before.select("_range", "_before")), "_range").withColumn("place", F.col("_own") + F.col("_before")).drop("_low", "_range", "_own", "_before")


def by_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """The first row in order whose key, as text, begins so."""
    return df.where(F.col(key).cast("string").startswith(prefix)).orderBy(key).limit(1)


def top_skills(skills: DataFrame, n: int = 5) -> DataFrame:
    """job_id and the names of its first n required skills, by name."""
    rank = F.row_number().over(W.partitionBy("job_id").orderBy("skill_name"))
    first = skills.where("is_required").withColumn("_rank", rank).where(F.col("_rank") <= n)
    return first.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list("skill_name")), ",").alias("top_skills"))


def skills_by_category(skills: DataFrame, categories: list[str]) -> DataFrame:
    """One column of names for each category."""
    pivot = skills.groupBy("job_id").pivot("category", categories).agg(F.array_join(F.sort_array(F.collect_set("skill_name")), ","))
    return pivot.select("job_id", *[F.coalesce(c, F.lit("")).alias(c.lower()) for c in categories])
