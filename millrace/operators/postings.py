"""Duplicates, superseding and reconciliation of postings: new snapshots are computed, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def ingest_outcomes(batch: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Adds outcome to a batch (source, external_id): error for a blank id, duplicate for an id known before or met
    earlier in the batch, else created. The order columns tell the rows of an id apart. The first row of an id comes from
    a pre-aggregated minimum, so that an id may repeat any number of times."""
    blank = F.coalesce(F.trim("external_id") == "", F.lit(True))
    keys = ["source", "external_id"]
    ids = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    first = batch.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    joined = batch.join(first, keys, "left").join(ids, keys, "left")
    outcome = F.when(blank, "error").when(F.col("_known") | (F.struct(*order) != F.col("_first")), "duplicate").otherwise("created")
    return joined.withColumn("outcome", outcome).drop("_known", "_first")


def ingestion_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counts for each source."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return outcomes.groupBy("source").agg(count("created"), count("enriched"), count("duplicate"), count("error"))


def enrich_links(jobs: DataFrame) -> DataFrame:
    """Active own postings with links to the aggregator rows of the same fingerprint, on the newest own posting only."""
    own = jobs.where("NOT is_aggregator AND is_active")
    newest = first_per_key(own, ["fingerprint"], [F.desc("created_at"), F.desc("id")])
    others = jobs.where("is_aggregator").groupBy("fingerprint", "source").agg(F.min("apply_url").alias("url"))
    links = others.groupBy("fingerprint").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "url")))).alias("external_links"))
    return newest.join(links, "fingerprint")


def supersede(jobs: DataFrame) -> DataFrame:
    """Kept aggregator rows that share a fingerprint with a kept own posting are refused."""
    kept = F.col("decision") == "KEEP"
    owned = jobs.where(kept & ~F.col("is_aggregator")).select("fingerprint").distinct().withColumn("_owned", F.lit(True))
    marked = jobs.join(owned, "fingerprint", "left").withColumn("_loses", kept & F.col("is_aggregator") & F.coalesce("_owned", F.lit(False)))
    return marked.withColumns({"reason": F.when(F.col("_loses"), "superseded by endpoint").otherwise(F.col("reason")), "decision": F.when(F.col("_loses"), "SKIP").otherwise(F.col("decision"))}).drop("_loses", "_owned")


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; where both have a key, the new value stays. Null counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(b, a))


def supersede_with_links(jobs: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """supersede(), after which the own posting holds the links of the rows it superseded and those have no scores.

    jobs (id, fingerprint, source, decision, reason, is_aggregator, apply_url, external_links, created_at) and scores (id, ...)
    give both anew. The first kept own posting of a fingerprint, by (created_at, id), gets the links: for each source the last
    one's address, by the same order, merged into the links it has. Links are pre-aggregated by fingerprint and source, so that a
    fingerprint may stand for any number of rows; a fingerprint has as many links as there are sources."""
    order = F.struct("created_at", "id")
    refused = supersede(jobs)
    lost = (F.col("reason") == "superseded by endpoint") & F.col("is_aggregator") & (F.col("decision") == "SKIP")
    before = jobs.where("is_aggregator AND decision = 'KEEP'").select("id")
    losers = refused.where(lost).join(before, "id", "left_semi")
    last = losers.where("apply_url IS NOT NULL").groupBy("fingerprint", "source").agg(F.max_by("apply_url", order).alias("url"))
    links = last.groupBy("fingerprint").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "url")))).alias("_links"))
    winner = jobs.where("decision = 'KEEP' AND NOT is_aggregator").groupBy("fingerprint").agg(F.min(order).alias("_first")).join(links, "fingerprint").select(F.col("_first.id").alias("id"), "_links")
    linked = refused.join(winner, "id", "left").withColumn("external_links", F.when(F.col("_links").isNotNull(), merged(F.col("external_links"), F.col("_links"))).otherwise(F.col("external_links"))).drop("_links")
    return linked, scores.join(losers.select("id"), "id", "left_anti")


def deactivate_missing(jobs: DataFrame, seen: DataFrame) -> DataFrame:
    """Active, unapplied rows of an endpoint that its crawl no longer shows become inactive; an endpoint without any seen
    row keeps all of its rows."""
    marks = seen.select("endpoint_id", "external_id").distinct().withColumn("_seen", F.lit(True))
    crawled = seen.select("endpoint_id").distinct().withColumn("_crawled", F.lit(True))
    joined = jobs.join(marks, ["endpoint_id", "external_id"], "left").join(crawled, "endpoint_id", "left")
    gone = F.col("is_active") & ~F.col("applied") & F.col("_crawled") & F.col("_seen").isNull()
    return joined.withColumn("is_active", F.col("is_active") & ~F.coalesce(gone, F.lit(False))).drop("_seen", "_crawled")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old with what new has for their keys, and new's other rows; new's nulls leave old values."""
    values = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in values])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_where_in(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(doomed.select(*keys).distinct(), keys, "left_anti")


def purge(df: DataFrame, date: str, as_of: Column, days: int, kept: Column | None = None) -> DataFrame:
    """Rows no older than so many days, and those kept anyway."""
    fresh = F.col(date) >= F.date_sub(as_of, days)
    return df.where(fresh if kept is None else fresh | kept)
