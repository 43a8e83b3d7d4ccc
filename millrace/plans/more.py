"""Queries of the remaining scores, versions, counts and nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import postings, scoring, search
from millrace.plans import bindings as b
from millrace.session import table

EXPIRED, ACTIVE = ("no longer available", "eauou"), ("apply now", "ing the")
SURGE = ("ation", "ering", "onthe", "edthe", "ing", "the", "and", "er")


def win01_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each order, as the latest version of a letter, with the number of versions. Of lines with the same number
    the one that stands first in the table counts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    latest = postings.first_per_key(li, ["l_orderkey"], [F.desc("l_linenumber"), F.asc("_file"), F.asc("_row")]).drop("_file", "_row")
    return latest.join(li.groupBy("l_orderkey").agg(F.count("*").alias("versions")), "l_orderkey")


def agg12_discovery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.agg(F.count("*").alias("total"), *[F.count_if(F.col("o_orderstatus") == s).alias(n) for s, n in (("O", "open"), ("F", "done"), ("P", "pending"))])


def agg14_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean priority of contacts that have one, and how many came since a day, by market."""
    p = F.col("c_custkey") % 50
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(text.half_up(F.avg(F.when(p > 0, p)), 3).alias("priority"), F.count_if(F.col("c_custkey") % 7 < 3).alias("recent"))


def agg20_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of part names and how many parts have them."""
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def prd06_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints (users) never crawled well, or not since a day."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_crawled_at"))
    kinds = last.withColumn("ats_type", F.when(F.col("user_id") % 5 == 0, "CUSTOM").otherwise("LEVER"))
    return kinds.where(search.due_for_crawl(F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))).select("user_id", "last_crawled_at")


def sco07_company_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    score = scoring.company_priority(k % 120, F.when(k % 2 == 0, k % 90), k % 70, k % 101, F.lit(None).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(score, 6).alias("priority"))


def sco12_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    parts = {n: F.when(k % d != 0, k % 7) for n, d in (("fit", 2), ("level", 3), ("pay", 5), ("growth", 7), ("risk", 11))}
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(scoring.evaluation(parts), 6).alias("overall"))


def sco14_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.hiring_surge(F.col("text"), SURGE).alias("surge"))


def sco15_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 404, 410, 503, 200))), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", scoring.liveness(status, F.col("html"), EXPIRED, ACTIVE).alias("liveness"))


def prj06_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with their outcomes as one line in order of day and stage."""
    lines = b.outcomes(spark, sf_dir).groupBy("application_id").agg(F.sort_array(F.collect_list(F.concat(F.col("occurred_at").cast("string"), F.lit(":"), F.col("stage")))).alias("o"))
    return b.applications(spark, sf_dir).join(lines, "application_id", "left").select("application_id", "status", F.coalesce(F.array_join("o", ","), F.lit("")).alias("outcomes"))


def srt02_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of applied postings by several keys, two of them with nulls last."""
    j = b.jobs(spark, sf_dir).where("applied")
    return search.page(j, [F.desc_nulls_last("posted_date"), F.asc("source"), F.desc_nulls_last("salary_max"), F.asc("id")], size=30).select("id", "source", "posted_date", "salary_max")


QUERIES = {f.__name__: f for f in (win01_latest_version, agg12_discovery_stats, agg14_contacts, agg20_tags, prd06_due, sco07_company_priority, sco12_evaluation, sco14_surge, sco15_liveness, prj06_applications, srt02_applied)}
_D = "CAST({} AS DOUBLE)"
SQL = {
    "win01_latest_version": "SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_partkey, l_linenumber) AS l_partkey, count(*) AS versions FROM lineitem GROUP BY 1",
    "agg12_discovery_stats": "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders",
    "agg14_contacts": "SELECT c_mktsegment, floor(avg(CASE WHEN c_custkey % 50 > 0 THEN c_custkey % 50 END) * 1000 + 0.5) / 1000 AS priority, count(*) FILTER (c_custkey % 7 < 3) AS recent FROM customer GROUP BY 1",
    "agg20_tags": "SELECT tag, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1",
    "prd06_due": "WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS last_crawled_at FROM events GROUP BY 1) SELECT * FROM l WHERE user_id % 5 <> 0 AND (last_crawled_at IS NULL OR last_crawled_at < TIMESTAMP '2024-01-29')",
    "sco07_company_priority": "SELECT s_suppkey, round(CAST(least(100, s_suppkey % 120) AS DOUBLE) * 0.35 + CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 90 AS DOUBLE) ELSE 50 END * 0.25 + CAST(s_suppkey % 70 AS DOUBLE) * 0.15 + CAST(least(100, s_suppkey % 101) AS DOUBLE) * 0.15 + CAST(50 AS DOUBLE) * 0.10, 6) AS priority FROM supplier",
    "sco12_evaluation": f"SELECT s_suppkey, round({' + '.join(f'{_D.format(f"CASE WHEN s_suppkey % {d} <> 0 THEN greatest(1, least(5, s_suppkey % 7)) ELSE 3 END")} * {w}' for d, w in zip((2, 3, 5, 7, 11), (0.35, 0.20, 0.20, 0.15, 0.10), strict=True))}, 6) AS overall FROM supplier",
    "sco14_surge": f"SELECT doc_id, {' + '.join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in SURGE)} >= 5 AS surge FROM documents",
    "sco15_liveness": f"WITH s AS (SELECT page_id, lower(html) AS h, ([200, 404, 410, 503, 200])[page_id % 5 + 1] AS s FROM pages) SELECT page_id, CASE WHEN s IN (404, 410) THEN 'EXPIRED' WHEN s >= 400 THEN 'UNCERTAIN' WHEN {' OR '.join(f"contains(h, '{w}')" for w in EXPIRED)} THEN 'EXPIRED' WHEN {' OR '.join(f"contains(h, '{w}')" for w in ACTIVE)} THEN 'ACTIVE' ELSE 'UNCERTAIN' END AS liveness FROM s",
    "prj06_applications": f"WITH {b.APPLICATIONS}, {b.OUTCOMES}, o AS (SELECT application_id, string_agg(occurred_at || ':' || stage, ',' ORDER BY occurred_at || ':' || stage) AS o FROM outcomes GROUP BY 1) SELECT application_id, status, coalesce(o, '') AS outcomes FROM applications LEFT JOIN o USING (application_id)",
    "srt02_applied": f"WITH {b.JOBS} SELECT id, source, posted_date, salary_max FROM jobs WHERE applied ORDER BY posted_date DESC NULLS LAST, source, salary_max DESC NULLS LAST, id LIMIT 30",
}
