"""Queries of lookups, sources, counts and rows for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import analytics, people, search
from millrace.plans import bindings as b
from millrace.session import table


def scn02_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings that have a label, looked up by their ids; what isn't there isn't found."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return search.by_keys(b.jobs(spark, sf_dir), ids.unionByName(ids.select(-F.col("id").alias("id")).toDF("id")), "id").select("id", "source", F.length("description").alias("chars"))


def prd02_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible postings of aggregators, and those of own sources."""
    j = b.jobs(spark, sf_dir)
    parts = [search.search(j, aggregators=own).select("id", "source", F.lit(own).alias("aggregators")) for own in (True, False)]
    return parts[0].unionByName(parts[1])


def agg09_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.counts_by(b.jobs(spark, sf_dir), "company")


def agg09_by_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.counts_by(b.jobs(spark, sf_dir), "remote")


def srt10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole titles in an order that knows no case, with their places."""
    return search.ranked_by_name(b.jobs(spark, sf_dir).select("id", "title"), "title", "id").select("id", "place")


def prj08_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions as rows for display, with the names of contacts, companies and postings; some name neither."""
    k = F.col("o_orderkey")
    actions = table(spark, sf_dir, "orders").select(
        k.alias("entity_id"), F.when(k % 3 == 0, "FOLLOW_UP").otherwise("SEND_MESSAGE").alias("action"), (k % 200).cast("double").alias("score"), ((k % 14).cast("double") / 10).alias("urgency"),
        F.when(k % 4 != 0, F.col("o_custkey")).alias("contact_id"), F.when(k % 5 != 0, k % 1500).alias("job_id"),
    )
    c = F.col("c_custkey")
    contacts = table(spark, sf_dir, "customer").select(c.alias("contact_id"), F.col("c_name").alias("contact_name"), F.when(c % 2 == 0, F.concat(F.lit("Firm "), c % 7)).alias("company_name"))
    jobs = b.jobs(spark, sf_dir).select(F.col("id").alias("job_id"), "title", "company")
    return people.display_rows(actions, contacts, jobs).withColumn("job_title", F.md5("job_title"))


QUERIES = {f.__name__: f for f in (scn02_lookup, prd02_sources, agg09_by_company, agg09_by_remote, srt10_names, prj08_display)}
_DAYS = "greatest(0, CAST(trunc((1.0 - u) * 7) AS BIGINT))"
SQL = {
    "scn02_lookup": "SELECT doc_id AS id, source, length(text) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels UNION ALL SELECT -doc_id FROM labels)",
    "prd02_sources": f"WITH {b.JOBS} SELECT id, source, is_aggregator AS aggregators FROM jobs WHERE is_active AND NOT applied AND NOT hidden AND decision = 'KEEP'",
    "agg09_by_company": f"WITH {b.JOBS} SELECT coalesce(company, 'UNKNOWN') AS company, count(*) AS n FROM jobs GROUP BY 1",
    "agg09_by_remote": f"WITH {b.JOBS} SELECT coalesce(remote, 'UNKNOWN') AS remote, count(*) AS n FROM jobs GROUP BY 1",
    "srt10_names": f"WITH {b.JOBS} SELECT id, row_number() OVER (ORDER BY lower(title) NULLS LAST, title NULLS LAST, id) AS place FROM jobs",
    "prj08_display": f"""WITH {b.JOBS}, a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'FOLLOW_UP' ELSE 'SEND_MESSAGE' END AS action, CAST(o_orderkey % 14 AS DOUBLE) / 10 AS u,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS contact_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 1500 END AS job_id FROM orders)
SELECT CAST(k AS VARCHAR) AS entity_id, action, CAST(k % 200 AS DOUBLE) AS score, u AS urgency, lower(replace(action, '_', ' ')) AS label,
  CASE WHEN u >= 1.2 OR {_DAYS} = 0 THEN 'overdue' ELSE {_DAYS} || 'd' END AS expires_in, CAST(contact_id AS VARCHAR) AS contact_id, CAST(job_id AS VARCHAR) AS job_id, c_name AS contact_name,
  coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'Firm ' || c_custkey % 7 END, jobs.company) AS company_name, md5(jobs.title) AS job_title
FROM a LEFT JOIN customer ON c_custkey = contact_id LEFT JOIN jobs ON jobs.id = job_id""",
}
