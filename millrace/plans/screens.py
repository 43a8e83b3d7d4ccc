"""Queries of details, sorts and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.dialect import sql_literal
from millrace.operators import search, views
from millrace.plans import bindings as b
from millrace.plans.scalars import FINGERPRINT
from millrace.session import table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with scores from ids; some lack one or both."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    skills = lambda n: F.filter(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda x, i: i < n)
    m = d.where("doc_id % 3 <> 0").select(k.alias("id"), (k % 101).alias("score"), F.when(k % 101 >= 40, "APPLY").otherwise("SKIP").alias("recommendation"), skills(k % 4).alias("matched"), skills(3 - k % 4).alias("missing"))
    o = d.where("doc_id % 5 <> 0").select(k.alias("id"), (k % 89).alias("score"))
    return views.with_scores(b.jobs(spark, sf_dir), m, o)


SCORED = f"""{b.JOBS}, scored AS (SELECT *, CASE WHEN id % 3 <> 0 THEN id % 101 ELSE 0 END AS match_score, CASE WHEN id % 5 <> 0 THEN id % 89 ELSE 0 END AS opportunity_score,
  CASE WHEN id % 3 <> 0 THEN CASE WHEN id % 101 >= 40 THEN 'APPLY' ELSE 'SKIP' END END AS recommendation, CASE WHEN id % 3 <> 0 THEN ['a', 'b', 'c'][1 : id % 4] ELSE [] END AS matched,
  CASE WHEN id % 3 <> 0 THEN ['a', 'b', 'c'][1 : 3 - id % 4] ELSE [] END AS missing FROM jobs)"""


def prj02_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All postings with match and opportunity, whole titles and descriptions included."""
    return _scored(spark, sf_dir).select("id", "title", F.md5("description").alias("text_md5"), "match_score", "opportunity_score", "recommendation", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


def srt02_applied_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten applied postings by each of the six orders (top-k reports)."""
    rows = _scored(spark, sf_dir).where("applied").withColumn("applied_at", F.date_add("discovered_date", (F.col("id") % 9).cast("int")))
    pages = [search.page(rows, views.applied_order(s), size=10).select("id", F.lit(s).alias("sort")) for s in views.APPLIED_ORDERS]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out


def srt03_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(_scored(spark, sf_dir).where(search.visible()), views.today_order(), size=50).select("id", "match_score", "posted_date", "opportunity_score")


def url03_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system of URLs written from page ids."""
    found = urls.system_anywhere(_url())
    return table(spark, sf_dir, "pages").select("page_id", found.alias("ats"))


URLS = ("see https://boards.greenhouse.io/acme/jobs/1", "http://jobs.eu.lever.co/x", "https://jobs.lever.co/acme", "https://acme.wd5.myworkdayjobs.com/en", "https://acme.personio.de", "https://www.stepstone.nl/", "https://www.stepstone.fr/", "https://acme.greenhouse.io", "https://boardsy.greenhouse.io", "https://acme.com/?gh_jid=3", "https://acme.com/?a=b&lever_source=x", "https://acme.com/gh_jid=3", "ftp://acme.join.com", "https://a.join.com/x https://jobs.ashbyhq.com/y")
_SYSTEMS = ("GREENHOUSE", "LEVER_EU", "LEVER", "WORKDAY", "PERSONIO", "STEPSTONE", None, "GREENHOUSE", None, "GREENHOUSE", "LEVER", None, None, "ASHBY")


def _url():
    return F.element_at(F.array(*map(F.lit, URLS)), (F.col("page_id") % len(URLS) + 1).cast("int"))


def prd07_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, day = F.col("id"), lambda n: F.date_add(F.lit("2024-03-01").cast("date"), n.cast("int"))
    j = b.jobs(spark, sf_dir).withColumns({"last_check": F.when(k % 4 != 0, day(-(k % 9))), "endpoint_id": F.when(k % 3 == 0, k), "apply_url": F.when(k % 5 != 0, F.concat(F.lit("https://x/"), k)), "created_at": F.col("discovered_date")})
    return views.liveness_due(j, F.lit("2024-02-26").cast("date"), 50)


def prd08_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(k.alias("run_id"), F.element_at(F.array(*map(F.lit, ("SUCCESS", "ERROR", "EMPTY", "SUCCESS"))), (k % 4 + 1).cast("int")).alias("last_status"), (k % 3).alias("fetched"))
    return views.aggregator_issues(runs)


def prd09_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.when(k % 7 != 0, F.col("s_name")).alias("url"), F.when(k % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))).alias("enriched_at"))
    return views.stale_for_enrichment(c, F.lit("2024-03-01").cast("date"))


def stm05_reaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.jobs(spark, sf_dir).withColumns({"visa": F.when(F.col("id") % 3 == 0, "PENDING").when(F.col("id") % 3 == 1, "CONFIRMED"), "reason": F.lit(None).cast("string")})
    return views.reap_pending_visa(j, F.lit("2024-02-15").cast("date")).select("id", "is_active", "visa", "reason")


def win06_unhealthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "error", "ERROR").otherwise("EMPTY")
    crawls = table(spark, sf_dir, "events").select(F.col("event_id").alias("crawl_id"), F.col("user_id").alias("endpoint_id"), F.col("ts").alias("crawled_at"), kind.alias("status"))
    return views.unhealthy(crawls)


def ded05_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.jobs(spark, sf_dir).withColumns({"title": F.col("source"), "fingerprint": F.lit("old"), "reason": F.lit(None).cast("string")})
    return views.reindex(j)[1]


def ded07_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People named by orders' clerks; some have an address, some are known."""
    k = F.col("o_orderkey")
    found = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit(" Name "), (k % 700).cast("string")).alias("name"), (k % 3).alias("company_id"), F.when(k % 2 == 0, F.concat(F.lit("in/"), (k % 500).cast("string"))).alias("url"))
    n = F.col("c_custkey")
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("NAME "), (n % 100).cast("string")).alias("name"), (n % 3).alias("company_id"), F.concat(F.lit("in/"), (n % 90).cast("string")).alias("url"))
    return views.new_contacts(found, known).select("id", "name", "url")


def sco18_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.element_at(F.array(*[F.lit(x) for x in (*views.VARIANTS, None)]), (k % 9 + 1).cast("int"))
    now = F.lit("2024-03-01").cast("timestamp_ntz")
    open_ = views.may_connect(k % 8, F.when(k % 5 != 0, now - F.make_interval(days=(k % 15).cast("int"))), now)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(views.message_variants(status), ",").alias("variants"), open_.alias("may_connect"), views.expires_in((k % 13).cast("double") / 10).alias("expires_in"))


QUERIES = {f.__name__: f for f in (prj02_details, srt02_applied_sorts, srt03_today, url03_systems, prd07_liveness, prd08_issues, prd09_stale, stm05_reaped, win06_unhealthy, ded05_reindex, ded07_contacts, sco18_variants)}
_SORTS = {"matchScore": "match_score DESC", "opportunity": "opportunity_score DESC", "company": "company NULLS LAST", "title": "title", "date": "posted_date DESC NULLS LAST", "appliedAt": "applied_at DESC"}
_KNOWN = "k AS (SELECT DISTINCT 'name ' || (c_custkey % 100) AS n, c_custkey % 3 AS c, 'in/' || (c_custkey % 90) AS u FROM customer)"
_VARIANTS = ("INFO_CHAT,TECH_DISCUSSION,RECRUITER_PITCH", "FOLLOW_UP,TECH_DISCUSSION,REFERRAL_ASK", "FOLLOW_UP,TECH_DISCUSSION,REFERRAL_ASK", "REFERRAL_ASK,FOLLOW_UP", "REFERRAL_ASK,FOLLOW_UP", "REFERRAL_ASK,FOLLOW_UP", "FOLLOW_UP", "FOLLOW_UP", "INFO_CHAT,TECH_DISCUSSION,RECRUITER_PITCH")
SQL = {
    "prj02_details": f"WITH {SCORED} SELECT id, title, md5(description) AS text_md5, match_score, opportunity_score, recommendation, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing FROM scored",
    "srt02_applied_sorts": f"WITH {SCORED}, a AS (SELECT *, discovered_date + CAST(id % 9 AS INTEGER) AS applied_at FROM scored WHERE applied) " + " UNION ALL ".join(f"(SELECT id, '{n}' AS sort FROM a ORDER BY {o}, id LIMIT 10)" for n, o in _SORTS.items()),
    "srt03_today": f"WITH {SCORED} SELECT id, match_score, posted_date, opportunity_score FROM scored WHERE is_active AND NOT applied AND NOT hidden AND decision = 'KEEP' ORDER BY match_score DESC, posted_date DESC NULLS LAST, opportunity_score DESC, id LIMIT 50",
    "url03_systems": f"SELECT page_id, ([{', '.join('NULL' if x is None else sql_literal(x) for x in _SYSTEMS)}])[page_id % {len(URLS)} + 1] AS ats FROM pages",
    "prd07_liveness": f"WITH {b.JOBS}, d AS (SELECT * FROM jobs WHERE is_active AND (id % 4 = 0 OR DATE '2024-03-01' - CAST(id % 9 AS INTEGER) < DATE '2024-02-26')) SELECT id FROM d WHERE applied UNION ALL (SELECT id FROM d WHERE NOT applied AND id % 3 <> 0 AND id % 5 <> 0 AND decision = 'KEEP' ORDER BY discovered_date DESC, id LIMIT 50)",
    "prd08_issues": "SELECT s_suppkey AS run_id, (['SUCCESS', 'ERROR', 'EMPTY', 'SUCCESS'])[s_suppkey % 4 + 1] AS last_status, s_suppkey % 3 AS fetched FROM supplier WHERE s_suppkey % 4 IN (1, 2) OR s_suppkey % 3 = 0",
    "prd09_stale": "SELECT s_suppkey AS company_id, s_name AS url, CASE WHEN s_suppkey % 5 <> 0 THEN DATE '2024-01-01' + CAST(s_suppkey % 60 AS INTEGER) END AS enriched_at FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 60 < 30)",
    "stm05_reaped": f"WITH {b.JOBS}, r AS (SELECT *, is_active AND id % 3 = 0 AND discovered_date < DATE '2024-02-15' AS old FROM jobs) SELECT id, is_active AND NOT old AS is_active, CASE WHEN old THEN 'UNKNOWN' WHEN id % 3 = 0 THEN 'PENDING' WHEN id % 3 = 1 THEN 'CONFIRMED' END AS visa, CASE WHEN old THEN 'visa: pending expired' END AS reason FROM r",
    "win06_unhealthy": "WITH g AS (SELECT user_id, max((ts, event_id)) AS good FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT e.user_id AS endpoint_id, count(*) FILTER (event_type <> 'error') AS empty, count(*) FILTER (event_type = 'error') AS errors FROM events e LEFT JOIN g USING (user_id) WHERE good IS NULL OR (ts, event_id) > good GROUP BY 1) SELECT * FROM a WHERE empty >= 2 OR errors >= 3",
    "ded05_reindex": f"WITH {b.JOBS}, p AS (SELECT * EXCLUDE (title), source AS title FROM jobs), q AS (SELECT *, CASE WHEN is_active THEN {FINGERPRINT} ELSE 'old' END AS fp FROM p), o AS (SELECT DISTINCT fp FROM q WHERE is_active AND NOT is_aggregator AND decision = 'KEEP') SELECT count(*) FILTER (is_active) AS updated, count(*) FILTER (is_aggregator AND decision = 'KEEP' AND fp IN (SELECT fp FROM o)) AS superseded FROM q",
    "ded07_contacts": f"WITH {_KNOWN}, f AS (SELECT o_orderkey AS id, 'name ' || (o_orderkey % 700) AS n, o_orderkey % 3 AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'in/' || (o_orderkey % 500) END AS u FROM orders), s AS (SELECT min(id) AS id FROM f WHERE u IS NOT NULL AND u NOT IN (SELECT u FROM k) GROUP BY u UNION ALL SELECT min(id) FROM f WHERE u IS NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.n = f.n AND k.c = f.c) GROUP BY n, c) SELECT id, ' Name ' || (id % 700) AS name, u AS url FROM f JOIN s USING (id)",
    "sco18_variants": f"SELECT c_custkey, ([{', '.join(map(sql_literal, _VARIANTS))}])[c_custkey % 9 + 1] AS variants, c_custkey % 8 < 5 AND (c_custkey % 5 = 0 OR c_custkey % 15 >= 7) AS may_connect, CASE WHEN c_custkey % 13 >= 12 OR trunc((1.0::DOUBLE - CAST(c_custkey % 13 AS DOUBLE) / 10) * 7) <= 0 THEN 'overdue' ELSE CAST(trunc((1.0::DOUBLE - CAST(c_custkey % 13 AS DOUBLE) / 10) * 7) AS BIGINT) || 'd' END AS expires_in FROM customer",
}
