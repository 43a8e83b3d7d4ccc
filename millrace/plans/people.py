"""Queries of contacts and their jobs, of discovery, and of what expires or has to be scored again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import contacts, filters, nesting, people, search
from millrace.plans import bindings as b
from millrace.session import table

_c = F.col


def _day(n: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as contacts."""
    k = _c("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("contact_id"), _c("c_name").alias("name"), F.when(k % 9 != 0, k % 40).alias("company_id"), F.when(k % 4 != 0, k % 101).alias("warmth"), F.when(k % 3 != 0, k % 97).alias("priority"), _day(k % 50).alias("created_at"))


_CONTACTS = "contacts AS (SELECT c_custkey AS contact_id, c_name AS name, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey % 40 END AS company_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 101 END AS warmth, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 97 END AS priority, DATE '2024-01-01' + CAST(c_custkey % 50 AS INTEGER) AS created_at FROM customer)"


def _companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_c("s_suppkey").alias("company_id"), _c("s_name").alias("name"))


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as endpoints of every other company."""
    k = _c("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("endpoint_id"), (k % 20 * 2).alias("company_id"), (k % 20 % 3 != 0).alias("is_active"), F.when(k % 7 != 0, _day(k % 30)).alias("last_crawled_at"))


_ENDPOINTS = "endpoints AS (SELECT p_partkey AS endpoint_id, p_partkey % 20 * 2 AS company_id, p_partkey % 20 % 3 <> 0 AS is_active, CASE WHEN p_partkey % 7 <> 0 THEN DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) END AS last_crawled_at FROM part)"


def prj07_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _c("c_custkey")
    known = table(spark, sf_dir, "customer").where(k % 2 == 0).select(k.alias("contact_id"), F.when(k % 4 == 0, "REPLIED").otherwise("CONTACTED").alias("status"), _day(k % 20).alias("last_contact_at"))
    return contacts.with_relationships(_contacts(spark, sf_dir), _companies(spark, sf_dir), known)


def srt06_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty contacts by each order (top-k reports)."""
    pages = [search.page(_contacts(spark, sf_dir), contacts.contact_order(s), size=20).select("contact_id", F.lit(s).alias("sort")) for s in contacts.CONTACT_ORDERS]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


def join12_linked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as links between contacts and postings, each twice."""
    link = table(spark, sf_dir, "orders").select((_c("o_orderkey") % 1000).alias("job_id"), _c("o_custkey").alias("contact_id"))
    found = b.jobs(spark, sf_dir).select(_c("id").alias("job_id"), "source")
    return contacts.linked_jobs(link.unionByName(link), _contacts(spark, sf_dir).select("contact_id", "priority"), found)


def join06_no_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.without_endpoints(_companies(spark, sf_dir), _endpoints(spark, sf_dir))


def join14_no_active_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.without_endpoints(_companies(spark, sf_dir), _endpoints(spark, sf_dir), active_only=True)


def srt07_crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty endpoints that are due first (a top-k report)."""
    return search.page(_endpoints(spark, sf_dir), contacts.crawl_order(), size=30).select("endpoint_id", "last_crawled_at")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nations as configured sources."""
    k = _c("n_nationkey")
    return table(spark, sf_dir, "nation").select(_c("n_name").alias("source"), k.alias("rank"), (k % 5 != 0).alias("enabled"), F.array(F.concat(F.lit("k"), k % 4), F.lit("java"), F.concat(F.lit("k"), k % 3)).alias("keywords"), F.array(F.lit("Wien"), F.concat(F.lit("L"), k)).alias("locations"))


def join13_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.searches(_sources(spark, sf_dir))


def set04_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.all_keywords(_sources(spark, sf_dir)).select("keyword", _c("first.rank").alias("rank"), _c("first.place").alias("place"))


def stm06_recruiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = b.jobs(spark, sf_dir).withColumns({"recruiter_name": F.concat(F.lit("R"), _c("id")), "recruiter_email": F.concat(_c("id"), F.lit("@x"))})
    return contacts.forget_recruiters(held, F.lit("2024-05-01").cast("date")).select("id", "recruiter_name", "recruiter_email")


def stm07_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cached profiles that expire a week later."""
    cached = table(spark, sf_dir, "events").select("event_id", (_c("ts") + F.make_interval(days=F.lit(7))).alias("expires_at"))
    return contacts.unexpired(cached, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("event_id")


def stm11_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept postings that have to be scored again after some got a description."""
    k, j = _c("id"), b.jobs(spark, sf_dir)
    held = j.where(k % 3 != 0).select("id", (k % 5).alias("score"), F.when(k % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Go"))).alias("matched"))
    return contacts.unscored(j, contacts.still_valid_scores(held, j, j.where(k % 8 == 1))).select("id")


def flt11_refilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept postings whose description came later, with literal descriptions by id; others stay as they are."""
    k = _c("id")
    said = F.element_at(F.array(*map(F.lit, ("we need 9+ years of experience", "3 years of experience. no visa", "nothing"))), (k % 3 + 1).cast("int"))
    rules = filters.Filters(role_include=("x",), role_exclude=("y",), language_exclude=("zzz",), language_soft=("zz",), visa_negative=(r"\bno visa\b",), visa_positive=(r"\bvisa offered\b",), most_years=8, visa_exempt=("DE",))
    waiting = b.jobs(spark, sf_dir).withColumns({"title": F.lit("Dev"), "description": said, "lang": F.lit("en"), "country_iso": F.when(k % 5 == 0, "DE"), "visa": F.when(k % 2 == 0, "PENDING").otherwise("CONFIRMED"), "reason": F.when(_c("decision") == "SKIP", "old"), "yoe": F.lit(None).cast("int")})
    return filters.refilter_described(waiting, rules).select("id", "decision", "visa", "yoe")


def join10_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people.containing_company(b.jobs(spark, sf_dir), "SAP SE Walldorf").select("id", "company")


def str04_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text.name_parts(F.concat(F.lit("  Ada  De "), _c("s_name"), F.lit(" X ")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", parts["first"].alias("first"), parts["last"].alias("last"))


def str14_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.snake_upper(F.concat(F.lit("followUp"), F.initcap("p_name"))).alias("name"))


def str17_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of replies that hold a posting's whole text."""
    body = F.to_json(F.struct(_c("text").alias("t")))
    found = text.json_slice(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.get_json_object(found, "$.t")).alias("text"))


def agg19_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.jobs(spark, sf_dir).agg(F.count_if(_c("decision") == "KEEP").alias("apply"), F.countDistinct("company").alias("companies"), F.max("salary_max").alias("highest"))


def _written(name: str, *fields: str) -> Column:
    """An array of structs in writing, its parts in their order."""
    part = lambda p: F.concat_ws("|", *[F.coalesce(p[f].cast("string"), F.lit("-")) for f in fields])
    return F.array_join(F.transform(name, part), ",").alias(name)


def prj05_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with their endpoints as nested rows and their active postings counted."""
    found = nesting.company_details(_companies(spark, sf_dir), _endpoints(spark, sf_dir), b.jobs(spark, sf_dir))
    summaries = nesting.company_summaries(_companies(spark, sf_dir).select("company_id"), _endpoints(spark, sf_dir))
    return found.join(summaries, "company_id").select("company_id", "name", _written("endpoints", "endpoint_id", "is_active", "last_crawled_at"), "active_jobs", "endpoint_count")


def prj06_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applications with their job and their outcomes as nested rows."""
    found = nesting.application_details(b.applications(spark, sf_dir), b.jobs(spark, sf_dir), b.outcomes(spark, sf_dir))
    return found.select("application_id", "status", F.md5("title").alias("title"), "company_name", _written("outcomes", "stage", "occurred_at", "notes"), F.size("outcomes").alias("n"))


QUERIES = {f.__name__: f for f in (prj05_details, prj06_details, prj07_contacts, srt06_contacts, join12_linked_jobs, join06_no_endpoints, join14_no_active_endpoints, srt07_crawl_order, join13_searches, set04_keywords, stm06_recruiters, stm07_profiles, stm11_unscored, flt11_refilter, join10_companies, str04_name_parts, str14_snake, str17_slices, agg19_digest)}
_ORDERS = {"priority": "priority DESC NULLS LAST", "warmth": "warmth DESC NULLS LAST", "name": "name", "created_at": "created_at DESC"}
_SOURCES = "s AS (SELECT n_name AS source, n_nationkey AS rank, n_nationkey % 5 <> 0 AS enabled, ['k' || (n_nationkey % 4), 'java', 'k' || (n_nationkey % 3)] AS keywords, ['Wien', 'L' || n_nationkey] AS locations FROM nation)"
SQL = {
    "prj05_details": f"WITH {_ENDPOINTS}, {b.JOBS}, e AS (SELECT company_id, string_agg(endpoint_id || '|' || is_active || '|' || coalesce(CAST(last_crawled_at AS VARCHAR), '-'), ',' ORDER BY endpoint_id) AS endpoints, count(*) AS n FROM endpoints GROUP BY 1), j AS (SELECT company_id, count(*) AS n FROM jobs WHERE is_active GROUP BY 1) SELECT s_suppkey AS company_id, s_name AS name, coalesce(endpoints, '') AS endpoints, coalesce(j.n, 0) AS active_jobs, coalesce(e.n, 0) AS endpoint_count FROM supplier LEFT JOIN e ON e.company_id = s_suppkey LEFT JOIN j ON j.company_id = s_suppkey",
    "prj06_details": f"WITH {b.APPLICATIONS}, {b.OUTCOMES}, {b.JOBS}, o AS (SELECT application_id, string_agg(stage || '|' || occurred_at || '|' || coalesce(notes, '-'), ',' ORDER BY occurred_at, stage, notes NULLS FIRST) AS o, count(*) AS n FROM outcomes GROUP BY 1) SELECT a.application_id, a.status, md5(title) AS title, company AS company_name, coalesce(o, '') AS outcomes, CAST(coalesce(n, 0) AS INTEGER) AS n FROM applications a LEFT JOIN o ON o.application_id = a.application_id LEFT JOIN jobs ON jobs.id = a.job_id",
    "prj07_contacts": f"WITH {_CONTACTS} SELECT contact_id, c.name, company_id, coalesce(warmth, 0) AS warmth, coalesce(priority, 0) AS priority, created_at, s_name AS company_name, CASE WHEN contact_id % 4 = 0 THEN 'REPLIED' WHEN contact_id % 2 = 0 THEN 'CONTACTED' END AS status, CASE WHEN contact_id % 2 = 0 THEN DATE '2024-01-01' + CAST(contact_id % 20 AS INTEGER) END AS last_contact_at FROM contacts c LEFT JOIN supplier ON s_suppkey = company_id",
    "srt06_contacts": f"WITH {_CONTACTS} " + " UNION ALL ".join(f"(SELECT contact_id, '{n}' AS sort FROM contacts ORDER BY {o}, contact_id LIMIT 20)" for n, o in _ORDERS.items()),
    "join12_linked_jobs": f"WITH {_CONTACTS} SELECT DISTINCT o_orderkey % 1000 AS job_id, o_custkey AS contact_id, priority, source FROM orders JOIN contacts ON contact_id = o_custkey JOIN documents ON doc_id = o_orderkey % 1000",
    "join06_no_endpoints": f"WITH {_ENDPOINTS} SELECT s_suppkey AS company_id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT company_id FROM endpoints)",
    "join14_no_active_endpoints": f"WITH {_ENDPOINTS} SELECT s_suppkey AS company_id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT company_id FROM endpoints WHERE is_active)",
    "srt07_crawl_order": f"WITH {_ENDPOINTS} SELECT endpoint_id, last_crawled_at FROM endpoints ORDER BY last_crawled_at NULLS FIRST, endpoint_id LIMIT 30",
    "join13_searches": f"WITH {_SOURCES}, k AS (SELECT source, locations, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) - 1 AS k FROM s) SELECT source, keyword, k, unnest(locations) AS location, generate_subscripts(locations, 1) - 1 AS l FROM k",
    "set04_keywords": f"WITH {_SOURCES}, k AS (SELECT rank, unnest(keywords) AS keyword, generate_subscripts(keywords, 1) - 1 AS place FROM s WHERE enabled) SELECT keyword, min((rank, place))[1] AS rank, min((rank, place))[2] AS place FROM k GROUP BY 1",
    "stm06_recruiters": f"WITH {b.JOBS} SELECT id, CASE WHEN discovered_date >= DATE '2024-02-01' THEN 'R' || id END AS recruiter_name, CASE WHEN discovered_date >= DATE '2024-02-01' THEN id || '@x' END AS recruiter_email FROM jobs",
    "stm07_profiles": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-22'",
    "stm11_unscored": f"WITH {b.JOBS} SELECT id FROM jobs WHERE decision = 'KEEP' AND (id % 3 = 0 OR id % 8 = 1 OR (id % 5 = 0 AND id % 2 = 0 AND is_active AND description IS NOT NULL))",
    "flt11_refilter": f"WITH {b.JOBS} SELECT id, CASE WHEN decision = 'KEEP' AND (id % 3 = 0 OR (id % 2 = 0 AND id % 5 <> 0)) THEN 'SKIP' ELSE decision END AS decision, CASE WHEN id % 2 <> 0 THEN 'CONFIRMED' WHEN decision = 'SKIP' OR id % 3 = 0 THEN 'PENDING' WHEN id % 5 <> 0 AND id % 3 = 1 THEN 'REJECTED' ELSE 'UNKNOWN' END AS visa, CASE WHEN decision = 'KEEP' AND id % 3 < 2 THEN 9 - id % 3 * 6 END AS yoe FROM jobs",
    "join10_companies": f"WITH {b.JOBS} SELECT id, company FROM jobs WHERE contains('sap se walldorf', lower(company)) OR contains(lower(company), 'sap se walldorf')",
    "str04_name_parts": r"SELECT s_suppkey, 'ada' AS first, 'de' || replace(lower(s_name), ' ', '') || 'x' AS last FROM supplier",
    "str14_snake": "SELECT p_partkey, 'FOLLOW_UP_' || upper(p_name) AS name FROM part",
    "str17_slices": "SELECT doc_id, md5(text) AS text FROM documents",
    "agg19_digest": f"WITH {b.JOBS} SELECT count(*) FILTER (decision = 'KEEP') AS apply, count(DISTINCT company) AS companies, max(salary_max) AS highest FROM jobs",
}
