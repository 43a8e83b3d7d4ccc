"""Queries of places, systems, people and the action queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import geo, urls
from millrace.functions.dialect import re2, sql_literal
from millrace.operators import analytics, people, search, state
from millrace.plans import bindings as b
from millrace.session import table

PLACES = ("Vienna", "Zürich", "Frankfurt am Main", "The Netherlands", "Veghel, NL", "Amsterdam NL", "nl", "London", "Hybrid - Berlin", "New York City", "Paris, France", "in Dublin", "Dublin", "Essen", "Toronto, ON", "x", "", None)
TITLES = ("Recruiter", "TA Partner", "Engineering Manager", "Director of Engineering", "Head of Talent Acquisition", "Staff Engineer", "Sr. Developer", "Developer", "VP Sales", "", None)


def _pick(values: tuple, key: str):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple, key: str) -> str:
    return f"([{', '.join('NULL' if v is None else sql_literal(v) for v in values)}])[{key} % {len(values)} + 1]"


def geo01_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _pick(PLACES, "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", place.alias("place"), geo.resolve(place).alias("iso"), geo.is_target(geo.resolve(place)).alias("wanted"))


_ISO = {"Vienna": "AT", "Zürich": "CH", "Frankfurt am Main": "DE", "The Netherlands": "NL", "Veghel, NL": "NL", "Amsterdam NL": "NL", "nl": "NL", "London": "GB", "Hybrid - Berlin": "DE", "Paris, France": "FR", "Dublin": "IE", "Essen": "NL", "Toronto, ON": "CA"}


def url02_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.col("html"), F.when(F.col("page_id") % 3 == 0, "<script src=https://x.lever.co/a>").when(F.col("page_id") % 3 == 1, "<a href=//jobs.ashbyhq.com>").otherwise(""))
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://jobs.lever.co/c"), F.col("page_id"))).otherwise(F.col("url"))
    found = urls.resolution(url, html)
    return table(spark, sf_dir, "pages").select("page_id", *[found[k].alias(k) for k in ("ats", "slug", "confidence")])


def url04_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's postings may be."""
    slug = F.regexp_replace(F.lower("s_name"), "[^a-z0-9]", "")
    domain = F.when(F.col("s_suppkey") % 2 == 0, F.concat(slug, F.lit(".com")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(urls.candidate_urls(slug, domain)).alias("candidate"))


def arr08_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _pick(TITLES, "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", people.poster_seniority(title).alias("poster"), people.contact_seniority(title).alias("contact"))


def arr09_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("Ann "), F.regexp_replace("c_name", "[^A-Za-z]", ""), F.lit(" Lee"))).otherwise("Cher")
    return table(spark, sf_dir, "customer").select("c_custkey", F.inline(people.email_candidates(name, F.lit(" Acme.com "))))


def sco09_warmth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mine, theirs = F.array(*map(F.lit, ("a", "b", "c"))), F.transform(F.sequence(k % 3, k % 3 + k % 4), lambda i: F.element_at(F.array(*map(F.lit, "abcdef")), (i + 1).cast("int")))
    points = people.warmth(F.array(F.when(k % 5 == 0, F.lit(" Acme ")).otherwise("Other")), F.when(k % 3 == 0, "Berlin, Germany").otherwise("Paris"), theirs, k % 13, F.lit("Engineer at ACME"), ("Germany", "remote"), mine)
    return table(spark, sf_dir, "customer").select("c_custkey", points.cast("long").alias("warmth"))


def srt05_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best next actions (a top-k report)."""
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    replied = state.replay(b.relationship_events(table(spark, sf_dir, "events"))).where("status = 'REPLIED'").select("relationship_id", F.col("last_reply_at").cast("timestamp_ntz").alias("last_activity"))
    contacts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contact_id"), (F.col("c_custkey") % 101).alias("priority"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 29).cast("int")).cast("timestamp_ntz").alias("created_at"))
    stale = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("application_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    queue = people.action_queue(replied, contacts, stale, as_of, (70.0, 60.0, 40.0), 50)
    return queue.select("entity_id", "action", F.round("score", 6).alias("score"))


def join09_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against shuffled, cut and repeated titles of the same order, each used once."""
    li = table(spark, sf_dir, "lineitem")
    title = F.concat(F.lit("Senior Position "), (F.col("l_linenumber") % 3).cast("string"))
    refs = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("position"), title.alias("title"))
    texts = li.where("l_linenumber <= 4").select(F.col("l_orderkey").alias("page"), (10 - F.col("l_linenumber")).alias("position"), F.upper(title).alias("title"), F.concat(F.lit("C"), F.col("l_linenumber")).alias("company"))
    return people.align_once(refs, texts, "page")


def agg16_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's new active postings and the best scored of them; some have no score or 0."""
    scores = table(spark, sf_dir, "documents").where("doc_id % 6 <> 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 37 - 1).alias("score"))
    return analytics.daily_digest(b.jobs(spark, sf_dir), scores, F.lit("2024-02-01").cast("date"))


def agg15_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last status of each user's events as an endpoint, counted."""
    order = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = table(spark, sf_dir, "events").withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return last.agg(F.count("*").alias("endpoints"), F.count_if(F.col("event_type") == "error").alias("failing"), F.count_if(F.col("event_type") == "signup").alias("empty"))


def srt08_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of customers, nulls last, by balance."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("balance"))
    return search.page(c, [F.desc_nulls_last("balance"), F.asc("c_custkey")], number=2, size=25)


def prj05_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with their active postings counted and the latest day, zero included."""
    j = b.jobs(spark, sf_dir).where("is_active").groupBy("company_id").agg(F.count("*").alias("n"), F.max("discovered_date").alias("latest"))
    return b.companies(spark, sf_dir).join(j, "company_id", "left").select("company_id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("jobs"), "latest")




QUERIES = {f.__name__: f for f in (geo01_resolve, url02_resolution, url04_candidates, arr08_seniority, arr09_emails, sco09_warmth, srt05_actions, join09_align, agg16_digest, agg15_health, srt08_page, prj05_companies)}
_T = _pick_sql(TITLES, "c_custkey")
_POSTER = " ".join(f"WHEN regexp_matches(t, {re2(p)}) THEN '{n}'" for n, p in people.POSTER_LEVELS)
_CONTACT = " ".join(f"WHEN {' OR '.join(f'contains(lower(t), {sql_literal(w)})' for w in ws)} THEN '{n}'" for n, ws in people.CONTACT_LEVELS)
_HTML = "lower(html || CASE page_id % 3 WHEN 0 THEN '<script src=https://x.lever.co/a>' WHEN 1 THEN '<a href=//jobs.ashbyhq.com>' ELSE '' END)"
SQL = {
    "geo01_resolve": f"WITH p AS (SELECT c_custkey, {_pick_sql(PLACES, 'c_custkey')} AS place FROM customer), i(place, iso) AS (VALUES {', '.join(f'({sql_literal(k)}, {sql_literal(v)})' for k, v in _ISO.items())}) SELECT c_custkey, place, iso, coalesce(iso IN ({', '.join(map(sql_literal, geo.TARGETS))}), false) AS wanted FROM p LEFT JOIN i USING (place)",
    "url02_resolution": f"WITH r AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'LEVER' {' '.join(f'WHEN contains({_HTML}, {sql_literal(x)}) OR contains({_HTML}, {sql_literal(y)}) THEN {sql_literal(a)}' for a, (x, y) in urls.PAGE_WORDS.items())} END AS ats FROM pages) SELECT page_id, ats, CASE WHEN page_id % 4 = 0 THEN 'c' || page_id END AS slug, CASE WHEN page_id % 4 = 0 THEN 'HIGH' WHEN ats IS NOT NULL THEN 'MEDIUM' END AS confidence FROM r",
    "url04_candidates": "WITH s AS (SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS g FROM supplier) SELECT s_suppkey, unnest(list_filter(['https://boards.greenhouse.io/' || g, 'https://jobs.lever.co/' || g, 'https://jobs.ashbyhq.com/' || g, 'https://' || g || '.jobs.personio.de', 'https://' || g || '.pinpointhq.com', CASE WHEN s_suppkey % 2 = 0 THEN 'https://careers.' || g || '.com' END], lambda x: x IS NOT NULL)) AS candidate FROM s",
    "arr08_seniority": f"WITH c AS (SELECT c_custkey, {_T} AS t FROM customer) SELECT c_custkey, CASE WHEN coalesce(t, '') = '' THEN NULL {_POSTER} ELSE 'IC' END AS poster, CASE WHEN coalesce(t, '') = '' THEN NULL {_CONTACT} ELSE 'IC' END AS contact FROM c",
    "arr09_emails": "WITH c AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z]', '', 'g')) || 'lee' AS l FROM customer WHERE c_custkey % 9 <> 0), e AS (SELECT c_custkey, unnest([{'email': 'ann.' || l, 'pattern': 'firstname.lastname', 'confidence': 'HIGH'}, {'email': 'ann', 'pattern': 'firstname', 'confidence': 'MEDIUM'}, {'email': 'a.' || l, 'pattern': 'f.lastname', 'confidence': 'MEDIUM'}, {'email': 'a' || l, 'pattern': 'flastname', 'confidence': 'LOW'}, {'email': 'ann_' || l, 'pattern': 'firstname_lastname', 'confidence': 'LOW'}]) AS e FROM c) SELECT c_custkey, e.email || '@acme.com' AS email, e.pattern AS pattern, e.confidence AS confidence FROM e",
    "sco09_warmth": "WITH c AS (SELECT c_custkey AS k, len(list_intersect(['a', 'b', 'c'], (['a', 'b', 'c', 'd', 'e', 'f'])[k % 3 + 1 : k % 3 + k % 4 + 1])) AS i, k % 4 + 1 AS m FROM customer) SELECT k AS c_custkey, CAST(CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 25 ELSE 0 END + trunc(CAST(i AS DOUBLE) / (3 + m - i) * 15) + CASE WHEN k % 13 >= 10 THEN 15 WHEN k % 13 >= 5 THEN 10 WHEN k % 13 >= 1 THEN 5 ELSE 0 END AS BIGINT) AS warmth FROM c",
    "srt05_actions": f"""WITH {b.RELATIONSHIP_EVENTS}, last AS (SELECT relationship_id AS r, coalesce(arg_max(CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in state.TRANSITIONS.items())} END, (occurred_at, event_id)) FILTER (CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in state.TRANSITIONS.items())} END IS NOT NULL), '') AS s, max(occurred_at) FILTER (event_type = 'REPLIED') AS t FROM relationship_events GROUP BY 1),
u AS (SELECT CAST(r AS VARCHAR) AS entity_id, 'FOLLOW_UP' AS action, CAST(t AS TIMESTAMP) AS t, 7 AS w, 70.0 AS i FROM last WHERE s = 'REPLIED'
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'CONNECT', CAST(DATE '2024-01-01' + CAST(c_custkey % 29 AS INTEGER) AS TIMESTAMP), 14, CAST(60.0 AS DOUBLE) * (c_custkey % 101) / 100 FROM customer WHERE c_custkey % 101 > 50
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'REVIVE', CAST(o_orderdate AS TIMESTAMP), 14, 40.0 FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2024-01-17'),
v AS (SELECT *, w - date_diff('second', date_trunc('second', t), TIMESTAMP '2024-01-31') / 86400.0 AS left_ FROM u)
SELECT entity_id, action, round(CAST(i AS DOUBLE) * CASE WHEN left_ < 0 THEN 1.2 ELSE greatest(0.0, least(1.5, 1 - CAST(left_ AS DOUBLE) / w)) END, 6) AS score FROM v ORDER BY i * CASE WHEN left_ < 0 THEN 1.2 ELSE greatest(0.0, least(1.5, 1 - CAST(left_ AS DOUBLE) / w)) END DESC, action, entity_id LIMIT 50""",
    "join09_align": "WITH r AS (SELECT l_orderkey AS page, l_linenumber AS position, 'Senior Position ' || l_linenumber % 3 AS title, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber) AS n FROM lineitem), t AS (SELECT l_orderkey AS page, 'Senior Position ' || l_linenumber % 3 AS title, 'C' || l_linenumber AS company, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber DESC) AS n FROM lineitem WHERE l_linenumber <= 4) SELECT r.page, position, r.title, company FROM r LEFT JOIN t USING (page, title, n)",
    "agg16_digest": f"WITH {b.JOBS}, v AS (SELECT id, CASE WHEN id % 6 <> 0 THEN id % 37 - 1 END AS score FROM jobs WHERE is_active AND discovered_date = DATE '2024-02-01') SELECT count(*) AS fresh, (SELECT id FROM v WHERE score > 0 ORDER BY score DESC, id LIMIT 1) AS top_id, coalesce(max(score) FILTER (score > 0), 0) AS top_score FROM v",
    "agg15_health": "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT count(*) AS endpoints, count(*) FILTER (event_type = 'error') AS failing, count(*) FILTER (event_type = 'signup') AS empty FROM l",
    "srt08_page": "SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS balance FROM customer ORDER BY 2 DESC NULLS LAST, 1 LIMIT 25 OFFSET 50",
    "prj05_companies": f"WITH {b.JOBS}, {b.SQL_COMPANIES} SELECT c.company_id, c.name, count(j.id) AS jobs, max(j.discovered_date) AS latest FROM companies c LEFT JOIN jobs j ON j.company_id = c.company_id AND j.is_active GROUP BY 1, 2",
}
