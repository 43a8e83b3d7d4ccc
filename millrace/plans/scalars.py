"""Queries of the scalar functions and keys over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import keys, text, urls
from millrace.functions.dialect import re2, sql_literal
from millrace.plans.bindings import JOBS, jobs
from millrace.session import table

A = "CAST(DATE '2024-03-31' AS DATE)"


def key01_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("id", keys.fingerprint(F.col("title"), F.col("company"), F.col("location")).alias("fingerprint"))


def _country_sql(c: str) -> str:
    low = f"lower({c})"
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({low}, {sql_literal(w)})' for w in words)} THEN '{iso}'" for iso, words in keys.COUNTRY_WORDS.items()) + " END"


def _plain_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


_FIRST = r"lower(trim(regexp_extract({c}, '^[^,;]*', 0)))"


def _country_key_sql(c: str) -> str:
    first = _FIRST.format(c=c)
    return f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '' ELSE coalesce({_country_sql(c)}, CASE WHEN regexp_full_match({first}, 'remote|onsite|hybrid|anywhere|global|worldwide') THEN 'remote' ELSE regexp_replace({first}, '[^a-z0-9]', '', 'g') END) END"


FINGERPRINT = rf"left(sha256({_plain_sql('title')} || '|' || {_plain_sql(f'regexp_replace(coalesce(company, {sql_literal("")}), {re2(keys.LEGAL_WORDS)}, {sql_literal("")}, {sql_literal("g")})')} || '|' || {_country_key_sql('location')}), 16)"


def key02_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.col("location")
    return jobs(spark, sf_dir).groupBy("location").agg(F.count("*").alias("n")).select(F.coalesce(loc, F.lit("-")).alias("place"), keys.country(loc).alias("country"), keys.country_key(loc).alias("country_key"), keys.city(loc).alias("city"), "n")


def key03_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("company")
    named = {"discovery": keys.discovery_company(c), "ingestion": keys.ingestion_company(c), "service": keys.service_company(c), "scraper": keys.scraper_company(c)}
    return jobs(spark, sf_dir).select("id", *[v.alias(k) for k, v in named.items()])


def str_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    texts = {"stripped": text.strip_html(h), "decoded_first": text.strip_html_decoding_first(h), "spaced": text.tags_to_spaces(h)}
    return table(spark, sf_dir, "pages").select("page_id", *[F.md5(v).alias(k) for k, v in texts.items()])


def _collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _replaced(c: str, pairs: tuple) -> str:
    for name, char in pairs:
        c = f"replace({c}, {sql_literal(name)}, {sql_literal(char)})"
    return c


HTML = f"""SELECT page_id, md5({_collapse(_replaced("regexp_replace(html, '<[^>]+>', '', 'g')", text.ENTITIES))}) AS stripped,
  md5({_collapse(f"regexp_replace({_replaced('html', text.DECODED_FIRST)}, '<[^>]+>', ' ', 'g')")}) AS decoded_first,
  md5({_collapse("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) AS spaced FROM pages"""


def str_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(text.strip_noise(d)).alias("without_noise"),
        F.md5(text.truncate(d, 100)).alias("head"),
        F.md5(text.excerpt(d, 50, 200)).alias("excerpt"),
        text.name_parts(F.split_part(d, F.lit("\n"), F.lit(1)))["first"].alias("first_name"),
        F.length(text.name_parts(F.split_part(d, F.lit("\n"), F.lit(1)))["last"]).cast("long").alias("last_chars"),
    )


TEXT = rf"""SELECT doc_id, md5({_collapse(f"regexp_replace(text, {re2(text.NOISE)}, ' ', 'g')")}) AS without_noise, md5(left(text, 100)) AS head,
  md5(CASE WHEN length(text) <= 250 THEN text ELSE left(text, 50) || chr(10) || '...' || chr(10) || right(text, 200) END) AS excerpt,
  split_part({_collapse("lower(split_part(text, chr(10), 1))")}, ' ', 1) AS first_name,
  CAST(length(array_to_string(string_split({_collapse("lower(split_part(text, chr(10), 1))")}, ' ')[2:], '')) AS BIGINT) AS last_chars FROM documents"""


def str15_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases over part types and brands next to known names."""
    names = (*text.SKILL_ALIASES, "Cobol", " K8s ", "GoLang", "")
    raw = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), text.canonical_skill(raw).alias("skill"), text.skill_category(F.element_at(F.array(F.lit("language"), F.lit("Cloud"), F.lit("x")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("category"))


_NAMES = (*text.SKILL_ALIASES, "Cobol", " K8s ", "GoLang", "")
SKILLS = f"""WITH r AS (SELECT p_partkey, ([{', '.join(map(sql_literal, _NAMES))}])[p_partkey % {len(_NAMES)} + 1] AS raw FROM part),
a(alias, name) AS (VALUES {', '.join(f'({sql_literal(k)}, {sql_literal(v)})' for k, v in text.SKILL_ALIASES.items())})
SELECT p_partkey, raw, CASE WHEN trim(raw) = '' THEN raw ELSE coalesce(a.name, trim(raw)) END AS skill, (['LANGUAGE', 'CLOUD', 'TOOL'])[p_partkey % 3 + 1] AS category
FROM r LEFT JOIN a ON a.alias = lower(trim(raw))"""


def url01_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Careers URLs on known systems, made from page numbers."""
    url = _urls()
    found = urls.system_from_url(url)
    return table(spark, sf_dir, "pages").select("page_id", url.alias("careers"), found["ats"].alias("ats"), found["slug"].alias("slug"), urls.host(url).alias("host"))


_PARTS = (("https://boards.greenhouse.io/co", "/jobs/1"), ("https://boards-api.greenhouse.io/v1/boards/co", ""), ("https://co", ".greenhouse.io"), ("https://jobs.eu.lever.co/co", ""), ("https://jobs.lever.co/co", "/x?y=1"), ("http://jobs.ashbyhq.com/co", ""), ("https://co", ".wd3.myworkdayjobs.com/careers"), ("https://co", ".pinpointhq.com"), ("https://www.stepstone.de/jobs/co", ""), ("https://www.co", ".example.com/jobs"))


def _urls():
    k = (F.col("page_id") % len(_PARTS) + 1).cast("int")
    head, tail = (F.element_at(F.array(*[F.lit(p[j]) for p in _PARTS]), k) for j in (0, 1))
    return F.concat(head, F.col("page_id").cast("string"), tail)


def _whole(pattern: str) -> str:
    return sql_literal(pattern)


_NO_LOOKAHEAD = [(a, p.replace("(?!boards)", ""), n) for a, p, n in urls.URL_PATTERNS]
_CARES = f"([{', '.join(sql_literal(p[0]) for p in _PARTS)}])[page_id % {len(_PARTS)} + 1] || page_id || ([{', '.join(sql_literal(p[1]) for p in _PARTS)}])[page_id % {len(_PARTS)} + 1]"
_MATCHES = [(a, f"regexp_full_match(careers, {_whole(p)})" + (" AND NOT starts_with(regexp_replace(careers, '^https?://', ''), 'boards')" if "(?!" in q else ""), f"regexp_extract(careers, {_whole('^(?:' + p + ')$')}, 1)" if n else "NULL") for (a, p, n), (_, q, _) in zip(_NO_LOOKAHEAD, urls.URL_PATTERNS, strict=True)]
SYSTEMS = f"""WITH u AS (SELECT page_id, {_CARES} AS careers FROM pages)
SELECT page_id, careers, CASE {' '.join(f"WHEN {m} THEN '{a}'" for a, m, _ in _MATCHES)} END AS ats, CASE {' '.join(f'WHEN {m} THEN {s}' for _, m, s in _MATCHES)} END AS slug,
  regexp_replace(lower(regexp_extract(careers, '://([^/?#]+)', 1)), '^www\\.', '') AS host FROM u"""


def dat_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date parsers over texts written from order dates and keys."""
    d, k, as_of = F.col("o_orderdate"), F.col("o_orderkey"), F.lit("2024-03-31").cast("date")
    iso = F.concat(F.date_format(d, "yyyy-MM-dd"), F.when(k % 2 == 0, "T23:30:00+05:00").otherwise(""))
    ago = F.element_at(F.array(*[F.lit(x) for x in ("Posted Today", "Posted Yesterday", "Posted 30+ Days Ago")]), (k % 3 + 1).cast("int"))
    days = F.concat(F.lit("Posted "), (k % 29 + 1).cast("string"), F.lit(" Days Ago"))
    rel = F.concat((k % 9 + 1).cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("hours", "days", "weeks")]), (k % 3 + 1).cast("int")), F.lit(" ago"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.iso_date(iso).alias("iso"),
        text.epoch_date(F.unix_timestamp(d)).alias("epoch_s"),
        text.epoch_date(F.unix_timestamp(d) * 1000, "ms").alias("epoch_ms"),
        text.rfc1123_date(F.date_format(d, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("rfc1123"),
        text.posted_ago(F.when(k % 2 == 0, days).otherwise(ago), as_of).alias("posted"),
        text.relative_date(rel, as_of).alias("relative"),
        text.salary(F.concat(F.lit(" "), F.format_number("o_totalprice", 2))).cast("double").alias("salary"),
        text.iso_date(F.lit("not a date")).alias("no_date"),
    )


DATES = f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS epoch_s, CAST(o_orderdate AS DATE) AS epoch_ms, CAST(o_orderdate AS DATE) AS rfc1123,
  CASE WHEN o_orderkey % 2 = 0 THEN {A} - CAST(o_orderkey % 29 + 1 AS INTEGER) ELSE {A} - ([0, 1, 30])[o_orderkey % 3 + 1] END AS posted,
  {A} - CAST((o_orderkey % 9 + 1) * ([0, 1, 7])[o_orderkey % 3 + 1] AS INTEGER) AS relative, round(o_totalprice, 2) AS salary, CAST(NULL AS DATE) AS no_date FROM orders"""


def arr01_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON path with a null for what isn't there."""
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "string").alias("missing"))


JSON = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events"

QUERIES = {f.__name__: f for f in (key01_fingerprint, key02_country, key03_companies, str_html, str_text, str15_skills, url01_systems, dat_dates, arr01_json)}
SQL = {
    "key01_fingerprint": f"WITH {JOBS} SELECT id, {FINGERPRINT} AS fingerprint FROM jobs",
    "key02_country": rf"""WITH {JOBS}, p AS (SELECT location, count(*) AS n FROM jobs GROUP BY location),
c AS (SELECT *, trim(split_part(replace(replace(trim(regexp_replace(location, '(?i)\s*\(.*\)\s*$', '')), '>', ','), '/', ','), ',', 1)) AS first FROM p)
SELECT coalesce(location, '-') AS place, {_country_sql('location')} AS country, {_country_key_sql('location')} AS country_key,
  CASE WHEN length(first) > 2 AND lower(first) NOT IN ({', '.join(map(sql_literal, keys.NOT_CITIES))}) THEN first END AS city, n FROM c""",
    "key03_companies": rf"""WITH {JOBS} SELECT id,
  trim(lower(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(trim(company), ''), {re2(keys.LEGAL_SUFFIX)}, ''), {re2(keys.COUNTRY_SUFFIX)}, ''), {re2(keys.LEGAL_SUFFIX)}, '')), '\s+', ' ', 'g'))) AS discovery,
  {_plain_sql('company')} AS ingestion, trim(lower(regexp_replace(coalesce(company, ''), {re2(keys.SERVICE_SUFFIX)}, ''))) AS service,
  regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]', '', 'g') AS scraper FROM jobs""",
    "str_html": HTML,
    "str_text": TEXT,
    "str15_skills": SKILLS,
    "url01_systems": SYSTEMS,
    "dat_dates": DATES,
    "arr01_json": JSON,
}
