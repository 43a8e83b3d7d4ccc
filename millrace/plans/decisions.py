"""Queries of the filter cascade, scores and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dialect import any_of, re2, sql_literal
from millrace.operators import filters, postings, scoring, search
from millrace.plans.bindings import COMPANIES, JOBS, PROFILE, SQL_COMPANIES, companies, jobs
from millrace.functions import keys, text
from millrace.plans.scalars import FINGERPRINT, _collapse, _replaced
from millrace.session import table

R, S = PROFILE.filters, PROFILE.scoring
NAMES = {"de": "German", "es": "Spanish", "fr": "French"}


def flt01_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.cascade(jobs(spark, sf_dir), R, columns=["id"]).select("id", F.col("decision"), "reason", "visa", F.col("yoe").cast("long").alias("yoe"), "country_iso")


def _strict(c: str) -> str:
    """Every place where a demand begins is tried, with a softening phrase looked for at every place before it."""
    demand, soft = re2("^(?:" + any_of(R.language_exclude) + ")"), re2("^(?:" + any_of(R.language_soft) + ")")
    return f"""SELECT id FROM (SELECT id, {c} AS t, unnest(range(1, CAST(length({c}) + 1 AS BIGINT))) AS i FROM jobs)
  WHERE regexp_matches(substr(t, i, 60), {demand}) AND NOT list_bool_or([regexp_matches(substr(t, j, 60), {soft}) FOR j IN range(greatest(1, i - {R.soft_window}), i)])"""


def _role_reason() -> str:
    return f"CASE WHEN trim(title) = '' THEN NULL WHEN regexp_matches(title, {re2(any_of([chr(92) + 'b' + p + chr(92) + 'b' for p in R.role_exclude]))}) THEN 'role: excluded' WHEN NOT regexp_matches(title, {re2(any_of(R.role_include))}) THEN 'role: not relevant' END"


#: What each place of the bindings is, by hand.
_ISO = {"Berlin, Germany": "DE", "Amsterdam, NL": "NL", "Vienna": "AT", "Paris, France": "FR", "London": "GB", "Kraków": "PL", "Springfield; US": "US", "Zürich (Hybrid)": "CH", "Hamburg, HH, De": "DE"}
_PLACED = f"CASE location {' '.join(f'WHEN {sql_literal(p)} THEN {sql_literal(i)}' for p, i in _ISO.items())} END"
_LOCATION = f"""CASE WHEN trim(coalesce(location, '')) = '' THEN 'location: blank' WHEN regexp_matches(trim(location), {re2(any_of(R.remote))}) THEN NULL
  WHEN iso IN ('DE', 'NL', 'AT', 'CH', 'IE', 'SE', 'DK', 'FI', 'ES') THEN NULL WHEN iso IS NOT NULL THEN 'location: ' || iso || ' not a target country' ELSE 'location: not in target locations' END"""
_YEARS = "greatest(" + ", ".join(f"list_max(list_filter(list_transform(regexp_extract_all(description, {re2(p)}, 1), lambda x: TRY_CAST(x AS INTEGER)), lambda n: n <= 20))" for p in filters.YEARS) + ")"
_STRIPPED = "regexp_replace(description, '<[^>]+>', '', 'g')"
_READABLE = _collapse(f"regexp_replace({_collapse(_replaced(_STRIPPED, text.ENTITIES))}, {re2(text.NOISE)}, ' ', 'g')")
_AT = "{'d': discovered_date, 'i': id, 's': source}"
CASCADE = f"""WITH {JOBS}, strict AS ({_strict("title || ' ' || description")}),
j AS (SELECT *, {_PLACED} AS iso, {FINGERPRINT} AS fingerprint, length({_READABLE}) AS readable, CAST({_YEARS} AS BIGINT) AS yoe FROM jobs),
k AS (SELECT *, CASE WHEN trim(coalesce(location, '')) = '' THEN NULL WHEN regexp_matches(trim(location), {re2(any_of(R.remote))}) THEN 'REMOTE_EU' ELSE iso END AS country_iso FROM j),
v AS (SELECT *, CASE WHEN country_iso = 'DE' THEN 'UNKNOWN' WHEN is_aggregator AND length(description) < {R.visa_least_chars} THEN 'PENDING'
  WHEN regexp_matches(description, {re2(any_of(R.visa_negative))}) THEN 'REJECTED' WHEN regexp_matches(description, {re2(any_of(R.visa_positive))}) THEN 'CONFIRMED' ELSE 'UNKNOWN' END AS visa FROM k),
r AS (SELECT *, coalesce(CASE WHEN id IN (SELECT id FROM strict) THEN 'non-English language required' WHEN lang <> 'en' AND length(description) >= 100 AND readable >= 100 THEN 'non-English JD (' || CASE lang {' '.join(f"WHEN '{k}' THEN '{n}'" for k, n in NAMES.items())} ELSE lang END || ')' END,
  {_role_reason()}, {_LOCATION}, CASE WHEN visa = 'REJECTED' THEN 'visa: sponsorship refused' WHEN visa = 'UNKNOWN' AND country_iso IS DISTINCT FROM 'DE' THEN 'visa: unclear' END,
  CASE WHEN yoe > {R.most_years} THEN 'requires ' || yoe || '+ years experience' END) AS reason FROM v),
f AS (SELECT fingerprint, arg_min({_AT}, (discovered_date, id)) FILTER (NOT is_aggregator) AS own, arg_min({_AT}, (discovered_date, id)) AS any_ FROM r WHERE reason IS NULL GROUP BY 1),
d AS (SELECT r.*, CASE WHEN reason IS NULL AND trim(coalesce(company, '')) <> '' THEN CASE WHEN is_aggregator THEN any_ ELSE own END END AS first_ FROM r LEFT JOIN f USING (fingerprint)),
e AS (SELECT *, CASE WHEN (first_.d, first_.i) < (discovered_date, id) THEN 'duplicate of ' || first_.s ELSE reason END AS why FROM d)
SELECT id, CASE WHEN why IS NULL THEN 'KEEP' ELSE 'SKIP' END AS decision, why AS reason, visa, yoe, country_iso FROM e"""


def flt13_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flt01_cascade(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("KEEP")).alias("reason")).agg(F.count("*").alias("n"))


def flt10_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of experience in sentences written from order keys."""
    k = F.col("o_orderkey")
    asked = F.concat((k % 25).cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("+ years of experience", " years experience in Java", "+ yrs, but we care", " years as an engineer; 3+ years.", " apples")]), (k % 5 + 1).cast("int")))
    years = filters.years(asked)
    return table(spark, sf_dir, "orders").select("o_orderkey", years.cast("long").alias("yoe"), filters.experience(years, R)["keep"].alias("keep"))


FLT10 = f"""WITH j AS (SELECT o_orderkey, CAST(o_orderkey % 25 AS VARCHAR) || (['+ years of experience', ' years experience in Java', '+ yrs, but we care', ' years as an engineer; 3+ years.', ' apples'])[o_orderkey % 5 + 1] AS description FROM orders),
y AS (SELECT o_orderkey, CAST({_YEARS} AS BIGINT) AS yoe FROM j) SELECT o_orderkey, yoe, coalesce(yoe <= {R.most_years}, true) AS keep FROM y"""


def _matched(df: DataFrame) -> DataFrame:
    return scoring.with_match(df, S)


def sco01_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("match")
    return _matched(jobs(spark, sf_dir)).select("id", m["score"].cast("long").alias("score"), F.array_join(m["matched"], ",").alias("matched"), F.array_join(m["missing"], ",").alias("missing"), m["recommendation"].alias("recommendation"))


def _hit(s) -> str:
    return f"regexp_matches(t, {re2(any_of(s.variants))})" if s.variants else f"contains(t, {sql_literal(s.name.lower())})"


_BONUS = f"regexp_matches(t, {re2(any_of([chr(92) + 'b' + p + chr(92) + 'b' for p in S.bonus_signals]))})"
_ROUND = "CAST(floor({} + 0.5) AS BIGINT)"
MATCHES = f"""t AS (SELECT *, lower(title || ' ' || description) AS t, lower(title) AS low FROM jobs),
h AS (SELECT *, list_filter([{', '.join(f'CASE WHEN {_hit(s)} THEN {sql_literal(s.name)} END' for s in S.skills)}, CASE WHEN {_BONUS} THEN 'AI/ML' END], lambda x: x IS NOT NULL) AS matched,
  list_filter([{', '.join(f'CASE WHEN NOT {_hit(s)} THEN {sql_literal(s.name)} END' for s in S.skills)}], lambda x: x IS NOT NULL) AS missing,
  {' + '.join(f'CASE WHEN {_hit(s)} THEN {s.weight} ELSE 0 END' for s in S.skills)} + CASE WHEN {_BONUS} THEN {S.bonus_weight} ELSE 0 END AS earned FROM t),
s1 AS (SELECT *, greatest(0, least(100, {_ROUND.format(f'CAST(earned AS DOUBLE) / {S.benchmark_weight} * 100')})) AS a FROM h),
s2 AS (SELECT *, CASE WHEN regexp_matches(low, {re2(any_of(S.competing))}) THEN least(a, {S.competing_cap}) ELSE a END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN list_has_any(list_transform(matched, lambda x: lower(x)), [{', '.join(map(sql_literal, S.primary_skills))}]) THEN b ELSE least(b, {S.primary_cap}) END AS c FROM s2),
s4 AS (SELECT *, CASE WHEN {' OR '.join(f'contains(low, {sql_literal(w)})' for w in S.senior_words)} THEN {_ROUND.format(f'c * CAST({S.senior_multiplier} AS DOUBLE)')} ELSE c END AS d FROM s3),
matches AS (SELECT *, CASE WHEN trim(t) = '' THEN 0 ELSE d END AS score,
  CASE WHEN d >= {S.apply_score} AND len(matched) >= {S.apply_matches} THEN 'APPLY' WHEN d >= {S.maybe_score} AND len(matched) >= {S.maybe_matches} THEN 'MAYBE' ELSE 'SKIP' END AS recommendation FROM s4)"""


def _opportunity(df: DataFrame) -> DataFrame:
    c = F.col
    rate = F.when(c("id") % 4 == 0, None).otherwise((c("id") % 10).cast("double") / 10)
    factors = {
        "matchScore": c("match.score"),
        "interviewHistory": scoring.interview_factor(rate),
        "salary": scoring.salary_factor(c("salary_min"), c("salary_max"), S.target_salary),
        "companyQuality": scoring.company_factor(F.when(c("id") % 3 != 0, (c("id") % 120).cast("double"))),
        "seniority": scoring.seniority_factor(c("title")),
        "locationFit": scoring.location_factor(c("remote"), F.element_at(F.array(*map(F.lit, ("germany", "france", "US", ""))), (c("id") % 4 + 1).cast("int")), F.when(c("id") % 2 == 0, "CONFIRMED"), S.locations),
    }
    return df.withColumn("opportunity", scoring.opportunity(factors))


def sco02_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("opportunity")
    return _opportunity(_matched(jobs(spark, sf_dir))).select("id", o["score"].cast("long").alias("score"), *[o["breakdown"][k].cast("long").alias(k) for k in scoring.WEIGHTS])


_SENIOR = " ".join(f"WHEN {' OR '.join(f'contains(low, {sql_literal(w)})' for w in words)} THEN {n}" for words, n in ((("staff", "principal", "director", "vp", "head"), 90), (("senior", "sr", "lead"), 75), (("junior", "jr", "entry", "intern", "graduate"), 40)))
OPPORTUNITIES = f"""{MATCHES}, f AS (SELECT id, score AS m, is_aggregator, is_active, applied, hidden, decision, discovered_date, title, low, recommendation,
  CASE WHEN id % 4 = 0 OR id % 10 = 0 THEN 50 ELSE {_ROUND.format('20 + CAST(id % 10 AS DOUBLE) / 10 * 80')} END AS ih,
  CASE WHEN salary_max IS NULL AND salary_min IS NULL THEN 50 WHEN coalesce(salary_max, salary_min) / {S.target_salary} >= 1.3 THEN 100 WHEN coalesce(salary_max, salary_min) / {S.target_salary} >= 1.0 THEN 80 WHEN coalesce(salary_max, salary_min) / {S.target_salary} >= 0.85 THEN 60 WHEN coalesce(salary_max, salary_min) / {S.target_salary} >= 0.7 THEN 40 ELSE 20 END AS sa,
  CASE WHEN id % 3 <> 0 THEN least(100, id % 120) ELSE 50 END AS cq, CASE WHEN trim(title) = '' THEN 50 {_SENIOR} ELSE 60 END AS se,
  CASE WHEN remote = 'REMOTE' THEN 100 WHEN id % 4 = 3 THEN 50 WHEN id % 4 = 0 THEN 100 WHEN id % 4 = 1 THEN CASE WHEN id % 2 = 0 THEN 100 ELSE 70 END ELSE 30 END AS lf FROM matches),
opportunities AS (SELECT *, greatest(0, least(100, {_ROUND.format(' + '.join(f'CAST({c} AS DOUBLE) * CAST({w} AS DOUBLE)' for c, w in zip(('m', 'ih', 'sa', 'cq', 'se', 'lf'), scoring.WEIGHTS.values(), strict=True)))})) AS score FROM f)"""


def top_apply_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: visible, relevant postings, best first (a top-k report)."""
    shown = jobs(spark, sf_dir).where(search.visible()).where(filters.role(F.col("title"), R)["keep"])
    rows = _opportunity(_matched(shown)).where(F.col("match.recommendation") == "APPLY").select("id", "title", F.col("match.score").cast("long").alias("match_score"), F.col("opportunity.score").cast("long").alias("opportunity_score"))
    return search.page(rows, [F.desc("match_score"), F.desc("opportunity_score"), F.asc("id")], size=10)


def srt01_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search, by match, day of discovery and opportunity."""
    shown = search.search(jobs(spark, sf_dir), text="on")
    rows = _opportunity(_matched(shown)).withColumns({"match_score": F.col("match.score").cast("long"), "opportunity_score": F.col("opportunity.score").cast("long")})
    found = rows.where(F.col("match_score") >= 10)
    order = [F.desc_nulls_last("match_score"), F.desc_nulls_last("discovered_date"), F.desc_nulls_last("opportunity_score"), F.asc("id")]
    return search.page(found, order, number=1, size=20).select("id", "match_score", "discovered_date", "opportunity_score")


_VISIBLE = "is_active AND NOT applied AND NOT hidden AND decision = 'KEEP'"


def prd05_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    since, today = (F.lit(d).cast("date") for d in ("2024-02-20", "2024-03-01"))
    return jobs(spark, sf_dir).where(search.recently_posted(since, today) & search.visible()).select("id", "source")


def prd04_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).where(search.short_description(200)).select("id", F.length("description").cast("long").alias("chars"))


def scn03_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_prefix(jobs(spark, sf_dir).select("id", "source"), "id", "12")


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings whose company is their language and that stand nowhere, so that copies in several sources meet by their whole
    titles."""
    j = jobs(spark, sf_dir)
    return j.withColumn("fingerprint", keys.fingerprint(F.col("title"), F.col("lang"), F.lit(None).cast("string"))).withColumn("created_at", F.col("discovered_date"))


_FP = f"fp AS (SELECT * EXCLUDE (title), {FINGERPRINT} AS fingerprint FROM (SELECT * REPLACE (lang AS company, CAST(NULL AS VARCHAR) AS location) FROM jobs) r)"


_EARLIER = "CASE WHEN j.decision = 'KEEP' THEN (SELECT arg_min(o.source, (o.discovered_date, o.id)) FROM fp o WHERE o.{0} = j.{0} AND o.decision = 'KEEP' AND (j.is_aggregator OR NOT o.is_aggregator) AND (o.discovered_date, o.id) < (j.discovered_date, j.id)) END"


def ded02_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with the first one that it repeats, if any: by its fingerprint of whole title, company and place, and as a
    copy whoever posts it wherever."""
    c = F.col
    rows = _fingerprinted(spark, sf_dir).withColumns({"copied": c("fingerprint"), "fingerprint": keys.fingerprint(c("title"), c("company"), c("location"))})
    found = filters.duplicate_of_system(rows).withColumns({"repeats": c("duplicate_of"), "fingerprint": c("copied")})
    return filters.duplicate_of_system(found.drop("duplicate_of")).select("id", "source", c("repeats").alias("duplicate_of"), c("duplicate_of").alias("copy_of"))


def ded03_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprinted(spark, sf_dir).withColumn("apply_url", F.concat(F.lit("https://x/"), F.lpad(F.col("id").cast("string"), 9, "0")))
    links = postings.enrich_links(rows)
    return links.select("id", F.array_join(F.map_keys("external_links"), ",").alias("sources"), F.array_join(F.map_values("external_links"), ",").alias("urls"))


def ded04_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fingerprinted(spark, sf_dir).withColumn("reason", F.lit(None).cast("string"))
    return postings.supersede(rows).groupBy("source", "decision", "reason").agg(F.count("*").alias("n"))


def ded04_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superseding row by row: decisions, links in order of their sources, and the scores that stay."""
    url = F.when(F.col("id") % 6 != 0, F.concat(F.lit("https://x/"), F.col("id")))
    had = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("src0"), F.lit("old"), F.lit("zz"), F.lit("kept")))
    rows = _fingerprinted(spark, sf_dir).withColumns({"reason": F.lit(None).cast("string"), "apply_url": url, "external_links": had})
    scores = jobs(spark, sf_dir).where("id % 3 > 0").select("id", (F.col("id") % 101).alias("score"))
    done, left = postings.supersede_with_links(rows, scores)
    links = F.array_join(F.transform(F.array_sort(F.map_entries("external_links")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return done.join(left, "id", "left").select("id", "decision", "reason", links.alias("links"), "score")


def ded08_deactivate(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("id", F.col("source").alias("endpoint_id"), F.col("id").cast("string").alias("external_id"), "is_active", "applied")
    seen = j.where("id % 3 <> 0 AND endpoint_id <> 'src1'").select("endpoint_id", "external_id")
    return postings.deactivate_missing(j, seen).select("id", "is_active")


def ded01_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts of a batch against what was known; ids are coarse so that some repeat."""
    j = jobs(spark, sf_dir)
    batch = j.select("id", "source", F.when(F.col("id") % 23 == 0, "").otherwise((F.col("id") % 500).cast("string")).alias("external_id"))
    known = j.where("id % 10 = 0").select("source", (F.col("id") % 400).cast("string").alias("external_id"))
    return postings.ingestion_stats(postings.ingest_outcomes(batch, known, ["id"]))


def snk01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.select("c_custkey", "c_name", "c_acctbal")
    shifted = (F.col("c_custkey") * 2).alias("c_custkey")  # even keys; half of them are new
    new = c.select(shifted, F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return postings.upsert(old, new, ["c_custkey"])


def snk03_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return postings.insert_ignore(c, c.select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new "), F.col("c_name")).alias("c_name")), ["c_custkey"])


def snk05_delete_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    doomed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    left = postings.delete_where_in(o, doomed, ["o_orderkey"])
    return postings.purge(left, "day", F.lit("1998-01-01").cast("date"), 730, F.col("o_orderstatus") == "P")


def sco13_visa_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = companies(spark, sf_dir)
    return c.select("company_id", scoring.visa_friendliness(*[F.col(x) for x in ("has_sponsored_before", "english_speaking", "international_workforce")]).alias("friendliness"))


def sco10_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgency and priority from order keys."""
    k = F.col("o_orderkey")
    total = F.when(k % 7 != 0, k % 20)
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.urgency(total.cast("double"), (k % 31 - 5).cast("double")).alias("urgency"), scoring.contact_priority((k % 101).cast("double"), (k % 77).cast("double")).cast("long").alias("priority"), scoring.next_follow_up(F.to_date("o_orderdate"), k % 5).alias("next_day"))


QUERIES = {f.__name__: f for f in (top_apply_jobs, flt01_cascade, flt13_reasons, flt10_years, sco01_match, sco02_opportunity, srt01_search_page, prd05_recent, prd04_short, scn03_prefix, ded01_ingest, ded02_duplicates, ded03_enrich, ded04_supersede, ded04_links, ded08_deactivate, snk01_upsert, snk03_insert_ignore, snk05_delete_purge, sco13_visa_signals, sco10_actions)}
SQL = {
    "flt01_cascade": CASCADE,
    "flt13_reasons": f"SELECT coalesce(reason, 'KEEP') AS reason, count(*) AS n FROM ({CASCADE}) GROUP BY 1",
    "flt10_years": FLT10,
    "sco01_match": f"WITH {JOBS}, {MATCHES} SELECT id, score, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing, recommendation FROM matches",
    "sco02_opportunity": f'WITH {JOBS}, {OPPORTUNITIES} SELECT id, score, m AS "matchScore", ih AS "interviewHistory", CAST(sa AS BIGINT) AS salary, cq AS "companyQuality", CAST(se AS BIGINT) AS seniority, CAST(lf AS BIGINT) AS "locationFit" FROM opportunities',
    "top_apply_jobs": f"WITH {JOBS}, {OPPORTUNITIES} SELECT id, title, m AS match_score, score AS opportunity_score FROM opportunities WHERE {_VISIBLE} AND recommendation = 'APPLY' AND {_role_reason()} IS NULL ORDER BY 3 DESC, 4 DESC, 1 LIMIT 10",
    "srt01_search_page": f"""WITH {JOBS}, {OPPORTUNITIES} SELECT o.id, m AS match_score, o.discovered_date, score AS opportunity_score FROM opportunities o JOIN jobs USING (id)
WHERE o.is_active AND NOT o.applied AND NOT o.hidden AND o.decision = 'KEEP' AND m >= 10 AND (contains(lower(jobs.title), 'on') OR contains(lower(coalesce(company, '')), 'on') OR contains(lower(coalesce(location, '')), 'on')) ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 LIMIT 20 OFFSET 20""",
    "prd05_recent": f"WITH {JOBS} SELECT id, source FROM jobs WHERE {_VISIBLE} AND (posted_date >= DATE '2024-02-20' OR posted_date IS NULL AND NOT is_aggregator AND discovered_date >= DATE '2024-02-20' OR posted_date IS NULL AND is_aggregator AND discovered_date = DATE '2024-03-01')",
    "prd04_short": f"WITH {JOBS} SELECT id, length(description) AS chars FROM jobs WHERE description IS NULL OR length(description) < 200",
    "scn03_prefix": f"WITH {JOBS} SELECT id, source FROM jobs WHERE starts_with(CAST(id AS VARCHAR), '12') ORDER BY id LIMIT 1",
    "ded01_ingest": f"""WITH {JOBS}, b AS (SELECT id, source, CASE WHEN id % 23 = 0 THEN '' ELSE CAST(id % 500 AS VARCHAR) END AS e FROM jobs), k AS (SELECT DISTINCT source, CAST(id % 400 AS VARCHAR) AS e FROM jobs WHERE id % 10 = 0),
o AS (SELECT b.source, CASE WHEN b.e = '' THEN 'error' WHEN k.e IS NOT NULL OR row_number() OVER (PARTITION BY b.source, b.e ORDER BY id) > 1 THEN 'duplicate' ELSE 'created' END AS o FROM b LEFT JOIN k USING (source, e))
SELECT source, count(*) FILTER (o = 'created') AS created, CAST(0 AS BIGINT) AS enriched, count(*) FILTER (o = 'duplicate') AS duplicate, count(*) FILTER (o = 'error') AS error FROM o GROUP BY source""",
    "ded02_duplicates": f"""WITH {JOBS}, own AS (SELECT *, {FINGERPRINT} AS own_fingerprint FROM jobs), {_FP.replace("FROM jobs", "FROM own")}
SELECT j.id, j.source, {_EARLIER.format("own_fingerprint")} AS duplicate_of, {_EARLIER.format("fingerprint")} AS copy_of FROM fp j""",
    "ded03_enrich": f"""WITH {JOBS}, {_FP}, n AS (SELECT * FROM fp WHERE NOT is_aggregator AND is_active QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY discovered_date DESC, id DESC) = 1),
l AS (SELECT fingerprint, source, min('https://x/' || lpad(CAST(id AS VARCHAR), 9, '0')) AS url FROM fp WHERE is_aggregator GROUP BY 1, 2)
SELECT n.id, string_agg(l.source, ',' ORDER BY l.source) AS sources, string_agg(l.url, ',' ORDER BY l.source) AS urls FROM n JOIN l USING (fingerprint) GROUP BY n.id""",
    "ded04_supersede": f"""WITH {JOBS}, {_FP}, o AS (SELECT DISTINCT fingerprint FROM fp WHERE decision = 'KEEP' AND NOT is_aggregator), m AS (SELECT source, decision, decision = 'KEEP' AND is_aggregator AND fingerprint IN (SELECT fingerprint FROM o) AS loses FROM fp)
SELECT source, CASE WHEN loses THEN 'SKIP' ELSE decision END AS decision, CASE WHEN loses THEN 'superseded by endpoint' END AS reason, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "ded08_deactivate": f"WITH {JOBS} SELECT id, is_active AND NOT (NOT applied AND source <> 'src1' AND id % 3 = 0) AS is_active FROM jobs",
    "ded04_links": f"""WITH {JOBS}, {_FP}, o AS (SELECT fingerprint, min(ROW(discovered_date, id)) AS first FROM fp WHERE decision = 'KEEP' AND NOT is_aggregator GROUP BY 1),
m AS (SELECT fp.id, fp.source, fp.discovered_date, fp.decision, fp.fingerprint, CASE WHEN fp.id % 6 <> 0 THEN 'https://x/' || fp.id END AS url, o.first, coalesce(fp.decision = 'KEEP' AND fp.is_aggregator AND o.first IS NOT NULL, false) AS loses FROM fp LEFT JOIN o ON o.fingerprint = fp.fingerprint),
l AS (SELECT fingerprint, source, arg_max(url, (discovered_date, id)) AS url FROM m WHERE loses AND url IS NOT NULL GROUP BY ALL),
h AS (SELECT id, 'src0' AS source, 'old' AS url, 0 AS new FROM fp WHERE id % 4 = 0 UNION ALL SELECT id, 'zz', 'kept', 0 FROM fp WHERE id % 4 = 0
  UNION ALL SELECT m.id, l.source, l.url, 1 FROM m JOIN l ON l.fingerprint = m.fingerprint WHERE m.first = ROW(m.discovered_date, m.id) AND m.decision = 'KEEP'),
g AS (SELECT id, string_agg(source || '=' || url, ',' ORDER BY source) AS links FROM (SELECT id, source, arg_max(url, new) AS url FROM h GROUP BY ALL) x GROUP BY id)
SELECT m.id, CASE WHEN loses THEN 'SKIP' ELSE decision END AS decision, CASE WHEN loses THEN 'superseded by endpoint' END AS reason, g.links, CASE WHEN m.id % 3 > 0 AND NOT loses THEN m.id % 101 END AS score FROM m LEFT JOIN g ON g.id = m.id""",
    "snk01_upsert": """WITH n AS (SELECT c_custkey * 2 AS c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN upper(c_name) END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer)
SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM customer o FULL JOIN n ON n.c_custkey = o.c_custkey""",
    "snk03_insert_ignore": "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey * 2, 'new ' || c_name FROM customer WHERE c_custkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "snk05_delete_purge": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND (CAST(o_orderdate AS DATE) >= DATE '1998-01-01' - 730 OR o_orderstatus = 'P')",
    "sco13_visa_signals": f"WITH {SQL_COMPANIES} SELECT company_id, CASE WHEN has_sponsored_before IS NULL THEN 'UNKNOWN' ELSE (['LOW', 'MEDIUM', 'MEDIUM', 'HIGH'])[CAST(has_sponsored_before AS INTEGER) + CAST(english_speaking AS INTEGER) + CAST(international_workforce AS INTEGER) + 1] END AS friendliness FROM companies",
    "sco10_actions": """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 20 AS t, o_orderkey % 31 - 5 AS r, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k AS o_orderkey, CAST(CASE WHEN k % 7 = 0 THEN 1.0 WHEN r < 0 OR t <= 0 THEN 1.2 ELSE greatest(0.0, least(1.5, 1 - CAST(r AS DOUBLE) / t)) END AS DOUBLE) AS urgency, CAST(trunc(CAST(0.6 AS DOUBLE) * (k % 101) + CAST(0.4 AS DOUBLE) * (k % 77)) AS BIGINT) AS priority,
  CASE WHEN k % 5 < 3 THEN d + ([7, 7, 14])[k % 5 + 1] END AS next_day FROM a""",
}
