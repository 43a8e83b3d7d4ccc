"""Queries that join names, cut listings into blocks and resolve places over a table of cities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import geo
from millrace.functions.dialect import re2, sql_literal
from millrace.operators import containment, places
from millrace.plans import bindings as b
from millrace.session import table
from millrace.sources import blocks

_AS_OF = "2024-03-01"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The own names of pages' hosts as companies."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"([A-Za-z]+)\.example\.", 1).alias("company"))


def join10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies against the postings' whole titles, whichever holds the other; pairs of names, with their rows counted."""
    companies, jobs = _hosts(spark, sf_dir), b.jobs(spark, sf_dir).select("id", "title")
    pairs = containment.containing_names(companies, jobs, "company", "title", counted=("n_company", "n_title"))
    return pairs.select("company", F.md5("title").alias("title"), "n_company", "n_title")


def join10_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and parts' names against the postings' companies, row by row; postings without a company stay."""
    firms = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("firm_id"), F.concat(F.element_at(F.array(F.lit("SAP"), F.lit("Deutsche Bank AG Berlin"), F.lit("acme"), F.lit("G"), F.lit("Stripe"), F.lit("Nation")), (F.col("n_nationkey") % 6 + 1).cast("int")), F.when(F.col("n_nationkey") > 11, F.concat(F.lit(" "), F.col("n_nationkey"))).otherwise("")).alias("firm"))
    jobs = b.jobs(spark, sf_dir).select("id", "company")
    return containment.containment_join(firms, jobs, "firm", "company", keep_unnamed=True).select("id", "firm_id")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured reply for each posting: its whole text stands in the first of two blocks."""
    k = F.col("id")
    first, second = F.concat(F.lit("Role A"), k), F.concat(F.lit("Role B"), k)
    lines = F.concat_ws("\n", F.lit("2 results"), first, F.concat(F.lit(" Firm "), k % 5), F.when(k % 3 == 0, F.lit("Promoted")).otherwise(F.lit("Berlin (Hybrid)")), F.coalesce("description", F.lit("")), F.concat(F.lit("Posted "), k % 9 + 1, F.lit(" days ago")), F.lit("3 weeks ago"), second, F.lit(""), F.lit("Actively reviewing"), first)
    ref = lambda kind, text, url: F.struct(F.lit(kind).alias("kind"), text.alias("text"), url.alias("url"))
    refs = F.array(ref("job", first, F.concat(F.lit("/jobs/view/"), k, F.lit("/?x=1"))), ref("person", F.lit("Ann"), F.lit("/in/ann")), ref("job", second, F.concat(F.lit("/x/"), k)), ref("job", F.lit("Not in the text"), F.concat(F.lit("/jobs/view/0"), k)))
    payload = F.struct(F.array(k.cast("string")).alias("job_ids"), F.struct(refs.alias("search_results")).alias("references"), F.struct(lines.alias("search_results")).alias("sections"))
    return b.jobs(spark, sf_dir).select("id", F.to_json(payload).alias("payload"), lines.alias("text"))


def src39_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts between title lines."""
    found = blocks.structured_listing(_listings(spark, sf_dir), "id", F.lit(_AS_OF).cast("date"))
    return found.select("id", "position", "external_id", "title", "company_name", "location", "posted_date", F.md5("description").alias("description"))


def src44_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies above places of work, titles above them, in texts that hold whole documents."""
    k = F.col("id")
    text = F.concat_ws("\n", F.lit("2 results"), F.concat(F.lit("Role "), k), F.concat(F.lit("Role "), k, F.lit(" with verification")), F.concat(F.lit("Firm "), k % 7), F.lit("Ulm (On-site)"), F.coalesce("description", F.lit("")), F.concat(F.lit("Last "), k % 4), F.lit("Graz (Remote)"), F.lit("Set alert"), F.lit("(Hybrid)"))
    found = blocks.placed_companies(b.jobs(spark, sf_dir).select("id", text.alias("text")), "id")
    return found.select("id", "company", F.md5("title").alias("title"))


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the postings' texts as cities: a dictionary that grows with them. Some have two codes."""
    words = b.jobs(spark, sf_dir).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"\p{L}{6,}"), 0))).alias("city")).distinct()
    code = lambda shift: F.element_at(F.array(*map(F.lit, geo.CODES)), F.pmod(F.length("city") * 7 + F.ascii(F.right("city", F.lit(1))) + shift, F.lit(len(geo.CODES))) + 1)
    two = F.array(F.struct(F.lit(1).alias("nth"), code(0).alias("iso")), F.struct(F.lit(2).alias("nth"), code(3).alias("iso")))
    return words.select("city", F.explode(F.when(F.length("city") % 2 == 0, two).otherwise(F.slice(two, 1, 1))).alias("x")).select("city", "x.nth", "x.iso")


def geo01_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings' whole titles as locations, with a home pattern of a profile, over a dictionary of words."""
    rows = b.jobs(spark, sf_dir).select("id", F.regexp_replace("title", r"[. ]+", ", ").alias("place"))
    return places.resolve_places(rows, "place", _cities(spark, sf_dir), (r"\bthing\b", "keit,")).select("id", "iso")


QUERIES = {f.__name__: f for f in (join10_containment, join10_rows, src39_blocks, src44_companies, geo01_dictionary)}
_TRIM = "regexp_replace({}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
_BODY = f"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_TRIM.format('x')}), chr(10))"
_CODE = ", ".join(map(sql_literal, geo.CODES))
_TARGETS = ", ".join(map(sql_literal, geo.TARGETS))
_NAMED = " ".join(f"WHEN regexp_matches(low, {re2(chr(92) + 'b' + n.replace('.', chr(92) + '.') + chr(92) + 'b', False)}) THEN '{geo.COUNTRY_NAMES[n]}'" for n in sorted(geo.COUNTRY_NAMES, key=lambda n: (-len(n), n)))
SQL = {
    "join10_containment": f"""WITH c AS (SELECT lower(regexp_extract(url, '([A-Za-z]+)\\.example\\.', 1)) AS company, count(*) AS n_company FROM pages GROUP BY 1),
t AS (SELECT lower({_TRIM.format("split_part(text, chr(10), 1)")}) AS title, count(*) AS n_title FROM documents GROUP BY 1)
SELECT company, md5(title) AS title, n_company, n_title FROM c, t WHERE company <> '' AND title <> '' AND (contains(title, company) OR contains(company, title))""",
    "join10_rows": f"""WITH {b.JOBS}, f AS (SELECT n_nationkey AS firm_id, lower((['SAP', 'Deutsche Bank AG Berlin', 'acme', 'G', 'Stripe', 'Nation'])[n_nationkey % 6 + 1] || CASE WHEN n_nationkey > 11 THEN ' ' || n_nationkey ELSE '' END) AS firm FROM nation)
SELECT id, firm_id FROM jobs JOIN f ON contains(firm, lower(company)) OR contains(lower(company), firm) UNION ALL SELECT id, NULL FROM jobs WHERE company IS NULL""",
    "src39_blocks": f"""WITH d AS (SELECT doc_id AS id, {_BODY} AS body FROM documents), r AS (
SELECT id, 0 AS position, CAST(id AS VARCHAR) AS external_id, 'Role A' || id AS title, 'Firm ' || id % 5 AS company_name, CASE WHEN id % 3 <> 0 THEN 'Berlin (Hybrid)' END AS location, DATE '{_AS_OF}' - CAST(id % 9 + 1 AS INTEGER) AS posted_date,
  md5('Firm ' || id % 5 || chr(10) || CASE WHEN id % 3 = 0 THEN 'Promoted' ELSE 'Berlin (Hybrid)' END || chr(10) || body || chr(10) || 'Posted ' || (id % 9 + 1) || ' days ago' || chr(10) || '3 weeks ago') AS description FROM d
UNION ALL SELECT id, 2, '/x/' || id, 'Role B' || id, NULL, NULL, NULL, md5(chr(10) || 'Actively reviewing' || chr(10) || 'Role A' || id) FROM d
UNION ALL SELECT id, 3, '0' || id, 'Not in the text', NULL, NULL, NULL, NULL FROM d) SELECT * FROM r""",
    "src44_companies": f"""WITH d AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
SELECT id, 'Firm ' || id % 7 AS company, md5('Role ' || id) AS title FROM d UNION ALL SELECT id, 'Last ' || id % 4, md5({_TRIM.format('ls[len(ls)]')}) FROM d""",
    "geo01_dictionary": f"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) AS city FROM documents),
cities AS (SELECT city, len(city) * 7 + ascii(right(city, 1)) AS h, len(city) % 2 = 0 AS two FROM w WHERE len(city) > 5),
coded AS (SELECT city, ([{_CODE}])[h % {len(geo.CODES)} + 1] AS a, CASE WHEN two THEN ([{_CODE}])[(h + 3) % {len(geo.CODES)} + 1] END AS z FROM cities),
lists AS (SELECT city, CASE WHEN z IS NULL THEN [a] ELSE [a, z] END AS codes FROM coded),
best AS (SELECT city, CASE WHEN len(list_filter(codes, lambda c: c IN ({_TARGETS}))) > 0
    THEN coalesce(list_filter(codes, lambda c: c IN ({_TARGETS}) AND c <> '{geo.EXEMPT}')[1], list_filter(codes, lambda c: c IN ({_TARGETS}))[1])
    ELSE coalesce(list_filter([{', '.join(map(sql_literal, geo.PRIORITY))}], lambda p: list_contains(codes, p))[1], codes[1]) END AS iso FROM lists),
p AS (SELECT doc_id AS id, regexp_replace(split_part(text, chr(10), 1), '[. ]+', ', ', 'g') AS place FROM documents),
l AS (SELECT id, place, lower(place) AS low, {_TRIM.format('place')} AS bare, regexp_extract_all(place, '(?:^|[,\\s])([A-Z]{{2}})(?:$|[,\\s])', 1) AS tokens FROM p),
e AS (SELECT id, low, CASE WHEN regexp_matches(low, {re2(r'\bthing\b')}) OR contains(low, 'keit,') THEN 'DE' {_NAMED}
    WHEN len(bare) = 2 AND upper(bare) IN ({_CODE}) THEN upper(bare) WHEN len(bare) = 2 AND upper(bare) = 'UK' THEN 'GB'
    ELSE list_filter(list_transform(tokens, lambda t: CASE WHEN t = 'UK' THEN 'GB' WHEN t IN ({_CODE}) THEN t END), lambda t: t IS NOT NULL)[1] END AS iso FROM l),
s AS (SELECT id, unnest(list_transform(string_split(low, ','), lambda x: trim(x))) AS s, unnest(range(len(string_split(low, ',')))) AS i FROM e WHERE iso IS NULL),
t AS (SELECT id, i, 0 AS j, s AS city FROM s UNION ALL SELECT id, i, 1, unnest(list_filter(regexp_split_to_array(s, '\\s*-\\s*'), lambda p: len(p) >= 3)) FROM s WHERE contains(s, '-')
  UNION ALL SELECT id, i, 2, regexp_extract(s, '^(\\S+)', 1) FROM s WHERE regexp_matches(s, '^\\S{{3,}}\\s')),
f AS (SELECT id, arg_min(best.iso, (i, j)) AS iso FROM t JOIN best ON best.city = t.city GROUP BY id)
SELECT e.id, coalesce(e.iso, f.iso) AS iso FROM e LEFT JOIN f ON f.id = e.id""",
}
