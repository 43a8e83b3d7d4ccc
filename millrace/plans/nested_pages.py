"""Queries of parts of pages, JSON-LD, posters and quoted text: each carries whole pages or whole texts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import ENTITIES
from millrace.functions.dialect import sql_literal
from millrace.plans import bindings as b
from millrace.session import table
from millrace.sources import documents, page_parts, posters

_Piece = Column | str


def _wrapped(k: Column, cases: list[tuple[_Piece, ...]], key: str = "html") -> Column:
    """Pages by k: each case's pieces in a row, of which None is the page itself."""
    made = [F.concat(*[F.col(key) if p is None else F.lit(p) for p in pieces]) for pieces in cases]
    out = F.when(k == 0, made[0])
    for n, m in enumerate(made[1:], 1):
        out = out.when(k == n, m)
    return out


_BLOCKS = [
    ('<main><section class="x rich-text-content y"><section>', None, "</section> the <b>ta</b>il</section><p>left out</p><section class='rich-text-content'></section><section class=\"rich-text-content\"><br>Second <i>block</i></section></main>"),
    ('<section class="jb-description-item"><u>Un</u>der ', None, '</section><section class="rich-text">left out</section>'),
    ("<section>", None, "</section>"),
    ('<section class="rich-text-content">too short</section>', None),
]
_DETAILS = [
    ('<section id="content">left out</section><section class="JobDescription">', None, "</section>"),
    ('<main>left out</main><section class="job-description b">', None, "</section>"),
    ('<section class="myJobDescriptionBox"><section>', None, "</section>end</section>"),
    ('<section class="contentWithSidePanel__content">', None, "</section>"),
    ('<section id="content">left out</section><main>', None, "</main>"),
    ("<section id='content'>", None, "</section>after"),
    (None, ""),
]


def src13_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions in blocks, with whole pages inside nested sections."""
    pages = table(spark, sf_dir, "pages").select("page_id", _wrapped(F.col("page_id") % 4, _BLOCKS).alias("html"))
    return page_parts.blocks_detail(pages).select("page_id", F.md5("description").alias("description"))


def src22_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions by six selectors in order; the feed itself keeps 10,000 characters."""
    pages = table(spark, sf_dir, "pages").select("page_id", _wrapped(F.col("page_id") % 7, _DETAILS).alias("html"))
    return page_parts.listing_detail(pages).select("page_id", F.md5("description").alias("description"), F.length("description").cast("long").alias("n_chars"))


def src22_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that whole pages say at their end, in three phrasings, as the offsets of further pages."""
    n = (F.col("page_id") * 7 % 130).cast("string")
    said = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<p aria-label="Results 1 to 25 of '), n, F.lit('">'))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("<p>Showing 1 to 25 of "), n)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("<p>Results <b>1</b> – <b>25</b> of <b>"), n, F.lit("</b>"))).otherwise(F.lit("<p>no totals"))
    return page_parts.page_offsets(table(spark, sf_dir, "pages").select("page_id", F.concat("html", said).alias("html"))).select("page_id", "offset")


def _ld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as pages with JSON-LD that holds their whole texts; the type and the shape depend on the id."""
    k = F.col("id")
    place = lambda city: F.struct(F.struct(F.lit(city).alias("addressLocality")).alias("address"))
    body = [F.concat(F.lit("Post "), k).alias("title"), F.struct(F.lit("Firm Two").alias("name")).alias("hiringOrganization"), F.col("description"), F.array(place("Ulm"), place(""), place("Bonn")).alias("jobLocation")]
    kind = lambda name: F.to_json(F.struct(F.lit(name).alias("@type"), *body))
    ld = F.when(k % 4 == 0, kind("JobPosting")).when(k % 4 == 1, kind("Article")).when(k % 4 == 2, F.to_json(F.struct(*body[2:3]))).otherwise(F.concat(F.lit('[{"@type": "Person"}, '), kind("JobPosting"), F.lit("]")))
    html = F.concat(F.lit("<html><head><title>Cook at sea at Firm "), k % 5, F.lit('</title><script>x</script><script type="application/ld+json">{broken</script><script type="application/ld+json">'), ld, F.lit("</script></head><body><h1>Head "), k, F.lit("</h1><p>40,000 – 55,500 €</p></body></html>"))
    return b.jobs(spark, sf_dir).select("id", html.alias("html"))


def arr04_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three readings of JSON-LD over whole texts, and the posting that a page gives."""
    pages = _ld_pages(spark, sf_dir).withColumn("_scripts", page_parts.ld_scripts(F.col("html")))
    read = [F.md5(page_parts.ld_description(F.col("html"), r, F.col("_scripts"))).alias(f"as_{r}") for r in ("typed", "any", "open")]
    return documents.posting_page(pages).select("id", *read, "title", "company_name", "location", F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"))


_POSTERS = (
    ("GREENHOUSE", '{"hiring_team": [{"title": "x"}, {"name": "Ann Lee", "title": "Lead", "linkedin_url": "https://l/a"}]}', ""),
    ("GREENHOUSE", '{"hiring_team": [], "metadata": [{"name": "Team", "value": "no"}, {"name": "Hiring person", "value": "Bo Diaz"}]}', ""),
    ("GREENHOUSE", "{}", "<i>Contact: Recruiter: Cy Ash Dove</i> https://linkedin.com/in/cy-ash/"),
    ("SMARTRECRUITERS", '{"creator": {"firstName": "Dee", "lastName": "Roy", "title": "HR", "avatarUrl": "https://p/d"}}', ""),
    ("SMARTRECRUITERS", '{"creator": {"firstName": "Dee"}}', '<div class="the-recruiter"><b>Eve Foy</b></div><i class="poster-role"> Head </i>'),
    ("TEAMTAILOR", '{"recruiter": {"name": "Flo Gray", "avatar": "https://p/f", "linkedin": "https://l/f"}}', ""),
    ("TEAMTAILOR", None, '<h2>Not Me</h2><div class="recruiter"><span>Gus Hill</span><img alt="" src="/g.png"></div>'),
    ("ASHBY", '{"hiringTeam": "none", "owner": {"name": " ", "title": "x"}, "jobPosting": {"hiringTeam": [{"name": "Hal Ivy", "photoUrl": "https://p/h"}]}}', ""),
    ("LEVER", '{"owner": 5, "creator": {"name": "Ida Jay"}}', ""),
    ("LEVER_EU", "not json", 'Hiring manager: Jo Kay Lim role: "Chef de cuisine" https://www.linkedin.com/in/jo_k'),
    ("LEVER", "{}", "nobody here"),
    ("OTHER", '{"owner": "Kim Low"}', "Posted by Kim Low"),
)


def arr07_posters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posters of five systems, from JSON or from pages around whole texts."""
    k = (F.col("id") % len(_POSTERS) + 1).cast("int")
    at = lambda n: F.element_at(F.array(*[F.lit(p[n]).cast("string") for p in _POSTERS]), k)
    html = F.concat(F.lit("<p>"), F.col("description"), F.lit("</p>"), at(2))
    found = b.jobs(spark, sf_dir).select("id", posters.poster(at(0), at(1), html).alias("poster"))
    return found.where("poster IS NOT NULL").select("id", "poster.*")


_FOUND = (
    ("Ann Lee", "Lead", "https://l/a", None, "JSON"), ("Bo Diaz", None, None, None, "JSON"), ("Cy Ash Dove", None, "https://linkedin.com/in/cy-ash/", None, "PAGE"), ("Dee Roy", "HR", None, "https://p/d", "JSON"),
    ("Eve Foy", "Head", None, None, "PAGE"), ("Flo Gray", None, "https://l/f", "https://p/f", "JSON"), ("Gus Hill", None, None, "/g.png", "PAGE"), ("Hal Ivy", None, None, "https://p/h", "JSON"), ("Ida Jay", None, None, None, "JSON"),
    ("Jo Kay Lim", "Chef de cuisine", "https://www.linkedin.com/in/jo_k", None, "PAGE"),
)


def src42_csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as quoted fields, with their line breaks and doubled quotes, a hundred rows in a payload."""
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("description", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(F.col("id"), F.lit(",\"a \"\"quoted\"\" ,\nname\","), quoted, F.lit(","), F.col("id") % 9)
    grouped = b.jobs(spark, sf_dir).groupBy(F.floor(F.col("id") / 100).alias("chunk")).agg(F.collect_list(line).alias("lines"))
    payloads = grouped.select(F.concat(F.lit("id,name,text,n\r\n"), F.array_join("lines", "\r\n"), F.lit("\n\n")).alias("payload"))
    return documents.csv_lines(payloads, "id long, name string, text string, n int").select("id", "name", F.md5("text").alias("text"), "n")


QUERIES = {f.__name__: f for f in (src13_blocks, src22_details, src22_offsets, arr04_json_ld, arr07_posters, src42_csv_texts)}

_TAG_REST = """(?:[\\s/](?:[^''">]|"[^"]*"|''[^'']*'')*)?"""


def _sql_text(html: str) -> str:
    """The text of a page, as page_parts makes it of a whole subtree."""
    out = f"regexp_replace({html}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<template\\b.*?</template\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?(?:{'|'.join(page_parts.INLINE)}){_TAG_REST}>', '', 'g')"
    out = f"""regexp_replace({out}, '<[a-zA-Z/!?](?:[^''">]|"[^"]*"|''[^'']*'')*>', ' ', 'g')"""
    for reference, char in ENTITIES:
        out = f"replace({out}, {sql_literal(reference)}, {sql_literal(char)})"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_VALUES = ", ".join("(" + ", ".join([str(n), *("NULL" if v is None else sql_literal(v) for v in row)]) + ")" for n, row in enumerate(_FOUND))
SQL = {
    "src13_blocks": f"""WITH t AS (SELECT page_id, page_id % 4 AS k, {_sql_text("html || ' the <b>ta</b>il'")} AS whole, {_sql_text("'<u>Un</u>der ' || html")} AS under FROM pages),
d AS (SELECT page_id, CASE k WHEN 0 THEN whole || chr(10) || chr(10) || 'Second block' WHEN 1 THEN under END AS d FROM t)
SELECT page_id, CASE WHEN length(d) > 50 THEN md5(d) END AS description FROM d""",
    "src22_details": f"""WITH t AS (SELECT page_id, page_id % 7 AS k, {_sql_text("CASE page_id % 7 WHEN 2 THEN html || '<p>end' ELSE html END")} AS whole FROM pages),
d AS (SELECT page_id, CASE WHEN k < 6 THEN left(whole, 10000) END AS d FROM t) SELECT page_id, md5(d) AS description, length(d) AS n_chars FROM d""",
    "src22_offsets": "WITH t AS (SELECT page_id, CASE WHEN page_id % 4 < 3 THEN page_id * 7 % 130 ELSE 0 END AS n FROM pages) SELECT page_id, CAST(unnest(range(25, CAST(n AS BIGINT), 25)) AS INTEGER) AS \"offset\" FROM t WHERE n > 25",
    "arr04_json_ld": f"""WITH {b.JOBS}, d AS (SELECT id, id % 4 AS k, CASE WHEN regexp_matches(description, '[^\\x00-\\x20]') THEN description END AS d FROM jobs)
SELECT id, CASE WHEN k = 0 THEN md5(d) END AS as_typed, CASE WHEN k < 3 THEN md5(d) END AS as_any, CASE WHEN k <> 1 AND length(d) > 50 THEN md5(d) END AS as_open,
  CASE WHEN k = 0 THEN 'Post ' || id ELSE 'Head ' || id END AS title, CASE WHEN k = 0 THEN 'Firm Two' ELSE 'Firm ' || id % 5 END AS company_name, CASE WHEN k = 0 THEN 'Ulm, Bonn' END AS location,
  CAST(40000 AS DOUBLE) AS salary_min, CAST(55500 AS DOUBLE) AS salary_max FROM d""",
    "arr07_posters": f"SELECT doc_id AS id, name, title, profile_url, picture_url, source FROM (SELECT doc_id, doc_id % {len(_POSTERS)} AS k FROM documents) d JOIN (VALUES {_VALUES}) v(k, name, title, profile_url, picture_url, source) USING (k)",
    "src42_csv_texts": "SELECT doc_id AS id, 'a \"quoted\" ,' || chr(10) || 'name' AS name, md5(coalesce(text, '')) AS text, CAST(doc_id % 9 AS INTEGER) AS n FROM documents",
}
