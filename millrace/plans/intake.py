"""Queries of the other feeds: payloads of whole titles and descriptions are written from the postings and parsed back."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.bindings import JOBS, jobs
from millrace.plans.feeds import _BASE, _rows, _whole_payloads
from millrace.session import table
from millrace.sources import documents, json_feeds, profiles

_AS_OF = "2024-03-31"
_c = F.col
_named = lambda name, value: (F.lit(value) if isinstance(value, str) else value).alias(name)


def _as_of() -> Column:
    return F.lit(_AS_OF).cast("date")


def _link() -> Column:
    return F.concat(F.lit("https://x/"), _c("id"))


def _paragraph() -> Column:
    return F.concat(F.lit("<p>"), _c("description"), F.lit("</p>"))


def _ashby() -> Column:
    pay = F.struct(_named("currency", "EUR"), F.concat(F.lit("€"), _c("id") + 1000, F.lit(",000 – €90,000")).alias("compensationTierSummary"))
    return F.struct("id", "title", "location", _named("descriptionPlain", _c("description")), _named("applyUrl", _link()), _named("publishedDate", _c("day")), _named("compensation", pay))


def _pinpoint() -> Column:
    return F.struct("id", "title", _named("location", F.struct(_named("name", _c("location")))), _named("description", _paragraph()), _named("key_responsibilities", "<b>k</b>"), _named("url", _link()), _named("compensation_minimum", "1,500.5"))


def _breezy() -> Column:
    country = F.when(_c("id") % 2 == 0, _c("location")).otherwise("Y")
    return F.struct(_named("_id", _c("id")), _named("name", _c("title")), _named("location", F.struct(_named("city", _c("location")), _named("country", F.struct(_named("name", country))))), _named("url", _link()), _named("published_date", _c("day")))


def _smartrecruiters() -> Column:
    sections = F.struct(_named("jobDescription", F.struct(_named("text", _paragraph()))), _named("qualifications", F.struct(_named("text", "q"))))
    return F.struct("id", _named("name", _c("title")), _named("location", F.struct(_named("fullLocation", _c("location")), _named("city", "C"))), _named("jobAd", F.struct(_named("sections", sections))), _named("releasedDate", _c("day")))


def _workday() -> Column:
    path = F.concat(F.lit("/job/x/Dev_"), _c("id"))
    bullets = F.when(_c("id") % 2 == 0, F.array(_c("id").cast("string"), F.lit("Full")))
    return F.struct("title", _named("externalPath", path), _named("locationsText", _c("location")), _named("postedOn", F.concat(F.lit("Posted "), _c("id") % 29, F.lit(" Days Ago"))), _named("bulletFields", bullets))


def _places() -> list[Column]:
    return [_named("city", _c("location")), _named("country", "Y")]


#: By query: feed, where its array stands, and a posting of it.
_FEEDS: dict[str, tuple[str | Callable, str | None, Callable[[], Column]]] = {
    "src12_ashby": ("ASHBY", "jobs", _ashby),
    "src13_personio": ("PERSONIO", None, lambda: F.struct("id", _named("name", _c("title")), _named("office", _c("location")), _named("createdAt", _c("day")))),
    "src14_pinpoint": ("PINPOINT", "data", _pinpoint),
    "src15_recruitee": ("RECRUITEE", "offers", lambda: F.struct("id", "title", *_places(), _named("description", _paragraph()), _named("careers_url", _link()), _named("published_at", _c("day")))),
    "src16_workable": ("WORKABLE", "jobs", lambda: F.struct(_named("shortcode", _c("id")), "title", *_places(), _named("description", _paragraph()), _named("url", _link()), _named("created_at", _c("day")))),
    "src17_breezy": ("BREEZY", None, _breezy),
    "src18_bamboohr": ("BAMBOOHR", "result", lambda: F.struct("id", _named("jobOpeningName", _c("title")), _named("location", F.struct(*_places())))),
    "src19_join": ("JOIN", "items", lambda: F.struct("id", "title", _named("city", _c("location")), _named("countryCode", "Y"), _named("jobUrl", _link()), _named("createdAt", _c("day")))),
    "src20_smartrecruiters": ("SMARTRECRUITERS", "content", _smartrecruiters),
    "src21_workday": (lambda: json_feeds.workday(_as_of()), "jobPostings", _workday),
    "src24_unknown": (lambda: json_feeds.unknown(F.lit("https://x/y/")), "results", lambda: F.struct(F.struct(_named("position", _c("title")), _named("office", _c("location")), _named("link", F.concat(F.lit("/"), _c("id")))).alias("_source"))),
    "src30_rest": ("REST", "data", lambda: F.struct(_named("slug", _c("id")), "title", _named("company_name", _c("company")), "location", _named("description", _paragraph()), _named("url", _link()), _named("created_at", _c("stamp")))),
    "src31_meilisearch": ("MEILISEARCH", "hits", lambda: F.struct("id", "title", "company", _named("location.lvl1", _c("location")), _named("location.lvl0", "L"), _named("url", _link()), _named("published", _c("stamp")))),
    "src37_cli": ("CLI", None, lambda: F.struct(_named("id", F.when(_c("id") % 2 == 0, _c("id").cast("string"))), "title", "company", "location", "description", _named("job_url", F.concat(F.lit("https://x/?a=b&jk=K"), _c("id"))), _named("date_posted", _c("day")))),
}


def _feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    feed, array, item = _FEEDS[name]
    payloads = _whole_payloads(_rows(spark, sf_dir), item(), array).withColumn("slug", F.lit("acme"))
    rows = json_feeds.parse(payloads, feed if isinstance(feed, str) else feed())
    pay = [_c(c).cast("double").alias(c) for c in ("salary_min", "salary_max")]
    return rows.select("external_id", F.md5("title").alias("title"), "company_name", "location", F.md5("description").alias("description"), "apply_url", "posted_date", *pay)


def src33_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold ids, titles and amounts as parallel runs."""
    one = F.concat(F.lit(' id="'), _c("id"), F.lit('" t="T'), _c("id"), F.lit('" pay="'), _c("id") % 3 * 1000, F.lit('"'))
    pages = jobs(spark, sf_dir).groupBy(F.floor(_c("id") / 1000)).agg(F.array_join(F.collect_list(one), "\n").alias("payload"))
    rows = documents.zipped(pages, {"external_id": ' id="([^"]*)"', "title": ' t="([^"]*)"', "salary_min": ' pay="([^"]*)"'}, ("salary_min",))
    return rows.withColumn("salary_min", _c("salary_min").cast("double"))


def src34_sitemap_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages that sitemaps of their own urls name, but for those that are known."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://x/jobs/"), _c("page_id")).alias("url"), "html")
    entry = F.concat(F.lit("<url><loc>"), _c("url"), F.lit("</loc><lastmod>2024-01-05</lastmod></url><url><loc>https://x/about</loc></url>"))
    maps = pages.groupBy(F.floor(_c("page_id") / 1000)).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("payload"))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://x/jobs/"), _c("c_custkey")).alias("url"))
    return documents.sitemap_postings(maps, pages, "/jobs/", known).select("url", F.md5("title").alias("title"), "lastmod")


def src35_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.lit("<sitemap><loc> https://x/map"), _c("s_suppkey"), F.lit(".xml </loc></sitemap>"))
    index = table(spark, sf_dir, "supplier").groupBy(F.floor(_c("s_suppkey") / 1000)).agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(entry), ""), F.lit("</sitemapindex>")).alias("payload"))
    return documents.sitemap_index(index)


def src40_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced replies, one for each posting."""
    item = F.array(F.struct(F.concat(F.lit("T"), _c("id")).alias("title"), _named("company", "a"), _named("url", "b")))
    replies = jobs(spark, sf_dir).select("id", text.json_slice(F.concat(F.lit("Here:\n```json\n"), F.to_json(item), F.lit("\n```"))).alias("payload"))
    rows = json_feeds.parse(replies, json_feeds.replied(_as_of()), "id").select("id", "external_id", "title", "posted_date")
    return rows


def src42_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('"C, '), _c("id"), F.lit('",T'), _c("id"))
    pages = jobs(spark, sf_dir).groupBy(F.floor(_c("id") / 1000)).agg(F.concat(F.lit("company,title\n"), F.array_join(F.collect_list(line), "\n")).alias("payload"))
    return documents.csv_lines(pages, "company string, title string")


def src43_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("C"), _c("id"), F.lit(" | T"), _c("id"), F.lit("|https://x/"), _c("id"), F.lit("\nno pipes"))
    pages = jobs(spark, sf_dir).groupBy(F.floor(_c("id") / 1000)).agg(F.array_join(F.collect_list(line), "\n").alias("payload"))
    return documents.piped(pages)


def src45_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with a posting's whole description as their post."""
    jobs_held = F.array(F.struct(_named("role", "Dev"), _named("company_name", _c("company")), _named("dates", "2020")), F.struct(_named("role", F.lit(None).cast("string")), _named("company_name", "no title"), _named("dates", "-")))
    shape = F.struct(F.concat(F.lit("N"), _c("id")).alias("full_name"), _named("title", "Head"), _named("experience", jobs_held), _named("skills", F.array(F.struct(_named("skill", "Go")), F.struct(_named("skill", F.lit(None).cast("string"))))), _named("posts", F.array(F.struct(_named("content", _c("description")), _named("reactions", _c("id") % 5)))))
    rows = profiles.profile(jobs(spark, sf_dir).select("id", F.to_json(shape).alias("payload")), "id")
    return rows.select("id", "name", "headline", F.size("experience").alias("held"), _c("experience")[0]["company"].alias("company"), F.array_join("skills", ",").alias("skills"), F.md5(_c("posts")[0]["text"]).alias("post"), _c("posts")[0]["reactions"].alias("reactions"))


GROUPS = {"articles": ["the", "der", "la"], "verbs": [r"is\w*", "ist", "est"]}


def str18_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.keywords(_c("text"), GROUPS)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(found["articles"]), ",").alias("articles"), F.array_join(F.array_sort(found["verbs"]), ",").alias("verbs"))


_OTHERS = (src33_runs, src34_sitemap_postings, src35_index, src40_reply, src42_csv, src43_pipes, src45_profiles, str18_keywords)
QUERIES = {n: partial(_feed, name=n) for n in _FEEDS} | {f.__name__: f for f in _OTHERS}

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&amp;": "&"}
_PLAIN = "regexp_replace('<p>' || description || '</p>', '<[^>]+>', '', 'g')"
for _name, _char in _ENTITIES.items():
    _PLAIN = f"replace({_PLAIN}, '{_name.replace(chr(39), chr(39) * 2)}', '{_char}')"
_STRIPPED = rf"trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g'))"
_SPACED = r"trim(regexp_replace(regexp_replace('<p>' || description || '</p>', '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_FILLED = r"CASE WHEN regexp_matches({0}, '[^\x00-\x20]') THEN {0} END"
_CITY = f"concat_ws(', ', {_FILLED.format('location')}, 'Y')"
_BOTH = "CASE WHEN {0} IS NULL THEN '{1}' ELSE {0} || '{2}{1}' END"


def _sql(external_id="CAST(id AS VARCHAR)", title="title", company="NULL", location="location", description="NULL", apply_url="'https://x/' || id", posted="discovered_date", low="NULL", high="NULL", where="true") -> str:
    return f"{_BASE} SELECT {external_id} AS external_id, md5({title}) AS title, CAST({company} AS VARCHAR) AS company_name, {location} AS location, md5({description}) AS description, {apply_url} AS apply_url, CAST({posted} AS DATE) AS posted_date, CAST({low} AS DOUBLE) AS salary_min, CAST({high} AS DOUBLE) AS salary_max FROM r WHERE {where}"


SQL = {
    "src12_ashby": _sql(title="left(title, 500)", description=_FILLED.format("description"), low="(id + 1000) * 1000", high="90000"),
    "src13_personio": _sql(apply_url="'https://acme.jobs.personio.de/job/' || id"),
    "src14_pinpoint": _sql(location=_FILLED.format("location"), description=f"concat_ws(' ', {_FILLED.format(_STRIPPED)}, 'k')", posted="NULL", low="1500.5"),
    "src15_recruitee": _sql(location=_CITY, description=_STRIPPED),
    "src16_workable": _sql(title="left(title, 500)", location=_CITY, description=_SPACED),
    "src17_breezy": _sql(location=f"CASE WHEN id % 2 = 0 THEN {_FILLED.format('location')} ELSE {_CITY} END"),
    "src18_bamboohr": _sql(location=_CITY, apply_url="'https://acme.bamboohr.com/careers/' || id", posted="NULL"),
    "src19_join": _sql(location=_CITY),
    "src20_smartrecruiters": _sql(title="left(title, 500)", location=f"coalesce({_FILLED.format('location')}, 'C')", description=f"concat_ws(chr(10), {_FILLED.format(_SPACED)}, 'q')", apply_url="'https://jobs.smartrecruiters.com/acme/' || id"),
    "src21_workday": _sql(description="CASE WHEN id % 2 = 0 THEN id || ' | Full' END", apply_url="'/job/x/Dev_' || id", posted=f"DATE '{_AS_OF}' - CAST(id % 29 AS INTEGER)"),
    "src24_unknown": _sql(external_id="left(sha256('https://x/' || id), 16)", posted="NULL"),
    "src30_rest": _sql(company="company", description=_STRIPPED),
    "src31_meilisearch": _sql(company="company", location=f"coalesce({_FILLED.format('location')}, 'L')"),
    "src37_cli": _sql(external_id="CASE WHEN id % 2 = 0 THEN '' ELSE 'K' END || id", company="company", description="description", apply_url="'https://x/?a=b&jk=K' || id", where="company IS NOT NULL"),
    "src33_runs": "SELECT CAST(doc_id AS VARCHAR) AS external_id, 'T' || doc_id AS title, CAST(nullif(doc_id % 3 * 1000, 0) AS DOUBLE) AS salary_min FROM documents",
    "src34_sitemap_postings": rf"SELECT 'https://x/jobs/' || page_id AS url, md5(h) AS title, DATE '2024-01-05' AS lastmod FROM (SELECT page_id, {_STRIPPED.replace("'<p>' || description || '</p>'", "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h FROM pages) WHERE page_id NOT IN (SELECT c_custkey FROM customer)",
    "src35_index": "SELECT 'https://x/map' || s_suppkey || '.xml' AS url FROM supplier",
    "src42_csv": "SELECT 'C, ' || doc_id AS company, 'T' || doc_id AS title FROM documents",
    "src43_pipes": "SELECT 'C' || doc_id AS company_name, 'T' || doc_id AS title, 'https://x/' || doc_id AS apply_url FROM documents",
    "src45_profiles": f"WITH {JOBS} SELECT id, 'N' || id AS name, 'Head' AS headline, 1 AS held, company, 'Go' AS skills, md5(description) AS post, id % 5 AS reactions FROM jobs",
    "str18_keywords": "SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct([w for w in ws if w in ('the', 'der', 'la')])), ','), '') AS articles, coalesce(array_to_string(list_sort(list_distinct([w for w in ws if starts_with(w, 'is') or w = 'est'])), ','), '') AS verbs FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS ws FROM documents)",
}
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ord(x) AS BIGINT) for x in string_split('T' || id || '|a|b', '')]), lambda h, x: (h * 31 + x) & 4294967295)"
SQL["src40_reply"] = f"WITH {JOBS} SELECT id, lower(to_hex({_HASH})) AS external_id, 'T' || id AS title, DATE '{_AS_OF}' AS posted_date FROM jobs"
