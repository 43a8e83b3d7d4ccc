"""Subtrees, JSON-LD, posters and quoted CSV on literal pages."""

import csv
import io
import random

from millrace.plans import nested_pages
from millrace.sources import documents, page_parts, posters
from pyspark.sql import functions as F


def _pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "k int, html string")


def _texts(df):
    return [r["description"] for r in df.orderBy("k").collect()]


def test_balanced_subtrees(spark):
    long = "word " * 30
    pages = _pages(
        spark,
        f'<div class="a rich-text-content">one<div>{long}<div>deep</div></div>two</div><div>not</div>',
        f"<DIV CLASS=jb-description-item><p>{long}</p><br/><img src='>'>x</DIV>",
        f'<div class="rich-text-content"><!-- </div> --><script>"</div>"</script>{long}</div>after',
        f'<div class="rich-text-content">{long} never closed <div>inner</div> to the end',
        '<div class="rich-text-content">short</div>',
        f'<div class="rich-text-contents">{long}</div>',
        f'<p class="rich-text-content">{long}</p>1 < 2<p class="b rich-text-content c">a&lt;b &amp;amp;<b>c</b>d<i>e</i></p>',
        "",
        None,
    )
    found = _texts(page_parts.blocks_detail(pages))
    words = long.strip()
    assert found == [f"one {words} deep two", f"{words} x", words, f"{words} never closed inner to the end", None, None, f"{words}\n\na<b &amp;cde", None, None]


def test_selectors_in_order_and_first_subtree_only(spark):
    pages = _pages(
        spark,
        "<main>m</main><div class='jobDescription big'>d1</div><div class='jobdescription'>d2</div>",
        "<main>m<main>n</main>o</main><main>second</main><div id=content>c</div>",
        "<div id='content'>c</div>",
        "<div id='contents'>c</div>",
        "<section data-x class='col my-JobDescription'>s</section><div class='contentWithSidePanel__content'>t</div>",
        "<main/><div id=content>c</div>",
    )
    assert _texts(page_parts.listing_detail(pages)) == ["d1", "m n o", "c", None, "s", "c"]
    long = _pages(spark, f"<main>{'x' * 20_000}</main>")
    assert len(_texts(page_parts.listing_detail(long))[0]) == 10_000


def test_totals_and_offsets(spark):
    pages = _pages(spark, "Results 1 to 25 of 303 Showing 1 to 25 of 9", "Showing 1 to 25 of 26", "Results <b>1</b> – <b>25</b> of <b>51</b>", "none", None, "Results 1 to 25 of 25", "Results 1 to 25 of 99999999999")
    assert [r[0] for r in pages.orderBy("k").select(page_parts.total(F.col("html"))).collect()] == [303, 26, 51, 0, 0, 25, 0]
    offsets = page_parts.page_offsets(pages).groupBy("k").agg(F.sort_array(F.collect_list("offset")).alias("o")).collect()
    assert {r["k"]: r["o"] for r in offsets} == {0: list(range(25, 303, 25)), 1: [25], 2: [25, 50]}


def test_readings_of_json_ld(spark):
    ld = lambda body: f'<script type="application/ld+json">{body}</script>'
    text = "t" * 60
    cases = [
        ld("broken") + ld(f'{{"@type": "JobPosting", "description": "{text}"}}'),
        ld(f'{{"@type": "Article", "description": "{text}"}}'),
        ld(f'{{"description": "{text}"}}') + ld('{"@type": "JobPosting", "description": "brief"}'),
        ld(f'[{{"@type": "Person"}}, {{"@type": "JobListing", "description": "{text}"}}]'),
        "<meta content='" + "m" * 101 + "' name='description'>",
        "<meta name=description content='short'>",
    ]
    pages = _pages(spark, *cases)
    read = lambda r: [x[0] for x in pages.orderBy("k").select(page_parts.ld_description(F.col("html"), r)).collect()]
    assert read("typed") == [text, None, "brief", None, None, None]
    assert read("any") == [text, text, text, None, None, None]
    assert read("open") == [text, None, text, text, None, None]
    assert [x[0] for x in pages.orderBy("k").select(page_parts.page_description(F.col("html"))).collect()] == [text, None, text, text, "m" * 101, None]


def test_scripts_end_at_the_nearest_end(spark):
    ld = '<script type="application/ld+json">'
    cases = [
        f"{ld}a < b </ script> </SCRIPT>x</script>{ld}</script>",
        f"{ld}<{'<' * 100_000}/script>",
        f"{ld}never </script {ld}closed",
        f"{ld}{ld}\n\u20ac \U0001f600</script><ScRiPt id=1 TYPE = 'application/LD+json' x>2</sCRIPT>",
        "<script data-of=application/ld+json>{</script>",
        "",
        None,
    ]
    lazy = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json[^>]*>(.*?)</script>"""), 1)
    rows = _pages(spark, *cases).orderBy("k").select(page_parts.ld_scripts(F.col("html")).alias("found"), lazy.alias("lazy")).collect()
    assert [r["found"] for r in rows] == [r["lazy"] for r in rows]
    assert [None if r["found"] is None else len(r["found"]) for r in rows] == [2, 1, 0, 2, 0, 0, None]


def test_a_page_is_searched_once_for_all_readings(spark):
    ld = lambda body: f'<script type="application/ld+json">{body}</script>'
    text = "t" * 60
    cases = [ld(f'{{"@type": "JobPosting", "description": "{d}"}}') for d in (text, " \\n", "", "brief")]
    cases += [ld("[broken") + ld(f'{{"description": "{text}"}}'), ld(f'[null, 5, {{"description": "{text}"}}, "x"]'), ld("null") + ld("7"), ld('{"@type": ["JobPosting"], "description": {"a": 1}}'), "", None]
    pages = _pages(spark, *cases).withColumn("_scripts", page_parts.ld_scripts(F.col("html")))
    both = [page_parts.ld_description(F.col("html"), r, s) for s in (None, F.col("_scripts")) for r in ("typed", "any", "open")]
    rows = [tuple(r) for r in pages.orderBy("k").select(*both).collect()]
    assert [r[:3] for r in rows] == [r[3:] for r in rows]
    assert [r[:3] for r in rows[:4]] == [(text,) * 3, (None,) * 3, (None,) * 3, ("brief", "brief", None)]
    assert rows[5][:3] == (None, None, text) and rows[6:7] + rows[8:] == [(None,) * 6] * 3 and rows[7][:2] == (None, '{"a":1}')
    plan = nested_pages.arr04_json_ld(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(html") == 2  # for the readings, and for the posting, which takes other scripts too


def test_ranges_headings_and_companies(spark):
    cases = ["9,000 - 1,500 € 1,000-2,000€", "12,000\n–\t15,500€ 1,000-2,000 €", "1234,567-890,123 € x", "€", "", None]
    pages = _pages(spark, *cases)
    rows = documents.posting_page(pages).orderBy("k").collect()
    assert [(r["salary_min"], r["salary_max"]) for r in rows] == [(9000, 1500), (12000, 15500), (234567, 890123), (None, None), (None, None), (None, None)]
    assert rows[0].asDict().keys() == {"k", "html", "title", "company_name", "location", "description", "posted_date", "salary_min", "salary_max"}
    titled = _pages(spark, "<title>Cook at  at Sea </title><h1></h1>", "<title>Cook at </title><h1><b></b></h1>", "<title> Cook</title><h1> A <i>b</i>&amp;lt;</h1><h1>C</h1>", "none", None)
    found = [(r["title"], r["company_name"]) for r in documents.posting_page(titled).orderBy("k").collect()]
    assert found == [("Cook", "Sea"), ("", None), ("A b&lt;", None), ("", None), (None, None)]


def test_posting_page_without_json_ld(spark):
    row = documents.posting_page(_pages(spark, "<title>Cook at sea at Blue Door </title><h1>Cook &amp; more</h1>12,000-15,500 €")).first()
    assert (row["title"], row["company_name"], row["location"], float(row["salary_min"]), float(row["salary_max"])) == ("Cook & more", "Blue Door", None, 12000.0, 15500.0)


def test_posters_prefer_json_and_name_their_source(spark):
    cases = [
        ("GREENHOUSE", '{"hiring_team": [{"name": "Ann Lee"}]}', "posted by: Bo Diaz", ("Ann Lee", None, None, None, "JSON")),
        ("GREENHOUSE", '{"hiring_team": {"name": "x"}}', "Posted By: Bo Diaz of", ("Bo Diaz", None, None, None, "PAGE")),
        ("GREENHOUSE", "{}", "posted by: bo diaz", None),
        ("SMARTRECRUITERS", '{"recruiter": {"name": 5}, "postingOwner": {"name": "Cy Ash", "title": " "}}', None, ("Cy Ash", None, None, None, "JSON")),
        ("SMARTRECRUITERS", None, "<div class='recruiter'><img class=\"recruiter\" src=\"https://p/q.png\"><b>Dee Roy</b>", ("Dee Roy", None, None, "https://p/q.png", "PAGE")),
        ("TEAMTAILOR", "[]", "<h2>Eve Foy</h2><i class='role'>Lead </i>", ("Eve Foy", "Lead", None, None, "PAGE")),
        ("ASHBY", '{"hiringManager": {"name": "Flo Gray", "photoUrl": "https://f"}, "hiringTeam": []}', "hiring manager Gus Hill", ("Flo Gray", None, None, "https://f", "JSON")),
        ("ASHBY", "{}", "hiring manager Gus Hill", None),
        ("LEVER_EU", '{"creator": "Hal Ivy"}', None, ("Hal Ivy", None, None, None, "JSON")),
        ("OTHER", '{"creator": "Hal Ivy"}', None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, system string, json string, html string")
    rows = df.orderBy("k").select(posters.poster(F.col("system"), F.col("json"), F.col("html")).alias("p")).collect()
    assert [None if r["p"] is None else tuple(r["p"]) for r in rows] == [c[3] for c in cases]


def test_csv_with_line_breaks_equals_a_csv_reader(spark):
    draw = random.Random(6)
    field = lambda: "".join(draw.choice(['"', ",", "\n", "a", " ", "é", "\x1e", "b"]) for _ in range(draw.randint(1, 9)))
    tables = [[[f"x{field()}x", f"y{field()}y", str(draw.randrange(99))] for _ in range(draw.randint(0, 12))] for _ in range(40)]

    def written(rows):
        out = io.StringIO()
        csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=draw.choice(["\n", "\r\n"])).writerows([["a", "b", "n"], *rows])
        return out.getvalue()

    payloads = spark.createDataFrame([(written(rows),) for rows in tables] + [("",), (None,), ('a,b,n\n"open', )], "payload string")
    found = documents.csv_lines(payloads, "a string, b string, n int").where("b IS NOT NULL").collect()
    assert sorted(tuple(r) for r in found) == sorted((a, b, int(n)) for rows in tables for a, b, n in rows)
