"""Feeds of whole texts against plain Python."""

import datetime
import hashlib

import duckdb
from pyspark.sql import functions as F

from millrace.plans import feeds
from millrace.sources import documents as documents_of
from millrace.sources import json_feeds

TEXTS = [f"title {k} " + "t" * 700 + "\n" + f"word{k} &amp; <b>more</b>\t" * (40 * k + 5) + f"end {k}" for k in range(30)] + [" \n", None]


def documents(spark, folder):
    rows = [(k, t, "en", f"src{k % 9}", len(t or "")) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def md5(text):
    return None if text is None else hashlib.md5(text.encode()).hexdigest()


def plain(text):
    return " ".join(text.replace("<b>", "").replace("</b>", "").replace("&amp;", "&").split())


def test_whole_texts(spark, tmp_path):
    at = documents(spark, tmp_path)
    titles = {str(k): "T " + t.split("\n")[0] for k, t in enumerate(TEXTS) if t is not None}
    for name, title, text in (("src10_greenhouse_whole", lambda t: t, plain), ("src11_lever_whole", lambda t: t[:500], lambda t: t if t.strip() else None)):
        got = {r["external_id"]: (r["title"], r["description"]) for r in feeds.QUERIES[name](spark, at).collect()}
        assert got == {k: (title(t), md5(text(TEXTS[int(k)]))) for k, t in titles.items()}, name
    assert {r["external_id"]: r["title"] for r in feeds.src32_builtin_whole(spark, at).collect()} == titles


def test_payloads_are_cut_by_bytes(spark, tmp_path):
    rows = feeds._rows(spark, documents(spark, tmp_path))
    payloads = feeds._whole_payloads(rows, feeds._lever(F.col("description")), None, most=20_000)
    assert payloads.count() > 5 and json_feeds.parse(payloads, "LEVER").count() == len(TEXTS) - 1


ODD = ["", "\nno title", "pad \nx", " pad\nx", "tab\t\nx\ty", "cr\r\nx\r\ny\rz", "a\x01b\nc\x02d", "us\x1f\nx\x1f\U0001f600", "\x01\nx", "del\x7f\nnel\u0085ls x", "&&& \n&&& <u> &lt;i> ]]>", "   \nx"]


def test_odd_characters_and_spaces_pass_through_rss(spark, tmp_path):
    rows = [(k, t, "en", "src1", len(t)) for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT external_id, title, location, description, posted_date FROM ({feeds.SQL['src23_rss']}) ORDER BY ALL").fetchall()
    assert sorted(map(tuple, feeds.src23_rss(spark, str(tmp_path)).collect())) == want


def test_fields_of_rss_are_trimmed(spark):
    item = "<item>\n<guid> g </guid><title>\n Cook </title><link> https://x/jobs/7 </link><pubDate> Mon, 01 Jan 2024 10:00:00 +0000 </pubDate><remoteStatus> none </remoteStatus><tt:locations><tt:location><tt:city> A </tt:city><tt:country> </tt:country></tt:location></tt:locations></item>"
    payloads = spark.createDataFrame([(f'<rss xmlns:tt="t"><channel>\n{item}\n{item.replace(" g ", " ")}\n</channel></rss>',)], "payload string")
    day = datetime.date(2024, 1, 1)
    assert sorted(map(tuple, documents_of.rss(payloads).collect())) == [("7", "Cook", "A", None, "https://x/jobs/7", day), ("g", "Cook", "A", None, "https://x/jobs/7", day)]
