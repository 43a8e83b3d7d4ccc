"""Feeds of unknown shape, profiles, replies and hashes on literal payloads."""

import datetime
import json

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.sources import json_feeds, profiles


def _payload(spark, *bodies):
    return spark.createDataFrame([(k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "k int, payload string")


def test_string_hash(spark):
    df = spark.createDataFrame([("hello",), ("",), ("a long text that runs over",), (None,)], "t string")
    h = 0
    for c in "a long text that runs over":
        h = (31 * h + ord(c)) % 2**32
    assert [r[0] for r in df.select(text.string_hash(F.col("t"))).collect()] == ["5e918d2", "0", f"{h:x}", None]


def test_unknown_shapes(spark):
    bodies = [{"hits": {"hits": [{"_source": {"job_title": "A", "slug": "/a"}}]}}, {"data": [], "jobs": [{"name": "B", "city": "Ulm", "url": "https://y/b"}]}, [{"position": "C", "id": 7}, {"id": 8}], "no json", {"other": 1}]
    rows = json_feeds.parse(_payload(spark, *bodies), json_feeds.unknown(F.lit("https://x/jobs/")), "k").orderBy("k").collect()
    assert [(r["k"], r["title"], r["location"], r["apply_url"]) for r in rows] == [(0, "A", None, "https://x/a"), (1, "B", "Ulm", "https://y/b"), (2, "C", None, "https://x/jobs/7")]
    assert all(len(r["external_id"]) == 16 for r in rows)


def test_addresses_and_country_objects(spark):
    payloads = _payload(spark, {"result": [{"id": 5, "jobOpeningName": "T"}]}).withColumn("slug", F.lit("co"))
    assert json_feeds.parse(payloads, "BAMBOOHR").first()["apply_url"] == "https://co.bamboohr.com/careers/5"
    assert json_feeds.parse(payloads.drop("slug"), "BAMBOOHR").first()["apply_url"] is None
    places = [{"city": "Ulm", "country": "DE"}, {"city": "Ulm", "country": {"name": "DE"}}, {"country": {"name": ""}}]
    rows = json_feeds.parse(_payload(spark, [{"id": k, "name": "T", "location": p} for k, p in enumerate(places)]), "BREEZY").collect()
    assert [r["location"] for r in rows] == ["Ulm, DE", "Ulm, DE", None]


def test_profiles(spark):
    whole = {"full_name": "N", "current_company": "C", "skills": ["Go", {"name": "SQL"}, {"x": 1}], "experience": [{"role": "Dev"}, {"company": "no role"}], "posts": [{"summary": "s"}, {"reactions": 3}]}
    full, empty = profiles.profile(_payload(spark, whole, {}, "no json"), "k").orderBy("k").collect()
    assert (full["name"], full["company"], full["skills"], [x["title"] for x in full["experience"]], [(p["text"], p["reactions"]) for p in full["posts"]]) == ("N", "C", ["Go", "SQL"], ["Dev"], [("s", 0)])
    assert (empty["name"], empty["skills"], empty["experience"], empty["posts"]) == (None, [], [], [])
    people = profiles.beside(_payload(spark, {"results": [{"name": "P", "url": "u"}, {"name": "Q"}]}, [{"full_name": "R", "profile_url": "v"}]), "k").orderBy("k").collect()
    assert [(r["name"], r["url"]) for r in people] == [("P", "u"), ("R", "v")]


def test_replies(spark):
    reply = 'Sure:\n```json\n[{"title": "T", "company": "C", "url": "U"}, {"title": " "}]\n```'
    payloads = _payload(spark, reply, "sorry").withColumn("payload", text.json_slice(F.col("payload")))
    rows = json_feeds.parse(payloads, json_feeds.replied(F.lit("2024-03-31").cast("date"))).collect()
    assert [(r["title"], r["company_name"], r["posted_date"]) for r in rows] == [("T", "C", datetime.date(2024, 3, 31))]


def test_keywords(spark):
    found = text.keywords(F.col("t"), {"languages": ["java", r"c\+\+"], "tools": [r"git\w*"]})
    row = spark.createDataFrame([("Java, C++ and javascript; GitHub, java",)], "t string").select(found.alias("f")).first()["f"]
    assert (row["languages"], row["tools"]) == (["java", "c++"], ["github"])
