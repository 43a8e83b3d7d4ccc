"""Containment joins against all pairs, text blocks, and the resolver over a table of cities against the literal one."""

import datetime
import random
from collections import Counter

from millrace.functions import geo
from millrace.operators import containment, places
from millrace.plans import matching
from millrace.sources import blocks
from pyspark.sql import functions as F


def test_containment_equals_all_pairs(spark):
    draw = random.Random(4)
    name = lambda: "".join(draw.choices("abAB é.", k=draw.choice([0, 1, 2, 3, 4, 7, 12])))
    left, right = [name() for _ in range(150)] + [None, "ab"] * 40, [name() for _ in range(200)] + [None, " AB "] * 60
    clean = lambda names: {n.strip("".join(map(chr, range(33)))).lower() for n in names if n and n.strip("".join(map(chr, range(33))))}
    a, b = (spark.createDataFrame([(k, n) for k, n in enumerate(names)], f"{c}_id int, {c} string") for names, c in ((left, "l"), (right, "r")))
    want = {(x, y) for x in clean(left) for y in clean(right) if x in y or y in x}
    for run in (1, 2, 3, 5):
        assert {tuple(r) for r in containment.containing_names(a, b, "l", "r", run).collect()} == want
    low = lambda n: (n or "").strip("".join(map(chr, range(33)))).lower()
    rows = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if (low(x), low(y)) in want)
    met = containment.containment_join(a, b, "l", "r")
    assert sorted((r["l_id"], r["r_id"]) for r in met.collect()) == rows
    unnamed = containment.containment_join(a, b, "l", "r", keep_unnamed=True).where("l_id IS NULL")
    assert unnamed.count() == sum(not low(y) for y in right)
    assert containment.containing_names(a.limit(0), b, "l", "r").count() == 0


def test_containment_makes_no_nested_loop(spark, sf):
    for query in (matching.join10_containment, matching.join10_rows):
        plan = query(spark, sf)._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_long_names_are_not_repeated_for_their_runs(spark):
    draw = random.Random(5)
    long = ["".join(draw.choices("abcdefgh ", k=20_000)) for _ in range(4)]
    inner = [long[0][7:12], long[1][-3:], "z", long[2][500:700], long[3].upper(), "zzzz"]
    a, b = spark.createDataFrame([(x,) for x in inner], "l string"), spark.createDataFrame([(x,) for x in long], "r string")
    want = {(x.lower().strip(), y.strip()) for x in inner for y in long if x.lower().strip() in y}
    for sent in (containment.MOST_SENT, 0):  # whole names stay where they are, or only ids meet
        pairs = containment.containing_names(a, b, "l", "r", most_sent=sent)
        assert {tuple(r) for r in pairs.collect()} == want
    plan = containment.containing_names(a, b, "l", "r")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(run" not in plan


def test_both_sides_are_read_once_and_rows_counted(spark):
    left, right = [None, "", " ", "Ab", " ab", "zz", "é\U0001f600", "abc"], ["xAB", "ab ", "aB", None, "a", "\t", "Zé\U0001f600z", "b", "abcabc", "abcabc "]
    read = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    a, b = (spark.createDataFrame([(n,) for n in names], f"{c} string").coalesce(1).mapInArrow(counting, f"{c} string") for names, c in ((left, "l"), (right, "r")))
    clean = lambda names: Counter(n.strip("".join(map(chr, range(33)))).lower() for n in names if n and n.strip("".join(map(chr, range(33)))))
    want = sorted((x, y, m, n) for x, m in clean(left).items() for y, n in clean(right).items() if x in y or y in x)
    for sent in (containment.MOST_SENT, 0):
        read.value = 0
        pairs = containment.containing_names(a, b, "l", "r", most_sent=sent, counted=("n_l", "n_r"))
        assert pairs.columns == ["l", "r", "n_l", "n_r"] and sorted(map(tuple, pairs.collect())) == want
        assert read.value == len(left) + len(right)
    none = spark.createDataFrame([(None,), (" ",)], "l string")
    assert containment.containing_names(none, b, "l", "r", counted=("n_l", "n_r")).count() == containment.containing_names(none, none.toDF("r"), "l", "r").count() == 0


def test_pieces_are_all_runs(spark):
    names = ["", "a", "ab", "aab", "aaaa", "é\U0001f600 x\n\r\u2028yz" * 3, "abc" * 5_000, None]
    for n in (1, 2, 3, 5):
        each = F.concat(*[containment._runs(F.col("name"), k) for k in range(1, n + 1)])
        for p, apart in spark.createDataFrame([(x,) for x in names], "name string").select(containment._pieces(F.col("name"), n), each).collect():
            assert (p and sorted(p)) == (apart and sorted(apart))


TEXT = "\n".join(["Results", "Cook", "  Blue Door ", "Lyon", "x", "Posted 2 weeks ago", "5 days ago", "Baker", "", "Actively reviewing applicants", "none", "Cook", "again", "Judge", "Viewed", "3 Jump to"])


def test_blocks(spark):
    texts = spark.createDataFrame([(1, TEXT), (2, "Cook"), (3, None), (4, "no titles here\nat all")], "k int, text string")
    titles = spark.createDataFrame([(k, t) for k in (1, 2, 3, 4) for t in ("Judge", "Cook", "Baker", "Cook", " ")], "k int, title string")
    rows = {(r["k"], r["title"]): r for r in blocks.text_blocks(texts, titles, "k", F.lit("2024-03-31").cast("date")).collect()}
    assert set(rows) == {(1, "Cook"), (1, "Baker"), (1, "Judge"), (2, "Cook")}
    cook, baker, judge = (rows[1, t] for t in ("Cook", "Baker", "Judge"))
    assert (cook["company"], cook["location"], cook["posted_date"]) == ("Blue Door", "Lyon", datetime.date(2024, 3, 17))
    assert cook["body"] == "Blue Door\nLyon\nx\nPosted 2 weeks ago\n5 days ago"
    assert (baker["company"], baker["location"], baker["posted_date"], baker["body"]) == (None, None, None, "\nActively reviewing applicants\nnone\nCook\nagain")
    assert (judge["company"], judge["location"]) == (None, "3 Jump to") and rows[2, "Cook"]["body"] == ""


def test_placed_companies(spark):
    text = "Role\nRole with verification\nFirm\nUlm (Hybrid)\n12 results\nBonn (Remote)\n\nKiel (Onsite)\nJump to\nCalw (Remote)\nTwo\nFirm Two\nHof (On-Site) and more"
    rows = blocks.placed_companies(spark.createDataFrame([(1, text), (2, "A\n(Remote)"), (3, None), (4, "x with verification\nFirm\n(Remote)")], "k int, text string"), "k").orderBy("k", "n").collect()
    assert [(r["k"], r["company"], r["title"]) for r in rows] == [(1, "Firm", "Role"), (1, "Firm Two", "Two"), (4, "Firm", "")]


def test_table_of_cities_equals_the_literal_dictionary(spark):
    located = ["Berlin, Germany", "Hybrid - Berlin", "Frankfurt am Main", "New York City", "in Dublin", "Dublin", "Valencia", "London", "Essen", "Paris", "nl", "UK", "Amsterdam NL", "it, be", "Remote - x - Wien", "york", "Zürich\nrest", "Wien-Berlin", " ", "", None, "nowhere", "The Netherlands, Paris", "Toronto ON"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(located * 3)], "k int, place string")
    cities = spark.createDataFrame([(city.upper(), code.lower(), n) for city, codes in geo.CITIES.items() for n, code in enumerate(codes)] + [(None, "DE", 0), ("x", None, 1)], "city string, iso string, nth int")
    want = {r["k"]: r["iso"] for r in rows.select("k", geo.resolve(F.col("place")).alias("iso")).collect()}
    found = places.resolve_places(rows, "place", cities).collect()
    assert {r["k"]: r["iso"] for r in found} == want and len(found) == len(want) and len(set(want.values())) > 7
    home = places.resolve_places(rows, "place", cities, (r"\bparis\b",)).where("place = 'Paris'").first()["iso"]
    assert home == "DE" == rows.where("place = 'Paris'").select(geo.resolve(F.col("place"), home=(r"\bparis\b",))).first()[0]


def test_large_dictionary_is_joined_not_broadcast(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("Town "), F.col("id") * 1000).alias("place"))
    cities = spark.range(100_000).select(F.concat(F.lit("town "), F.col("id")).alias("city"), F.lit("AT").alias("iso"), F.lit(0).alias("nth"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        df = places.resolve_places(rows, "place", cities)
        assert df.where("iso = 'AT'").count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_places_meet_cities_by_short_names(spark):
    rows = spark.createDataFrame([(1, "x, " * 5_000 + "Wien"), (2, "ulm"), (3, "x" * 9_000 + ", Deutschland"), (4, None)], "id int, place string")
    cities = spark.createDataFrame([("wien", "AT", 0), ("ulm", "DE", 0)], "city string, iso string, nth int")
    found = places.resolve_places(rows, "place", cities)
    assert {r["id"]: r["iso"] for r in found.collect()} == {1: "AT", 2: "DE", 3: "DE", 4: None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    generate = [x for x in plan.splitlines() if "Generate posexplode" in x]
    assert generate and all("[_id#" in x and ", [_place#" not in x for x in generate)
