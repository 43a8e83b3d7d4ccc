"""Versioned tables, runs one at a time, run statistics, superseding with links, nested rows."""

import pytest

from millrace.operators import nesting, postings
from millrace.streaming import snapshots
from pyspark.sql import functions as F


def _rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n int")


def _seen(spark, base):
    return sorted(r["n"] for r in snapshots.read(spark, base).collect())


def test_a_repeated_batch_publishes_nothing(spark, tmp_path):
    base = f"{tmp_path}/t"
    assert snapshots.current(spark, base) is None
    with pytest.raises(ValueError):
        snapshots.read(spark, base)
    assert snapshots.publish(_rows(spark, 1), base, 3) and _seen(spark, base) == [1]
    assert not snapshots.publish(_rows(spark, 2), base, 3) and not snapshots.publish(_rows(spark, 2), base, 1)
    assert _seen(spark, base) == [1] and snapshots.current(spark, base) == 3
    for batch in (4, 5, 6):
        assert snapshots.publish(_rows(spark, batch), base, batch)
    assert _seen(spark, base) == [6] and sorted(p.name for p in (tmp_path / "t").glob("version-*")) == ["version-5", "version-6"]


def test_a_failure_between_write_and_switch_leaves_the_old_version(spark, tmp_path, monkeypatch):
    base = f"{tmp_path}/t"
    snapshots.publish(_rows(spark, 1, 2), base, 0)
    before = snapshots.read(spark, base)

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_switch", fails)
        with pytest.raises(OSError, match="lost"):
            snapshots.publish(_rows(spark, 9), base, 1)
    assert _seen(spark, base) == [1, 2] and before.count() == 2
    assert snapshots.publish(_rows(spark, 9), base, 1) and _seen(spark, base) == [9]
    assert before.count() == 2  # readers that began before keep their version


def test_a_stream_that_fails_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    base, log = f"{tmp_path}/t", f"{tmp_path}/log"
    _rows(spark, 1, 2, 2).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("n int").parquet(f"{tmp_path}/in").groupBy("n").agg(F.count("*").alias("times"))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_switch", fails)
        with pytest.raises(Exception, match="lost"):
            snapshots.run(stream(), base, log).awaitTermination()
    assert snapshots.current(spark, base) is None
    snapshots.run(stream(), base, log).awaitTermination()
    assert {tuple(r) for r in snapshots.read(spark, base).collect()} == {(1, 1), (2, 2)}
    _rows(spark, 2, 3).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    snapshots.run(stream(), base, log).awaitTermination()
    assert {tuple(r) for r in snapshots.read(spark, base).collect()} == {(1, 1), (2, 3), (3, 1)} and snapshots.current(spark, base) == 1


def test_one_run_at_a_time(spark, tmp_path):
    base = f"{tmp_path}/t"
    with snapshots.single_flight(spark, base):
        with pytest.raises(snapshots.AlreadyRunning), snapshots.single_flight(spark, base):
            pass
        with snapshots.single_flight(spark, base, stale=-1):  # the first counts as left behind
            pass
    with snapshots.single_flight(spark, base):
        pass


def test_run_statistics(spark, tmp_path):
    base = f"{tmp_path}/s"
    stats = lambda *rows: spark.createDataFrame(list(rows), "name string, rows long, failed long")
    snapshots.record_run(stats(("a", 1, 0), ("b", 2, 1)), base, 0)
    snapshots.record_run(stats(("b", 5, None), ("c", 3, 0)), base, 1)
    assert not snapshots.record_run(stats(("b", 99, 9)), base, 1)
    assert {tuple(r) for r in snapshots.read(spark, base).collect()} == {("a", 1, 0), ("b", 5, 1), ("c", 3, 0)}


def test_superseding_collects_links_and_drops_scores(spark):
    kinds = "id int, fingerprint string, source string, decision string, reason string, is_aggregator boolean, apply_url string, external_links map<string,string>, created_at int"
    rows = [
        (1, "f", "own", "KEEP", None, False, None, {"x": "old", "y": "stays"}, 5),
        (2, "f", "own", "KEEP", None, False, None, None, 4),
        (3, "f", "x", "KEEP", None, True, "new", None, 1),
        (4, "f", "x", "KEEP", None, True, "newest", None, 2),
        (5, "f", "z", "KEEP", None, True, None, None, 2),
        (6, "f", "w", "SKIP", "superseded by endpoint", True, "no", None, 2),
        (7, "g", "x", "KEEP", None, True, "alone", None, 2),
        (8, None, "x", "KEEP", None, True, "nameless", None, 2),
        (9, "h", "own", "KEEP", None, False, None, {"x": "old", "y": "stays"}, 1),
        (10, "h", "x", "KEEP", None, True, "new", {"p": "q"}, 1),
    ]
    scores = spark.createDataFrame([(k, k * 10) for k in range(1, 11)], "id int, score int")
    done, left = postings.supersede_with_links(spark.createDataFrame(rows, kinds), scores)
    found = {r["id"]: (r["decision"], r["external_links"]) for r in done.collect()}
    assert found[2] == ("KEEP", {"x": "newest"}) and found[1] == ("KEEP", {"x": "old", "y": "stays"})  # the first own row has them
    assert sorted(k for k, v in found.items() if v[0] == "SKIP") == [3, 4, 5, 6, 10]
    assert found[9][1] == {"x": "new", "y": "stays"} and found[10][1] == {"p": "q"} and len(found) == 10
    assert sorted(r["id"] for r in left.collect()) == [1, 2, 6, 7, 8, 9]


def test_nested_rows(spark):
    parts = spark.createDataFrame([(k % 3 or None, k, f"p{k}") for k in range(200)] + [(1, 4, None)], "key int, n int, name string")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    found = {r["key"]: r["parts"] for r in nesting.nested(rows, parts, "key", ["n", "name"], ["n", "name"], "parts").collect()}
    assert [p["n"] for p in found[2]] == list(range(2, 200, 3)) and found[3] == []
    assert [tuple(p) for p in found[1]][:3] == [(1, "p1"), (4, None), (4, "p4")]
