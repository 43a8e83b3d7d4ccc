"""The relationship machine on a stream against its batch form and a plain replay; error streaks of a hot endpoint."""

import datetime
import random

from millrace.operators import state
from millrace.plans import bindings as b
from millrace.streaming import machine, relationships
from pyspark.sql import functions as F

ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
EVENTS = "relationship_id long, event_id long, event_type string, occurred_at timestamp, override string"


def drawn(n, keys=40, days=120):
    draw = random.Random(n)
    kinds = ["MESSAGE_SENT", "REPLIED", "STATUS_OVERRIDE", "CALL_BOOKED", "NOTE", "GHOSTED_AUTO"]
    rows = []
    for k in range(n):
        kind = draw.choice(kinds)
        rows.append((draw.randrange(keys), k, kind, ZERO + datetime.timedelta(seconds=draw.randrange(days * 24) * 3600), draw.choice(["CONTACTED", "ENGAGED"]) if kind == "STATUS_OVERRIDE" else None))
    return sorted(rows, key=lambda r: r[3])


def replayed(rows, as_of):
    """The log in plain Python, a key after the other."""
    log = []
    for key in {r[0] for r in rows}:
        status = message = reply = deadline = None
        for _, event_id, kind, at, override in sorted((r for r in rows if r[0] == key), key=lambda r: (r[3], r[1])):
            to = {"MESSAGE_SENT": "CONTACTED", "REPLIED": "REPLIED", "CALL_BOOKED": "ENGAGED", "GHOSTED_AUTO": "GHOSTED", "STATUS_OVERRIDE": override}.get(kind)
            if to is None:
                continue
            if deadline and deadline < at:
                log.append((key, None, "GHOSTED_AUTO", deadline, "GHOSTED"))
            message, reply, status = (at if kind == "MESSAGE_SENT" else message), (at if kind == "REPLIED" else reply), to
            silent = status == "CONTACTED" and message and (not reply or reply < message)
            deadline = max(at, message + datetime.timedelta(days=14)) if silent else None
            log.append((key, event_id, kind, at, to))
        if deadline and deadline <= as_of:
            log.append((key, None, "GHOSTED_AUTO", deadline, "GHOSTED"))
    return sorted(log, key=str)


def plain(df):
    rows = df.withColumn("t", F.unix_micros("occurred_at")).collect()
    return sorted(((r["relationship_id"], r["event_id"], r["event_type"], ZERO + datetime.timedelta(microseconds=r["t"] - 1_704_067_200_000_000), r["status"]) for r in rows), key=str)


def run(spark, folder, tmp_path, delay="0 seconds", **options):
    stream = spark.readStream.schema(EVENTS).options(**options).parquet(f"{folder}")
    assert relationships.run_available(machine.settled(stream, delay), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination(180)
    return plain(spark.read.parquet(f"{tmp_path}/out"))


def leading_end(rows):
    return max(r[3] for r in rows if r[2] != "NOTE")


def test_batch_equals_plain_replay(spark):
    rows = drawn(300)
    df = spark.createDataFrame(rows, EVENTS)
    end = leading_end(rows)
    log = plain(state.ghosted_log(df, F.lit(end)))
    assert log == replayed(rows, end) and sum(r[1] is None for r in log) > 5


def test_stream_equals_batch_and_restarts_emit_nothing_twice(spark, tmp_path):
    rows = drawn(301)
    folder = f"{tmp_path}/in"
    half = len(rows) // 2
    spark.createDataFrame(rows[:half], EVENTS).coalesce(1).write.parquet(folder)
    first = run(spark, folder, tmp_path)
    assert first == replayed(rows[:half], leading_end(rows[:half]))
    assert run(spark, folder, tmp_path) == first  # nothing new has come
    spark.createDataFrame(rows[half:], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    assert run(spark, folder, tmp_path) == replayed(rows, leading_end(rows))


def test_disorder_within_the_delay_changes_nothing(spark, tmp_path):
    """A file holds every fifth event of some days, so that batches overlap; later files go a little back in time."""
    rows = drawn(200)
    folder = f"{tmp_path}/in"
    days = datetime.timedelta(days=30)
    for part in range(4):
        window = [r for r in rows if part * days <= r[3] - ZERO < (part + 1) * days]
        for k in range(2):
            spark.createDataFrame(window[k::2], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    found = run(spark, folder, tmp_path, "40 days", maxFilesPerTrigger="1")
    passed = leading_end(rows) - datetime.timedelta(days=40)
    assert found == replayed([r for r in rows if r[3] <= passed], passed)


def test_late_events_are_dropped(spark, tmp_path):
    at = lambda d: ZERO + datetime.timedelta(days=d)
    folder = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, "MESSAGE_SENT", at(0), None), (2, 2, "REPLIED", at(30), None)], EVENTS).coalesce(1).write.parquet(folder)
    first = run(spark, folder, tmp_path)
    assert (1, None, "GHOSTED_AUTO", at(14), "GHOSTED") in first
    spark.createDataFrame([(1, 3, "REPLIED", at(10), None), (1, 4, "REPLIED", at(31), None), (None, 5, "REPLIED", at(32), None), (1, 6, "REPLIED", None, None)], EVENTS).coalesce(1).write.mode("append").parquet(folder)
    second = run(spark, folder, tmp_path)
    assert [r for r in second if r not in first] == [(1, 4, "REPLIED", at(31), "REPLIED")]


def test_state_has_no_more_rows_than_buckets(spark, tmp_path):
    """Calls and state rows are of buckets, however many keys there are."""
    rows = [(k, 2 * k + n, kind, ZERO + datetime.timedelta(days=n * 20, minutes=k), None) for k in range(3000) for n, kind in enumerate(("MESSAGE_SENT", "REPLIED"))]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(folder)
    query = relationships.run_available(machine.settled(spark.readStream.schema(EVENTS).parquet(folder), "0 seconds"), f"{tmp_path}/out", f"{tmp_path}/log")
    assert query.awaitTermination(180)
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == replayed(rows, leading_end(rows))


def test_keys_of_a_bucket_do_not_mix(spark, tmp_path):
    """Keys that are texts in two buckets, events without a number, and a restart, against the batch form."""
    schema = EVENTS.replace("relationship_id long", "relationship_id string")
    rows = [(f"key {r[0]}", None if r[1] % 7 == 0 else r[1], *r[2:]) for r in drawn(302)]
    folder, half = f"{tmp_path}/in", len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        log = machine.settled(spark.readStream.schema(schema).parquet(folder), "0 seconds", buckets=2)
        assert relationships.run_available(log, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination(180)
    found = plain(spark.read.parquet(f"{tmp_path}/out"))
    assert found == plain(state.ghosted_log(spark.createDataFrame(rows, schema), F.lit(leading_end(rows)))) and len({r[0] for r in found}) == 40


def test_query_has_ghosts(spark, sf):
    log = b.machine_events(spark.read.parquet(f"{sf}/events.parquet"))
    assert plain(state.ghosted_log(log, F.lit("2030-01-01").cast("timestamp")))  # every silence has ended by then
    assert log.where("event_type = 'NOTE'").count() > 0


def test_streaks_of_a_hot_endpoint_equal_a_plain_count(spark):
    """One endpoint has a third of all rows, over many days; some days have no success."""
    draw = random.Random(8)
    rows = []
    for k in range(3000):
        endpoint = None if k % 50 == 0 else 0 if k % 3 == 0 else draw.randrange(1, 40)
        rows.append((k, endpoint, ZERO + datetime.timedelta(minutes=draw.randrange(40 * 1440)), draw.choice(["ERROR"] * 12 + ["RATE_LIMITED"] * 4 + ["SUCCESS"])))
    want, streak = {}, {}
    for crawl_id, endpoint, _, status in sorted(rows, key=lambda r: (r[2], r[0])):
        streak[endpoint] = 0 if status == "SUCCESS" else streak.get(endpoint, 0) + (status == "ERROR")
        want[crawl_id] = streak[endpoint]
    df = spark.createDataFrame(rows, "crawl_id long, endpoint_id long, crawled_at timestamp, status string")
    for bucket in ("day", "hour", "year"):
        found = state.error_streaks(df, 10, bucket).collect()
        assert {r["crawl_id"]: r["streak"] for r in found} == want
        assert all(r["deactivated"] == (r["streak"] >= 10) for r in found)


def test_no_window_holds_more_than_a_bucket(spark):
    rows = spark.range(3000).select(F.col("id").alias("crawl_id"), F.lit(1).alias("endpoint_id"), F.timestamp_seconds(F.col("id") * 3600).alias("crawled_at"), F.lit("ERROR").alias("status"))
    plan = state.error_streaks(rows)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    over_rows = [line for line in windows if "crawled_at#" in line.rsplit(", [", 1)[1]]  # sorted by the crawls' own time
    assert len(over_rows) >= 2 and all("_bucket#" in line.rsplit(", [", 2)[1] for line in over_rows)
    assert state.error_streaks(rows).agg(F.max("streak")).first()[0] == 3000
