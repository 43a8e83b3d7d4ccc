from pyspark.sql import functions as F

from millrace.operators import analytics, postings, state
from millrace.plans.bindings import STAGES, relationship_events
from millrace.streaming import relationships, snapshots


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = relationships.latest_status(relationship_events(stream))
    query = relationships.run_available(out, f"{tmp_path}/out", f"{tmp_path}/cp", "complete")
    assert query.awaitTermination(120)
    got = {tuple(r) for r in snapshots.read(spark, f"{tmp_path}/out").select("relationship_id", "status", "events").collect()}
    assert got == {tuple(r) for r in state.replay(relationship_events(batch)).select("relationship_id", "status", "events").collect()}


def test_stream_ingests_each_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(k % 10, k) for k in range(40)], "external_id long, n long").withColumn("at", F.timestamp_seconds(F.col("n")))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = relationships.run_available(relationships.once_per_key(stream, ["external_id"], "at", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert query.awaitTermination(120)
    found = [r["external_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(found) == list(range(10))


def test_funnel_fixture(spark):
    apps = spark.sql("SELECT 1 AS application_id, DATE '2024-03-01' AS applied_date UNION ALL SELECT 2, DATE '2024-03-15'")
    outs = spark.createDataFrame([(1, "SCREEN", "2024-03-05"), (1, "TECHNICAL", "2024-03-10"), (2, "SCREEN", "2024-03-20"), (2, "OFFER", "2024-04-01")], "application_id int, stage string, d string").select("application_id", "stage", F.col("d").cast("date").alias("occurred_at"))
    row = analytics.outcome_funnel(apps, outs, STAGES).first()
    assert (row["applications"], row["recruiter_screen"], row["technical"], row["offers"], row["applications_to_recruiter_screen"]) == (2, 2, 1, 1, 1.0)
    assert analytics.stage_gaps(apps, outs, STAGES).first()["days_to_recruiter_screen"] == 4.5
    empty = analytics.outcome_funnel(apps.limit(0), outs, STAGES).first()
    assert (empty["applications"], empty["applications_to_recruiter_screen"]) == (0, 0.0)


def test_ingestion_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "s", "a"), (2, "s", "a"), (3, "s", ""), (4, "s", None), (5, "s", "b")], "id int, source string, external_id string")
    none = batch.limit(0)
    first = {r["id"]: r["outcome"] for r in postings.ingest_outcomes(batch, none, ["id"]).collect()}
    assert first == {1: "created", 2: "duplicate", 3: "error", 4: "error", 5: "created"}
    again = postings.ingest_outcomes(batch, batch, ["id"]).where("outcome = 'created'")
    assert again.count() == 0


def test_streaks(spark):
    said = ["ERROR", "ERROR", "RATE_LIMITED", "SUCCESS", "ERROR"]
    rows = spark.createDataFrame([(k, 1, k, s) for k, s in enumerate(said)], "crawl_id int, endpoint_id int, crawled_at int, status string")
    assert [r["streak"] for r in state.error_streaks(rows, 2).orderBy("crawl_id").collect()] == [1, 2, 2, 0, 1]
