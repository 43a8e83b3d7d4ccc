"""Structured Streaming forms of relationship state and of idempotent ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.state import FIRST_STATUS, transition
from millrace.streaming import snapshots


def latest_status(events: DataFrame, key: str = "relationship_id") -> DataFrame:
    """The running status of each key: a streaming aggregation that keeps one struct for each key."""
    order = F.struct("occurred_at", "event_id")
    status = transition(F.col("event_type"))
    last = F.max(F.when(status.isNotNull(), F.struct(order.alias("at"), status.alias("status")))).alias("last")
    return events.groupBy(key).agg(last, F.count("*").alias("events")).select(key, F.coalesce("last.status", F.lit(FIRST_STATUS)).alias("status"), "events")


def once_per_key(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once, its repetitions within the delay dropped."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there, exactly once, then ends: into Parquet files, or, where the result is complete each time, into a
    versioned table that snapshots.read reads."""
    if mode != "complete":
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

    return snapshots.run(df, path, checkpoint)
