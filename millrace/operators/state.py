"""Event-sourced state, streaks and timers in batch form, as window functions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The status that an event leads to; other events leave it.
TRANSITIONS = {"MESSAGE_SENT": "CONTACTED", "REPLIED": "REPLIED", "CALL_BOOKED": "ENGAGED", "REFERRAL_GIVEN": "REFERRED", "INTERVIEW_OBTAINED": "INTERVIEW_OBTAINED", "GHOSTED_AUTO": "GHOSTED"}
FIRST_STATUS = "DISCOVERED"
#: The event that sets the status it names, and how long a contacted key may stay silent.
OVERRIDE, SILENCE = "STATUS_OVERRIDE", timedelta(days=14)


def transition(event: Column, override: Column | None = None) -> Column:
    out = None
    for kind, status in TRANSITIONS.items():
        out = F.when(event == kind, status) if out is None else out.when(event == kind, status)
    return out if override is None else out.when(event == OVERRIDE, override)


def replay(events: DataFrame, key: str = "relationship_id") -> DataFrame:
    """The last status of each key over its events (event_type, occurred_at, event_id), with the last contact and reply.
    Partial aggregation keeps one row for each key and task, however many events a key has."""
    order = F.struct("occurred_at", "event_id")
    led = F.struct(order.alias("at"), F.col("_status").alias("status"))
    marked = events.withColumn("_status", transition(F.col("event_type")))
    when = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("occurred_at")))
    out = marked.groupBy(key).agg(F.max(F.when(F.col("_status").isNotNull(), led)).alias("last"), when("MESSAGE_SENT").alias("last_contact_at"), when("REPLIED").alias("last_reply_at"), F.count("*").alias("events"))
    return out.select(key, F.coalesce("last.status", F.lit(FIRST_STATUS)).alias("status"), "last_contact_at", "last_reply_at", "events")


def ghosted_log(events: DataFrame, as_of: Column, silence: timedelta = SILENCE, key: str = "relationship_id") -> DataFrame:
    """The log of events (key, event_id, event_type, occurred_at, override) up to as_of: each that leads to a status, and a
    GHOSTED_AUTO event without event_id where a contacted key stayed silent for so long, with the status after it. The batch
    form of streaming.machine.settled: as_of is where its watermark stands. Times count in milliseconds there, so the end of a
    silence is compared in milliseconds."""
    status = transition(F.col("event_type"), F.col("override"))
    led = events.withColumn("status", status).where(F.col("status").isNotNull() & F.col(key).isNotNull() & F.col("occurred_at").isNotNull())
    order = W.partitionBy(key).orderBy("occurred_at", "event_id")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("occurred_at"))).over(so_far)
    seen = led.select(key, "event_id", "event_type", "occurred_at", "status", last("MESSAGE_SENT").alias("_m"), last("REPLIED").alias("_r"), F.lead("occurred_at").over(order).alias("_next"))
    silent = (F.col("status") == "CONTACTED") & F.col("_m").isNotNull() & (F.col("_r").isNull() | (F.col("_r") < F.col("_m")))
    end = F.greatest("occurred_at", F.col("_m") + F.lit(silence))
    due = silent & (F.col("_next").isNull() | (F.col("_end") < F.col("_next"))) & (F.date_trunc("millisecond", "_end") <= as_of)
    ghost = F.struct(F.lit(None).cast("long").alias("event_id"), F.lit("GHOSTED_AUTO").alias("event_type"), F.col("_end").alias("occurred_at"), F.lit("GHOSTED").alias("status"))
    own = F.struct("event_id", "event_type", "occurred_at", "status")
    rows = seen.withColumn("_end", end).select(key, F.explode(F.when(due, F.array(own, ghost)).otherwise(F.array(own))).alias("row"))
    return rows.select(key, "row.*")


def ghosts(states: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Contacted keys that have not replied for so many days."""
    silent = F.col("last_reply_at").isNull() | (F.col("last_reply_at") < F.col("last_contact_at"))
    return states.where((F.col("status") == "CONTACTED") & (F.col("last_contact_at") < as_of - F.make_interval(days=F.lit(days))) & silent)


def error_streaks(crawls: DataFrame, most: int = 10, bucket: str = "day") -> DataFrame:
    """Adds streak, the errors since the last success of an endpoint (rate limits count neither way), and deactivated.

    A segmented running count: each bucket of an endpoint's time counts for itself; what it ends with is carried over the
    buckets, of which an endpoint has as many as its history has days however many crawls it has; a bucket's rows before its first
    success add what was carried in. So no task has to hold more of an endpoint than a bucket. Whole numbers are seconds, in
    buckets of a day."""
    seconds = crawls.schema["crawled_at"].dataType.simpleString() in ("int", "bigint")
    at, within = F.floor(F.col("crawled_at") / 86_400) if seconds else F.date_trunc(bucket, "crawled_at"), ["endpoint_id", "_bucket"]
    so_far = W.partitionBy(*within).orderBy("crawled_at", "crawl_id").rowsBetween(W.unboundedPreceding, 0)
    run = W.partitionBy(*within, "_island").orderBy("crawled_at", "crawl_id").rowsBetween(W.unboundedPreceding, 0)
    inner = crawls.withColumn("_bucket", at).withColumn("_island", F.count_if(F.col("status") == "SUCCESS").over(so_far)).withColumn("_own", F.count_if(F.col("status") == "ERROR").over(run))
    ends = inner.groupBy(*within).agg(F.max("_island").alias("_wins"), F.max_by("_own", F.struct("_island", "_own")).alias("_tail"))
    buckets = W.partitionBy("endpoint_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    marked = ends.withColumn("_reset", F.count_if(F.col("_wins") > 0).over(buckets))
    before = W.partitionBy("endpoint_id").orderBy("_bucket")
    since = W.partitionBy("endpoint_id", "_reset").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    carried = marked.withColumn("_carry", F.sum("_tail").over(since)).withColumn("_in", F.coalesce(F.lag("_carry").over(before), F.lit(0).cast("long"))).select(F.col("endpoint_id").alias("_e"), F.col("_bucket").alias("_b"), "_in")
    same = F.col("endpoint_id").eqNullSafe(F.col("_e")) & F.col("_bucket").eqNullSafe(F.col("_b"))
    out = inner.join(carried, same).withColumn("streak", F.col("_own") + F.when(F.col("_island") == 0, F.col("_in")).otherwise(0))
    return out.withColumn("deactivated", F.col("streak") >= most).drop("_bucket", "_island", "_own", "_e", "_b", "_in")


def overdue(follow_ups: DataFrame, as_of: Column) -> DataFrame:
    """Pending follow-ups whose day has passed are overdue."""
    late = (F.col("status") == "PENDING") & (F.col("scheduled_date") < as_of)
    return follow_ups.withColumn("status", F.when(late, "OVERDUE").otherwise(F.col("status")))
