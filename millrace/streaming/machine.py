"""The relationship state machine on a stream of events, with timers of event time.

An event is settled when the watermark has passed it, in the order of (occurred_at, event_id) whatever the order of arrival;
until then state holds it. A contacted key that stays silent gets a GHOSTED_AUTO event of its own, once, at the end of
its silence: a timer fires when the watermark passes that time. An event that arrives behind the watermark is late and dropped,
since what it could change is out already. Events without a key or a time are dropped; repeated rows are events of their own.
Keys are dealt into buckets by hash: a call settles all keys of a bucket together, column by column, and state is a table for each
bucket, of one row for each key and one for each of its unsettled events. A bucket's timer is that of its first key.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.state import SILENCE, transition
from millrace.session import ship

#: Before and after all times (microseconds); NEVER also stands for no event_id, and for the time of a key's own row.
NEVER, ENDLESS = -(2**63), 2**63 - 1


def _packed(rows: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def advanced(rows: pd.DataFrame, key: str, mark: int, silence: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The log of what is settled before mark, and the rows that stay: (key, at, event_id, event_type, status, message, reply,
    deadline), where a key's own row has its status, its last message and reply, and when its silence ends."""
    waits = rows["at"].to_numpy() >= mark
    due, later = rows[~waits], rows[waits]
    if due.empty:
        return due, later
    codes = pd.factorize(due[key])[0]
    order = np.lexsort((due["event_id"].to_numpy(), due["at"].to_numpy(), codes))  # a key's own row comes first
    due, codes = due.iloc[order], codes[order]
    at, kind, status = (due[c].to_numpy() for c in ("at", "event_type", "status"))
    message, reply = (pd.Series(np.where(kind == k, at, due[c].to_numpy())).groupby(codes).cummax().to_numpy() for k, c in (("MESSAGE_SENT", "message"), ("REPLIED", "reply")))
    end = np.where((status == "CONTACTED") & (message > reply), np.maximum(at, message + silence), ENDLESS)
    deadline = np.where(at == NEVER, due["deadline"].to_numpy(), end)
    last = np.append(codes[1:] != codes[:-1], True)
    ghost = deadline < np.where(last, mark, np.roll(at, -1))
    ghosts = due[ghost].assign(at=deadline[ghost], event_id=NEVER, event_type="GHOSTED_AUTO", status="GHOSTED")
    own = due.assign(at=NEVER, event_id=NEVER, event_type="", status=np.where(ghost, "GHOSTED", status), message=message, reply=reply, deadline=np.where(ghost, ENDLESS, deadline))
    return pd.concat([due[at != NEVER], ghosts]), pd.concat([own[last], later])


def settled(events: DataFrame, delay: str = "1 day", silence: timedelta = SILENCE, key: str = "relationship_id", buckets: int = 1024) -> DataFrame:
    """The log of a stream of events (key, event_id, event_type, occurred_at, override): each event that leads to a status, and
    each ghost (without event_id), with the status after it. A checkpoint keeps its number of buckets."""
    ship(events.sparkSession)
    length = int(silence / timedelta(microseconds=1))
    led = events.withColumn("status", transition(F.col("event_type"), F.col("override"))).where(F.col("status").isNotNull() & F.col(key).isNotNull() & F.col("occurred_at").isNotNull())
    times = led.select(key, F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("at"), F.coalesce("event_id", F.lit(NEVER)).alias("event_id"), "event_type", "status")
    # the watermark stands one millisecond after the last event that it passes
    marked = times.withColumns({"due": F.timestamp_millis(F.floor(F.col("at") / 1000) + 1), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets))}).withWatermark("due", delay)
    log = T.StructType([T.StructField(key, events.schema[key].dataType), *T._parse_datatype_string("event_id long, event_type string, at long, status string").fields])
    columns = times.columns

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs() * 1000  # in microseconds; not above zero before the first one
        held = [_unpacked(state.get[0])] if state.exists else []
        new = [batch.loc[batch["at"] >= mark, columns].assign(message=NEVER, reply=NEVER, deadline=ENDLESS) for batch in batches]
        found = [rows for rows in (*held, *new) if not rows.empty]  # a timer comes with a batch that has no rows and no types
        if not found:
            return
        out, rows = advanced(pd.concat(found, ignore_index=True), key, mark, length)
        state.update((_packed(rows),))
        wait = int(np.where(rows["at"] == NEVER, rows["deadline"], rows["at"]).min())
        if wait < ENDLESS:
            state.setTimeoutTimestamp(max(1, wait // 1000))
        if not out.empty:
            yield out[log.names]

    out = marked.groupBy("bucket").applyInPandasWithState(run, log, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.nullif("event_id", F.lit(NEVER)).alias("event_id"), "event_type", F.timestamp_micros("at").alias("occurred_at"), "status")
