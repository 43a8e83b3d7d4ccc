"""Versioned tables: a run writes a new version beside the old ones, then switches a pointer to it.

Readers follow the pointer, so they see one whole version or the one before; a run that fails between the writing and the switch
leaves the old version in place, and its repetition writes the version anew. Versions are named by batch, so a batch that was
published before is not published again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.postings import upsert
from millrace.session import delete

_POINTER, _LOCK = "current", "running"


class AlreadyRunning(RuntimeError):
    """Another run holds the table."""


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, overwrite)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _version(base: str, batch: int) -> str:
    return f"{base.rstrip('/')}/version-{batch}"


def _switch(spark: SparkSession, base: str, batch: int) -> None:
    """Names the batch in the pointer by one rename, which is atomic where the file system's renames are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new = f"{base.rstrip('/')}/.{_POINTER}-{uuid.uuid4().hex}"
    _write(spark, new, str(batch))
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (new, f"{base.rstrip('/')}/{_POINTER}"))
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, kinds)


def current(spark: SparkSession, base: str) -> int | None:
    """The batch that readers see."""
    found = _read(spark, f"{base.rstrip('/')}/{_POINTER}")
    return None if found is None else int(found)


def read(spark: SparkSession, base: str) -> DataFrame:
    """The table as its current version has it."""
    batch = current(spark, base)
    if batch is None:
        raise ValueError(f"nothing is published at {base}")
    return spark.read.parquet(_version(base, batch))


def publish(df: DataFrame, base: str, batch: int, keep: int = 2) -> bool:
    """Makes df the table's version of that batch; False if the table is at that batch, or a later one, already. The last
    versions stay for readers that began before the switch; older ones go."""
    spark = df.sparkSession
    before = current(spark, base)
    if before is not None and before >= batch:
        return False
    df.write.mode("overwrite").parquet(_version(base, batch))
    _switch(spark, base, batch)
    fs, where = _fs(spark, base)
    numbers = sorted(int(s.getPath().getName().removeprefix("version-")) for s in fs.listStatus(where) if s.getPath().getName().startswith("version-"))
    for old in [n for n in numbers if n <= batch][:-keep]:
        delete(spark, _version(base, old))
    return True


def run(df: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there; each batch's complete result becomes the table's next version, also where a batch is repeated
    after a failure."""

    def step(batch: DataFrame, number: int) -> None:
        publish(batch, base, number)

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


@contextmanager
def single_flight(spark: SparkSession, base: str, stale: float = 4 * 3600) -> Iterator[None]:
    """Lets one run at a time work on a table: the second one gets AlreadyRunning. A lock whose run has not released it for
    so many seconds counts as left behind."""
    path = f"{base.rstrip('/')}/{_LOCK}"
    held = _read(spark, path)
    if held is not None and time.time() - float(held) > stale:
        delete(spark, path)
    try:
        _write(spark, path, str(time.time()), overwrite=False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            raise AlreadyRunning(base) from None
        raise
    try:
        yield
    finally:
        delete(spark, path)


def record_run(stats: DataFrame, base: str, batch: int, keys: list[str] = ["name"]) -> bool:  # noqa: B006
    """Upserts a run's statistics by their unique name into the table of statistics; a batch counts once. Names that the run
    doesn't know keep what they had, and its nulls leave old values."""
    spark = stats.sparkSession
    rows = stats.groupBy(*keys).agg(*[F.max(c).alias(c) for c in stats.columns if c not in keys]) if stats.columns != keys else stats.distinct()
    known = read(spark, base) if current(spark, base) is not None else rows.limit(0)
    return publish(upsert(known, rows, keys), base, batch)
