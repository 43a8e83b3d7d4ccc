"""Token ids in ORC files: one row for each document, in ascending order of doc_id over the files in their order.

The ids stand as integers, which ORC stores run-length encoded; each stripe has row indexes, and Bloom filters on doc_id,
so that a reader of some documents skips files, stripes and row groups, and tasks read stripes in parallel.
Null text counts as empty and gives the end id alone. Rows of null doc_id come first. Rows of the same doc_id follow one
another, each with its own start. A very long text is one row. Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import bpe, tokens
from millrace.session import ship

#: Rows that one entry of the row index and of the Bloom filter covers; bytes of a stripe.
ROW_GROUP, STRIPE = 1_000, 16 << 20
#: Pieces of text that an encoder keeps here.
KEPT = 700_000
#: Ranges of doc_id for each partition that the input is read in, which is a fixed number of bytes of files.
RANGES = 2
#: Files whose token counts are broadcast, at some 20 bytes each; more of them are joined.
MAX_FILES = 50_000
FILE_SCHEMA = "doc_id long, start_in_file long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1) -> None:
    """Encodes docs (doc_id, text) and writes the files. Texts are dealt out by ranges of doc_id, then encoded."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    ranges = max(RANGES * docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(ranges, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc, total = tokens.encoder(vocabulary, KEPT), 0
        for batch in batches:
            for a, b, texts in bpe.slices(batch.column("text")):
                encoded = [x + tail for x in enc.ids(texts)]
                n = np.array([len(x) // 4 for x in encoded], np.int64)
                start = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(start), pa.array(n), bpe.ids_array(encoded, pa.list_(pa.int32()))], names=["doc_id", "start_in_file", "n_tokens", "ids"])

    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(ROW_GROUP), "orc.stripe.size": str(STRIPE)}
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**options).orc(path)


def rows_of(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files as they stand, with the number of the file."""
    return spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int"))


def with_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows with start, from start_in_file and the ids in the files before. files are all rows of the files, of which only
    the counts are read; what is joined has one row for each file, and is broadcast up to MAX_FILES of them."""
    ends = files.groupBy("file").agg(F.max(F.col("start_in_file") + F.col("n_tokens")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = ends.select("file", before.alias("_before"))
    small = len(files.inputFiles()) <= MAX_FILES
    joined = rows.join(F.broadcast(offsets) if small else offsets, "file")
    return joined.withColumn("start", F.col("start_in_file") + F.col("_before")).drop("file", "start_in_file", "_before")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents in the files. A filter on doc_id reaches the ORC reader."""
    rows = rows_of(spark, path)
    return with_start(rows, rows).select("doc_id", "start", "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the documents in the files."""
    ship(spark)
    kept = ["doc_id", "start_in_file", "n_tokens", "file"]

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            values = memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    rows = rows_of(spark, path)
    sums = rows.mapInArrow(run, "doc_id long, start_in_file long, n_tokens long, file int, ids_crc32 long")
    return with_start(sums, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
