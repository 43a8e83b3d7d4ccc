"""Count vectors over a whole table: summed inside tasks, then over tasks in two streaming steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.session import ship

#: Tasks that sum the vectors of the first ones.
MIDDLE = 16
_ROWS = "slot int, counts binary"


def _emit(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([row.tobytes() for row in total], pa.binary())], names=["slot", "counts"])


def count_vectors(df: DataFrame, shape: tuple[int, int], add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all batches of what add(batch, total) adds to a matrix of shape (slots, buckets). Each task holds one
    matrix, and one matrix reaches the driver, whatever the size of df."""
    ship(df.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            add(batch, total)
        yield _emit(total)

    def then(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for slot, counts in zip(batch.column("slot").to_pylist(), batch.column("counts"), strict=True):
                total[slot] += np.frombuffer(counts.as_buffer(), np.int64)
        yield _emit(total)

    rows = df.mapInArrow(first, _ROWS).repartition(MIDDLE).mapInArrow(then, _ROWS).coalesce(1).mapInArrow(then, _ROWS).collect()
    out = np.zeros(shape, np.int64)
    for r in rows:
        out[r["slot"]] += np.frombuffer(r["counts"], np.int64)
    return out
