"""How filters of a corpus interact: what each removes, alone and after the others, for every order of applying them.

Copies are found by an RDD that is routed by fingerprint. A task first settles what it can by itself: of the rows of one text
only those of the least doc_id go on, the others fail. So a text travels at most once for each task and HELD bytes of texts,
however many copies it has. What goes on is partitioned by the xxhash of its text and sorted by it; the texts that share a
hash form a chain with each whole text and its least doc_id, and rows of greater ids fail. Masks of failed filters are then
counted in one vector for each part by combineByKey; the orders are worked out on the vectors.

Null text counts as empty, a null part as the empty string. A row without doc_id is no other's copy and has none. Rows that
repeat a doc_id and its text are both kept by E and travel as one; labels of one doc_id count as one, the greater value of each kind. An empty table gives
no rows; extra columns are ignored, whatever their names. A very long text is held whole by the tasks that meet it.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
#: Bytes of text that a task holds before it sends on what it has, and that a partition of the routing has on average.
HELD, ROUTED = 32 << 20, 32 << 20
_COPY = 1 << FILTERS.index("E")
_MASKS = 1 << len(FILTERS)
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"
_NOT_MARKS = bytes(b for b in range(256) if b not in _MARKS)
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: doc_id, part, mask of failed filters, number of such rows
Row = tuple[int | None, str, int, int]
#: Rows of the least doc_id of a text: that id, the mask, and how many rows each part has.
Least = tuple[int, int, Counter]


def mask(text: str, data: bytes) -> int:
    """The filters A to D that a text fails, as bits; data is its UTF-8. bytes.split() splits at [\\x20\\x09-\\x0D]."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), bool(data.translate(None, _NOT_MARKS)))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _settled(rows: Iterator) -> Iterator[tuple[int, tuple[Row, bytes | None]]]:
    """Rows by fingerprint, those of the task's least doc_id of a text with the text. The others are decided: they fail E, and
    go without their text to wherever their doc_id leads. Rows that are alike go as one."""
    held: dict[bytes, tuple[int, Least]] = {}
    nameless: Counter = Counter()
    size = 0
    for doc_id, text, part, fingerprint in rows:
        data = text.encode()
        failed = mask(text, data)
        if doc_id is None:
            nameless[part, failed] += 1
            continue
        if data not in held:
            size += len(data)
        fingerprint, least = held.get(data, (fingerprint, None))
        least, decided = _met(least, (doc_id, failed, Counter({part: 1})))
        yield from ((mix64(row[0]), (row, None)) for row in decided)
        held[data] = fingerprint, least
        if size > HELD:
            yield from _sent(held)
            size = 0
    yield from _sent(held)
    yield from ((mix64(k), ((None, *x, n), None)) for k, (x, n) in enumerate(nameless.items()))


def mix64(number: int) -> int:
    """A number that spreads over partitions where consecutive or evenly spaced numbers mightn't."""
    return number * 0x9E3779B97F4A7C15 >> 17 & 0xFFFFFFFF


def _met(one: Least | None, other: Least) -> tuple[Least, list[Row]]:
    """The least of two rows (or heaps of rows) of one text, and the rows that fail E since the other has a smaller id."""
    if one is None:
        return other, []
    if one[0] == other[0]:
        return (one[0], one[1], one[2] + other[2]), []
    least, more = (one, other) if one[0] < other[0] else (other, one)
    return least, _rows(more, _COPY)


def _rows(least: Least, also: int = 0) -> list[Row]:
    doc_id, failed, parts = least
    return [(doc_id, part, failed | also, n) for part, n in parts.items()]


def _sent(held: dict[bytes, tuple[int, Least]]) -> Iterator[tuple[int, tuple[Row, bytes]]]:
    for data, (fingerprint, least) in held.items():
        yield from ((fingerprint, (row, data)) for row in _rows(least))
    held.clear()


def _decided(rows: Iterator[tuple[int, tuple[Row, bytes | None]]]) -> Iterator[Row]:
    """Of rows in order of their fingerprint: each with E decided. A chain holds the texts of one fingerprint."""
    for _, group in itertools.groupby(rows, key=lambda kv: kv[0]):
        chain: dict[bytes, Least] = {}
        for _, (row, data) in group:
            if data is None:
                yield row
                continue
            doc_id, part, failed, n = row
            chain[data], decided = _met(chain.get(data), (doc_id, failed, Counter({part: n})))
            yield from decided
        for least in chain.values():
            yield from _rows(least)


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask of failed filters (bit 0: A) and n, the number of such rows. The routing has as many partitions as
    the session's shuffles, or more where the texts, whose bytes are summed first, need them."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", text, F.coalesce(part, F.lit("")).alias("part")).withColumn("fingerprint", F.xxhash64("text")).rdd
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    routed = rows.mapPartitions(_settled).repartitionAndSortWithinPartitions(n, lambda fingerprint: fingerprint)
    return spark.createDataFrame(routed.mapPartitions(_decided), "doc_id long, part string, mask int, n long", verifySchema=False)


def _first(cell: tuple[int, int]) -> np.ndarray:
    return _more(np.zeros(4 * _MASKS, np.int64), cell)


def _more(counts: np.ndarray, cell: tuple[int, int]) -> np.ndarray:
    counts[cell[0]] += cell[1]
    return counts


def effects(counts: np.ndarray) -> Iterator[tuple]:
    """The rows of RESULT without the part, from the counts by mask, good and toxic."""
    counts = counts.reshape(_MASKS, 2, 2)
    all_, good, toxic = counts.sum((1, 2)), counts[:, 1].sum(1), counts[:, :, 1].sum(1)
    bits = np.arange(_MASKS)
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        before = 0
        for k, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, gone = bits & bit > 0, bits & before > 0
            here = fails & ~gone
            shapley[letter] += int(all_[here].sum())
            before |= bit
            steps.append((order, k + 1, all_[bits & before == 0].sum(), all_[here].sum(), all_[fails & gone].sum(), all_[bit], good[here].sum(), toxic[here].sum()))
    for order, step, *numbers in steps:
        yield order, step, *map(int, numbers), shapley[order[step - 1]]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """RESULT: for each part, order of the filters and step, what the step's filter does there."""
    spark = docs.sparkSession
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    cell = (4 * F.col("mask") + 2 * F.coalesce("good", F.lit(0)) + F.coalesce("toxic", F.lit(0))).alias("cell")
    cells = masks(docs, part).join(known, "doc_id", "left").select("part", cell, "n").rdd
    per_part = cells.map(lambda r: (r[0], (r[1], r[2]))).combineByKey(_first, _more, np.add, partitionFunc=lambda p: zlib.crc32(p.encode()))
    return spark.createDataFrame(per_part.flatMap(lambda kv: ((kv[0], *x) for x in effects(kv[1]))), RESULT, verifySchema=False)


def oracle(part: str = "lang") -> str:
    """The audit as SQL over documents and labels."""
    letters = " UNION ALL ".join(f"SELECT '{c}' AS c, {1 << k} AS b" for k, c in enumerate(FILTERS))
    at = ", ".join(f"x{k}.c AS c{k}, x{k}.b AS b{k}" for k in range(5))
    distinct = " AND ".join(f"x{i}.b <> x{j}.b" for i, j in itertools.combinations(range(5), 2))
    steps = " UNION ALL ".join(f"SELECT filter_order, {k + 1} AS step, c{k} AS c, b{k} AS b, {' + '.join(f'b{j}' for j in range(k)) or '0'} AS before FROM orders_" for k in range(5))
    return f"""
WITH letters AS ({letters}),
orders_ AS (SELECT x0.c || x1.c || x2.c || x3.c || x4.c AS filter_order, {at}
  FROM letters x0, letters x1, letters x2, letters x3, letters x4 WHERE {distinct}),
steps AS ({steps}),
d AS (SELECT doc_id, coalesce({part}, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
r AS (SELECT part, filter_order, step, c,
    sum(CASE WHEN mask & (before + b) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & b > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & b > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM r"""


assert len(ORDERS) == math.factorial(len(FILTERS))
