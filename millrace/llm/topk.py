"""Exact top-k inner products: vectors in blocks by descending length, pruned by Cauchy-Schwarz bounds.

Vectors are turned by the singular vectors of the whole table, so that leading coordinates hold most of a product. Products
are summed part by part; one can be no more than its partial sum plus the product of the remaining lengths. What the bounds
leave is multiplied exactly, in whole numbers. A table without a query block's candidates left by the bounds moves no data.
The matrix of all coordinates' products reaches the driver: the square of the width, whatever the number of rows.

Vectors that are null or hold null or non-finite components take no part, nor do rows of null id. Shorter vectors count as
filled up with zeros. A query is compared with all rows of other ids; rows of a repeated id are separate candidates, and a
repeated query row is answered once. Ties go to the smaller id. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.vectors import count_vectors
from millrace.session import ship, stored

#: Rows of a block of candidates and of one pruning step, queries of a block, candidates that give the first thresholds.
BLOCK, STEP, QUERIES, SEEDS = 4096, 512, 1024, 1024
#: Partial sums take so many equal parts of the rotated coordinates, one after the other; the bounds' allowance for rounding.
PARTS, SLACK = 4, 1e-9
#: Blocks of candidates that one task compares with a block of queries.
GRID = 16


def whole(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    ends = np.asarray(column.offsets)
    out, sizes = np.zeros((len(column), width), np.int64), np.diff(ends)
    values = np.asarray(column.values)[ends[0] : ends[-1]]
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; in floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The k best candidates of each query of a block, over blocks of candidates that come one after the other."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, bound: np.ndarray, turn: np.ndarray, k: int):
        self.q, self.ids, self.bound, self.turn, self.k = q, ids, bound.copy(), turn, k
        self.edges = np.unique(np.linspace(0, q.shape[1], PARTS + 1).astype(int))
        self.turned, self.rest = self._rotate(q)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)

    def _rotate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rotated vectors, and the length of what each has from each edge on (at edge 0: its whole length)."""
        turned = x @ self.turn
        return turned, np.stack([np.linalg.norm(turned[:, e:], axis=1) for e in self.edges], 1)

    def add(self, c: np.ndarray, ids: np.ndarray) -> None:
        """Candidates, by descending length. Products grow by one part of the coordinates at a time; after each part a
        candidate that no query of the block can use goes: a product is at most its partial sum plus the product of both
        remaining lengths. The bounds rise with what is found."""
        turned, rest = self._rotate(c)
        for at in range(0, len(c), STEP):
            longest = rest[at, 0]
            alive = np.flatnonzero(self.rest[:, 0] * longest * (1 + SLACK) + SLACK >= self.bound)
            if not len(alive):
                return
            columns = np.arange(at, min(at + STEP, len(c)))
            bound = self.bound[alive, None] - SLACK * (1 + self.rest[alive, :1] * longest)
            sums = np.zeros((len(alive), len(columns)))
            for n, (low, high) in enumerate(itertools.pairwise(self.edges), 1):
                sums += self.turned[alive, low:high] @ turned[columns, low:high].T
                maybe = sums + self.rest[alive, n, None] * rest[columns, n] >= bound
                some = maybe.any(0)
                columns, sums, maybe = columns[some], sums[:, some], maybe[:, some]
                if not len(columns):
                    break
            else:
                self._keep(alive, maybe, products(self.q[alive], c[columns]), ids[columns])

    def _keep(self, alive: np.ndarray, maybe: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        for row, who in enumerate(alive):
            take = maybe[row] & (ids != self.ids[who]) & (scores[row] >= self.bound[who])
            if take.any():
                own, values = np.concatenate([self.found[who][0], ids[take]]), np.concatenate([self.found[who][1], scores[row, take]])
                keep = best(values, own, self.k)
                self.found[who] = own[keep], values[keep]
                if len(keep) == self.k:
                    self.bound[who] = max(self.bound[who], values[keep[-1]])

    def rows(self) -> pa.RecordBatch:
        n = [len(ids) for ids, _ in self.found]
        out = [np.repeat(self.ids, n), *(np.concatenate([f[j] for f in self.found]) for j in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that is_query holds for, the k highest whole-number products."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = stored(spark, rows.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x))), "vectors")
    total, asked, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("x"))).first()
    width = max(1, width or 0)

    def gram(batch: pa.RecordBatch, out: np.ndarray) -> None:
        m = _matrix(batch.column("x"), width).astype(np.float64)
        out += np.rint(np.clip(m.T @ m, -(2**52), 2**52)).astype(np.int64)  # only steers the rotation

    turn = np.linalg.svd(count_vectors(rows.select("x"), (width, width), gram).astype(np.float64))[0]
    seeds = rows.orderBy(F.desc("length"), "id").limit(SEEDS).select("id", "x").collect()
    seed_ids = np.array([r["id"] for r in seeds], np.int64)
    seed_rows = np.array([r["x"] + [0] * (width - len(r["x"])) for r in seeds], np.int64).reshape(-1, width)
    shared = spark.sparkContext.broadcast((turn, seed_ids, seed_rows))

    def pack(batches):
        """Sorted rows as blocks."""
        left, made, task = None, 0, TaskContext.get().partitionId()
        for batch in [*batches, None]:
            part = None if batch is None else pa.Table.from_batches([batch])
            left = part if left is None else left if part is None else pa.concat_tables([left, part])
            while left is not None and left.num_rows and (left.num_rows >= BLOCK or batch is None):
                now, left = left.slice(0, BLOCK).combine_chunks(), left.slice(BLOCK)
                x = _matrix(now["x"].chunk(0), width)
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | made]), pa.array([float(now["length"][0].as_py())]), pa.array([now["id"].to_numpy().tobytes()]), pa.array([x.tobytes()])], names=["candidates", "longest", "ids", "data"])
                made += 1

    def first_bounds(batches):
        """Blocks of queries, with the score that the k-th best of the longest candidates has at least."""
        _, ids, data = shared.value
        for batch in batches:
            for n, row in enumerate(batch.column("rows").to_pylist()):
                own = np.array([r["id"] for r in row], np.int64)
                q = np.array([r["x"] + [0] * (width - len(r["x"])) for r in row], np.int64)
                scores = products(q, data).astype(np.float64)
                scores[own[:, None] == ids] = -np.inf
                bound = np.sort(scores, 1)[:, -k] if len(ids) >= k else np.full(len(q), -np.inf)
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                reach = np.where(bound <= 0, 0.0, bound / np.maximum(length, 1e-300)).min()
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(n, 1), pa.array([float(reach)]), pa.array([own.tobytes()]), pa.array([q.tobytes()]), pa.array([bound.tobytes()])], names=["block", "reach", "qids", "q", "bounds"])

    def search(batches):
        """Pairs of blocks, those of a cell of the grid together and by descending length; one result for each cell."""
        cell, now = None, None
        for batch in batches:
            for n in range(len(batch)):
                r = {c: batch.column(c)[n].as_py() for c in ("block", "cell", "ids", "data")}
                if (r["block"], r["cell"]) != cell:
                    if now:
                        yield now.rows()
                    cell, own = (r["block"], r["cell"]), {c: batch.column(c)[n].as_py() for c in ("q", "qids", "bounds")}
                    now = Search(np.frombuffer(own["q"], np.int64).reshape(-1, width), np.frombuffer(own["qids"], np.int64), np.frombuffer(own["bounds"], np.float64), shared.value[0], k)
                now.add(np.frombuffer(r["data"], np.int64).reshape(-1, width), np.frombuffer(r["ids"], np.int64))
        if now:
            yield now.rows()

    blocks = rows.select("id", "x", "length").repartitionByRange(max(1, -(-total // BLOCK)), F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id").mapInArrow(pack, "candidates long, longest double, ids binary, data binary")
    blocks = stored(spark, blocks, "blocks")
    n_blocks = max(1, -(-asked // QUERIES))
    asking = rows.where("asks").select("id", "x").dropDuplicates().groupBy(F.pmod(F.xxhash64("id", "x"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("id", "x")).alias("rows"))
    asking = stored(spark, asking.mapInArrow(first_bounds, "block long, reach double, qids binary, q binary, bounds binary"), "asking")
    # the stated queries against all rows, in blocks: first only the bounds of blocks meet, then the blocks of pairs that are
    # left; each cell of the grid has one block of queries and about GRID blocks of candidates, dealt out by hash
    cells = max(1, -(-total // (BLOCK * GRID)))
    sent = blocks.select("candidates", "longest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    pairs = sent.join(asking.select("block", "reach"), "block").where(F.col("longest") * (1 + 1e-6) + 1e-6 >= F.col("reach")).select("candidates", "block")
    cell = F.pmod(F.xxhash64("candidates"), F.lit(cells))
    dealt = asking.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"), "qids", "q", "bounds")
    met = pairs.join(blocks, "candidates").withColumn("cell", cell).join(dealt, ["block", "cell"])
    met = met.repartition(max(1, n_blocks * cells), "block", "cell").sortWithinPartitions("block", "cell", F.desc("longest"), "candidates")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.select("block", "cell", "qids", "q", "bounds", "ids", "data").mapInArrow(search, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
