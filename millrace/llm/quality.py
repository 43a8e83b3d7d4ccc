"""Quality by importance resampling: how much likelier a text is under hashed word n-gram counts of good documents than
under those of all documents, sampled by Gumbel top-k.

The log ratio of a text is the mean over its n-grams, drawn to 0 as if each text had SHRINK n-grams more that say nothing.
As the good documents are part of all documents, a document's true ratio is P(good | text) / P(good), at most 1 / P(good),
while a product over n-grams, as if they were independent, exceeds any bound: so a logistic curve, fitted on labelled
documents as n-gram models see them that haven't learned from them, sets the scale (the temperature) of the log ratios,
and log_weight is log P(good | text). Noise then matters as far as the labels leave doubt. The sample has as many documents as are good by
expectation, the sum of P(good | text).

A document without words has the log ratio 0. Null text counts as empty; a very long text is counted in slices. Rows
without a label, or with a null one, teach the model of all documents only; of several labels of a document the lowest
counts. Repeated rows are scored and sampled alike; rows that tie with the last one sampled are sampled too. Extra columns
are ignored; carried ones that are called like a result are left out. Without labels of both kinds every document is
kept, with log_weight 0. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import MULTIPLIER, buffers, chunks, mix, word_hashes
from millrace.llm.vectors import count_vectors
from millrace.session import ship, stored

#: Buckets of the hashed words and pairs of words, and what is added to the counts, as a share of all documents' counts.
BUCKETS, SMOOTHING = 1 << 15, 1.0
#: Labelled documents that are used, at most (those of the lowest hashes).
MAX_LABELS = 20_000
SEED = 20_240_101
SHRINK = 64


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's words and pairs of neighbouring words, and how many each text has."""
    words, counts = word_hashes(data, offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = mix(words[:-1] * MULTIPLIER + words[1:])[doc[:-1] == doc[1:]] if len(words) else words
    owner = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]])
    grams = np.concatenate([words, pairs]) >> np.uint64(64 - 15)
    order = np.argsort(owner, kind="stable")
    return grams[order].astype(np.int64), np.bincount(owner, minlength=len(counts))


def _gumbel(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise that a document always gets."""
    with np.errstate(over="ignore"):
        u = mix(ids.astype(np.int64).view(np.uint64) * MULTIPLIER + hashes + np.uint64(SEED))
    return -np.log(-np.log((u >> np.uint64(11)).astype(np.float64) / 2**53 + 2**-54))


def labelled(labels: DataFrame, limit: int = MAX_LABELS) -> dict[int, tuple[int, int]]:
    """doc_id -> (quality, half) of at most limit labelled documents, spread evenly by a hash of the id."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id", "quality", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half"))
    return {r["doc_id"]: (r["quality"], r["half"]) for r in rows.collect()}


def fit(docs: DataFrame, known: dict[int, tuple[int, int]]) -> np.ndarray:
    """log P(bucket | good) - log P(bucket | any), learned from the good documents of each half."""
    good = [np.array(sorted(d for d, (q, h) in known.items() if q and h == half), np.int64) for half in (0, 1)]

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        data, offsets = buffers(batch.column("text"))
        ids = pc.fill_null(batch.column("doc_id"), -(2**63)).to_numpy()
        chosen = [np.isin(ids, own) for own in good]
        for a, b in chunks(offsets):
            grams, counts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total[2] += np.bincount(grams, minlength=BUCKETS)
            for half in (0, 1):
                if chosen[half][a:b].any():
                    total[half] += np.bincount(grams[np.repeat(chosen[half][a:b], counts)], minlength=BUCKETS)

    first, second, every = count_vectors(docs.select("doc_id", "text"), (3, BUCKETS), add).astype(np.float64)
    raw = every + SMOOTHING
    target = np.stack([first, second])
    target += SMOOTHING * (target.sum(1, keepdims=True) + 1) / (every.sum() + 1)
    return np.log(target / target.sum(1, keepdims=True)) - np.log(raw / raw.sum())


def ratios(docs: DataFrame, weights: np.ndarray, known: dict[int, tuple[int, int]], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, log_ratio, noise (standard Gumbel noise that a document always gets), and the quality of labelled
    documents. The ratio of a labelled document is that of the half of the labels that it doesn't belong to, others get the
    mean of both."""
    spark = docs.sparkSession
    ship(spark)
    made = ["log_ratio", "noise", "quality"]
    schema = docs.select(*carry).schema.add("log_ratio", "double", False).add("noise", "double", False).add("quality", "integer")
    shared = spark.sparkContext.broadcast((weights, known))

    def run(batches):
        halves, labels = shared.value
        both = halves.mean(0)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            own = [labels.get(d) for d in batch.column("doc_id").to_pylist()]
            ratio, sizes = np.zeros(len(own)), np.zeros(len(own), np.int64)
            for a, b in chunks(offsets):
                grams, counts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                starts = np.cumsum(counts) - counts
                ratio[a:b] = np.add.reduceat(np.append(both[grams], 0.0), starts) * (counts > 0) / (counts + SHRINK)
                sizes[a:b] = counts
                for k in range(a, b):
                    if own[k]:
                        part = grams[starts[k - a] : starts[k - a] + counts[k - a]]
                        ratio[k] = halves[1 - own[k][1]][part].sum() / (len(part) + SHRINK)
            noise = _gumbel(pc.fill_null(batch.column("doc_id"), -1).to_numpy(), sizes.astype(np.uint64))
            found = [pa.array(ratio), pa.array(noise), pa.array([x and x[0] for x in own], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *found], names=[*carry, *made])

    return docs.select(*dict.fromkeys([*carry, "doc_id", "text"])).mapInArrow(run, schema)


def curve(x: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of P(good | x) = 1 / (1 + exp(-a - b x)) by maximum likelihood, by Newton's method. Labels count as a little less
    than certain, as if there were one document more of each kind, so that separable labels have a maximum too."""
    n = good.sum()
    y = np.where(good, (n + 1) / (n + 2), 1 / (len(good) - n + 2))
    middle, spread = x.mean(), x.std() + 1e-12
    z = np.stack([np.ones(len(x)), (x - middle) / spread], 1)
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        change = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (y - p) - 1e-6 * beta)
        beta += change * min(1.0, 4 / (np.abs(change).max() + 1e-12))
    return float(beta[0] - beta[1] * middle / spread), float(beta[1] / spread)


def ordered(key: Column) -> Column:
    """A whole number that orders as the key does, in billionths, infinities at the ends."""
    return F.round(F.least(F.greatest(key, F.lit(-9e9)), F.lit(9e9)) * 1e9).cast("long")


def kth_largest(weighed: DataFrame, k: int, column: str = "gumbel_key") -> int:
    """The k-th largest ordered() value of a column, found from counts by its 16 highest bits, then the next 16, and so on."""
    low, values = -(2**63), weighed.select(ordered(F.col(column)).alias("v"))
    for shift in (48, 32, 16, 0):
        rows = values.where(F.shiftright("v", shift + 16) == low >> (shift + 16)) if shift < 48 else values
        counts = rows.groupBy(F.shiftright("v", shift).alias("part")).agg(F.count("*").alias("n")).collect()  # 65,536 rows at most
        for r in sorted(counts, key=lambda r: -r["part"]):
            if r["n"] >= k:
                low = r["part"] << shift
                break
            k -= r["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, log_weight, gumbel_key and keep of each document. The sample is drawn without replacement, by the
    largest sums of log weight and Gumbel noise."""
    spark, made = docs.sparkSession, ("log_ratio", "noise", "quality", "log_weight", "gumbel_key", "keep")
    carry = tuple(c for c in carry if c not in made)
    known = labelled(labels)
    with_id = (*carry, *(() if "doc_id" in carry else ("doc_id",)))
    scored = stored(spark, ratios(docs, fit(docs, known), known, with_id), "quality")
    rows = scored.where("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("log_ratio").alias("x"), F.max("quality").alias("q")).collect()  # MAX_LABELS at most
    rows.sort()
    x, good = np.array([r["x"] for r in rows]), np.array([r["q"] > 0 for r in rows], bool)
    if len(set(good.tolist())) < 2:
        return scored.select(*carry, F.lit(0.0).alias("log_weight"), F.col("noise").alias("gumbel_key"), F.lit(True).alias("keep"))
    a, b = curve(x, good)
    weighed = scored.withColumn("log_weight", -F.log1p(F.exp(-(F.col("log_ratio") * F.lit(b) + F.lit(a)))))
    weighed = weighed.withColumn("gumbel_key", F.col("log_weight") + F.col("noise"))
    # sums of whole billionths, which come out the same in any order
    size = weighed.agg(F.sum(F.round(F.exp("log_weight") * 1e9).cast("decimal(38,0)")).alias("n")).first()["n"]
    threshold = kth_largest(weighed, max(1, round(int(size or 0) / 1e9)))
    return weighed.select(*carry, "log_weight", "gumbel_key", (ordered(F.col("gumbel_key")) >= F.lit(threshold)).alias("keep"))
