"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text that is null or has no letter is `und` with score 0, as is every text where nothing could be learned. Every row
gets a prediction, repeated ones too; a row whose language is null teaches nothing. A null doc_id is not held out. Ties go
to the language that is first by name. A very long text is scored in slices. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import CHUNK, chunks
from millrace.llm.vectors import count_vectors
from millrace.session import ship

#: Buckets of the hashed n-grams, their lengths, and what is added to each count.
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
UNDETERMINED = "und"
#: Languages whose counts one pass gathers, and whose likelihoods are summed at once. There may be any number of such blocks;
#: the model, which every worker holds, has 256 KB for each language.
BLOCK = 256
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """The buckets of the n-grams that begin after each of the first n characters, a column for each order."""
    out, state = np.empty((n, len(ORDERS)), np.int32), np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        state = (state ^ codes[1 + k : 1 + k + n]) * _FACTORS[k % len(_FACTORS)]
        state ^= state >> np.uint32(15)
        if k + 1 in ORDERS:
            out[:, ORDERS.index(k + 1)] = (state * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text, one text after the other, and where each text's begin. Texts are lower-cased
    and stand between spaces, so that the ends of words count at the ends of texts too."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("  " + "  ".join(lowered) + "   ").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) + 2 for t in lowered], dtype=np.int64)])
    out = _hashed(codes, int(begins[-1]))
    out[begins[1:] - 1] = 0  # what would reach into the next text
    return out.reshape(-1), begins * len(ORDERS)


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category (digits, numbers such as superscripts, and marks aren't)."""
    return any(map(str.isalpha, text))


def parts(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, buckets, where each row's begin) of all texts: short ones together, a text of more than CHUNK
    characters in slices, one after the other, which have the n-grams of the whole text."""
    for a, b in chunks(np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)):
        if b - a > 1 or len(texts[a]) <= CHUNK:
            yield a, b, *ngrams(texts[a:b])
            continue
        padded = "  " + texts[a].lower() + "   "
        for at in range(0, len(padded) - 3, CHUNK):
            last = min(at + CHUNK, len(padded) - 3)
            grams = _hashed(np.frombuffer(padded[at : last + 3].encode("utf-32-le", "surrogatepass"), np.uint32), last - at)
            if last == len(padded) - 3:
                grams[-1] = 0
            yield a, b, grams.reshape(-1), np.array([0, grams.size])


@dataclass
class Model:
    languages: list[str]
    #: log P(bucket | language), a row for each bucket, and log P(language).
    likelihood: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame) -> Model:
    """Learns from all rows of docs (text, lang) that have a language; languages are counted a block at a time."""
    docs = docs.select("text", "lang").where(F.col("lang").isNotNull())
    languages = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    blocks = [languages[k : k + BLOCK] for k in range(0, len(languages), BLOCK)]
    counts = np.concatenate([_counts(docs if len(blocks) == 1 else docs.where(F.col("lang").isin(block)), block) for block in blocks or [[]]])
    smooth = counts[:, :BUCKETS] + SMOOTHING
    prior = counts[:, BUCKETS] + SMOOTHING
    return Model(languages, np.ascontiguousarray((np.log(smooth) - np.log(smooth.sum(1, keepdims=True))).T), np.log(prior / prior.sum()))


def _counts(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """How often each bucket, and in the last column each language, stands in the rows of these languages."""
    place = {x: k for k, x in enumerate(languages)}

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        texts, own = batch.column("text").to_pylist(), np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
        np.add.at(total[:, BUCKETS], own, 1)
        for a, b, grams, begins in parts([t or "" for t in texts]):
            slot = np.repeat(own[a:b], np.diff(begins))
            total[:, :BUCKETS] += np.bincount(slot * BUCKETS + grams, minlength=len(languages) * BUCKETS).reshape(-1, BUCKETS)

    return count_vectors(docs, (max(1, len(languages)), BUCKETS + 1), add)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred and score, the posterior probability of lang_pred; columns of these names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = spark.sparkContext.broadcast((model.likelihood, model.prior, np.array([*model.languages, UNDETERMINED], object)))

    def run(batches):
        likelihood, prior, names = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
            if len(names) > 1:
                logs = np.tile(prior, (len(texts), 1))
                for a, b, grams, begins in parts(texts):
                    for k in range(0, len(prior), BLOCK):
                        logs[a:b, k : k + BLOCK] += np.add.reduceat(likelihood[grams, k : k + BLOCK], begins[:-1], axis=0)
                chance = np.exp(logs - logs.max(1, keepdims=True))
                chance /= chance.sum(1, keepdims=True)
                known = np.array([has_letter(t) for t in texts])
                best = np.where(known, chance.argmax(1), len(names) - 1)
                score = np.where(known, chance.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names[best], pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string", False).add("score", "double", False)
    return docs.select(*kept).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; learned from the documents that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
