"""Phrases whose words stand together more often than their parts would, for each language, by PCY/DHP hashing.

The corpus is read once for each length of phrase. A pass counts the phrases of its length exactly and, at the same time, the
phrases that are one word longer by hash buckets. Before the next pass two bitmaps of BUCKETS bits are broadcast: the buckets
that hold enough (of what they hold, some may be frequent), and those of the phrases found frequent just now. A phrase is counted
exactly only if its own bucket has enough and both its parts that are one word shorter are frequent (Apriori); longer ones go
into the next buckets only if both their parts pass too. Bitmaps have false positives only, so no frequent phrase is lost, and
their size doesn't depend on the corpus; with more words per bucket they only spare less.

Texts are lower-cased (A-Z), cut into pieces at [.,;:!?\\x0A-\\x0D] and pieces into words [^\\x20\\x09]+. Null and empty texts have
no words, a null language is `und`. Repeated rows count as often as they stand there; ties in score and count go by the
phrase's bytes, ties of cuts by the least k. A very long text is taken in rounds that share their last words, a long word whole.
Extra columns are ignored, whatever their names. An empty table, or a language without frequent phrases, gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.text import MULTIPLIER, buffers, chunks, mix
from millrace.session import ship, stored

#: Buckets of a pass, and those of a slot, in which their counts travel.
BUCKETS, SLOT = 1 << 25, 1 << 16
#: Bytes of text of a round, and rows of counts that a task holds.
ROUND, HELD = 1 << 21, 1 << 19
#: Least frequency, most words of a phrase, phrases returned for a language, percent of a longer phrase that absorbs a shorter.
LEAST, WORDS, TOP, ABSORBS = 10, 3, 2000, 50
#: Groups in which the first phrases of a language are sought before they meet.
SALTS = 16
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: of a word, 1: between words, 2: between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 32]] = 1
_CLASS[[10, 11, 12, 13, *b".,;:!?"]] = 2
_COUNTED = "lang string, phrase string, n long, slot int, counts binary"
_PARTS = "slot int, counts binary"


class Words(NamedTuple):
    """Consecutive words: their number in `known`, the distinct words; whether one begins a piece; how many of the first ones
    were in the round before."""

    codes: np.ndarray
    begins: np.ndarray
    known: pa.Array
    before: int


def _words(data: np.ndarray, offsets: np.ndarray, before: int = 0) -> tuple[Words, np.ndarray]:
    """The words of texts, and where each starts in data."""
    kind = _CLASS[data]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts) + np.searchsorted(offsets, starts, "right")
    gaps = np.flatnonzero(~word)
    at = np.concatenate([starts - np.searchsorted(gaps, starts), [len(data) - len(gaps)]])
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[data[word]])])
    coded = column.dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), np.diff(piece, prepend=-1) != 0, coded.dictionary, before), starts


def rounds(column: pa.Array) -> Iterator[Words]:
    """The words of a column of texts, in rounds of about ROUND bytes. A round of a longer text begins with the last words of
    the round before, as many as a phrase may need."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, ROUND):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= ROUND:
            yield _words(data[low:high], offsets[a : b + 1] - low)[0]
            continue
        begin, done, before = low, low, 0
        while done < high:
            done = min(high, done + ROUND)
            while done < high and _CLASS[data[done]] == 0:  # to the end of the word
                ahead = _CLASS[data[done : min(high, done + ROUND)]]
                gap = np.flatnonzero(ahead)
                done += int(gap[0]) if len(gap) else len(ahead)
            found, starts = _words(data[begin:done], np.array([0, done - begin]), before)
            yield found
            before = min(WORDS - 1, len(starts))
            begin = begin + int(starts[-before]) if before else done


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w, _seed(lang)) for w in words], np.uint64)


def _longer(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but their last words, and of these."""
    return mix(prefix * MULTIPLIER + last)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _has(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Whether the packed bits of the buckets are set."""
    return (bits[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8) & 1).astype(bool)


def _passing(words: Words, lang: str, n: int, frequent: np.ndarray | None, enough: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of n words end that are to be counted, and the buckets of the phrases of n + 1 words to be hashed."""
    one = _hashes(words.known.to_pylist(), lang)[words.codes]
    inside, hashes = [np.ones(len(one), bool)], [one]
    for _ in range(n):
        own, shorter, begins = np.zeros_like(inside[-1]), inside[-1], words.begins
        own[1:] = shorter[:-1] & ~begins[1:]
        longer = one.copy()
        longer[1:] = _longer(hashes[-1][:-1], one[1:])
        inside.append(own)
        hashes.append(longer)
    passed = inside[n - 1]
    if n > 1:
        parts = inside[n - 2].copy()
        parts[parts] = _has(frequent, _bucket(hashes[n - 2][parts]))
        passed = passed & parts
        passed[1:] &= parts[:-1]
        passed[passed] = _has(enough, _bucket(hashes[n - 1][passed]))
    further = inside[n] & passed
    further[1:] &= passed[:-1]
    passed, further = passed.copy(), further.copy()
    passed[: words.before] = further[: words.before] = False
    return np.flatnonzero(passed), _bucket(hashes[n][further])


def _tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in no order, and how often each is there."""
    found = pa.array(values).value_counts()
    return found.field("values").to_numpy(), found.field("counts").to_numpy()


def _phrases(words: Words, ends: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct phrases of n words that end at ends, and how often each does."""
    most = len(words.known)
    if most**n < 2**63:
        key = np.zeros(len(ends), np.int64)
        for k in range(n - 1, -1, -1):
            key = key * most + words.codes[ends - k]
        keys, counts = _tally(key)
        codes = [keys // most**k % most for k in range(n - 1, -1, -1)]
    else:
        rows, counts = np.unique(np.stack([words.codes[ends - k] for k in range(n - 1, -1, -1)], 1), axis=0, return_counts=True)
        codes = rows.T
    parts = [words.known.take(pa.array(c)) for c in codes]
    joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
    return joined.cast(pa.large_string()).cast(pa.string()), counts


def _parts(counts: np.ndarray) -> pa.RecordBatch:
    """Counts of buckets as rows of a slot: all of them, or places and counts of those above zero where that is shorter."""
    some = np.flatnonzero(counts)
    edges = np.searchsorted(some, np.arange(0, len(counts) + 1, SLOT))
    rows, full = [], SLOT * counts.itemsize
    slots = np.flatnonzero(np.diff(edges))
    for k in slots:
        own = some[edges[k] : edges[k + 1]]
        sparse = (own - k * SLOT).astype(np.uint16).tobytes() + counts[own].tobytes()
        rows.append(sparse if len(sparse) < full else counts[k * SLOT : (k + 1) * SLOT].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(rows, pa.binary())], names=["slot", "counts"])


def _add(total: np.ndarray, part: bytes, kind: np.dtype) -> None:
    """Adds a row of _parts."""
    if len(part) == len(total) * kind.itemsize:
        total += np.frombuffer(part, kind)
    else:
        n = len(part) // (2 + kind.itemsize)
        total[np.frombuffer(part, np.uint16, n)] += np.frombuffer(part, kind, n, 2 * n)


def _bitmap(parts: DataFrame, least: int) -> np.ndarray:
    """The buckets whose counts, summed over all parts, are at least least, as packed bits. Each slot is summed by one
    task, a part at a time; BUCKETS / 8 bytes reach the driver."""
    kind = np.min_scalar_type(least)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column("slot").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own = total.setdefault(slot, np.zeros(SLOT, np.int64))
                _add(own, counts, kind)
        bits = [np.packbits(x >= least).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(bits, pa.binary())], names=["slot", "counts"])

    out = np.zeros((BUCKETS // SLOT, SLOT // 8), np.uint8)
    for r in parts.select("slot", "counts").repartition("slot").mapInArrow(run, _PARTS).collect():
        out[r["slot"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def _marks(phrases: DataFrame, least: int) -> DataFrame:
    """Parts in which the buckets of the given phrases, all of as many words, have enough."""
    kind = np.min_scalar_type(least)

    def run(batches):
        counts = np.zeros(BUCKETS, kind)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column("phrase").filter(pc.equal(langs.indices, code))
                words = pc.split_pattern(own, " ").flatten().dictionary_encode()
                known = _hashes(words.dictionary.cast(pa.binary()).to_pylist(), lang)
                first, *rest = known[words.indices.to_numpy()].reshape(len(own), -1).T
                counts[_bucket(functools.reduce(_longer, rest, first))] = least
        yield _parts(counts)

    return phrases.select("lang", "phrase").mapInArrow(run, _PARTS)


class _Heap:
    """Counts of phrases of a task, those of one phrase together as long as HELD rows hold them."""

    def __init__(self) -> None:
        self.parts, self.rows = [], 0

    def add(self, lang: str, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), pa.array([lang])).cast(pa.string())
        self.parts.append(pa.table([langs, phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "n"]))
        self.rows += len(phrases)
        if self.rows > HELD:
            self._meet()
            if self.rows > HELD // 2:  # the more frequent half stays, as its phrases come again
                whole = self.parts[0]
                rare = pc.less_equal(whole["n"], pc.quantile(whole["n"], interpolation="lower")[0])
                kept, self.parts = whole.filter(pc.invert(rare)), [whole.filter(rare)]
                yield from self.out()
                self.parts, self.rows = [kept], len(kept)

    def _meet(self) -> None:
        whole = pa.concat_tables(self.parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        self.parts, self.rows = [whole.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])], len(whole)
        pa.default_memory_pool().release_unused()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            if len(self.parts) > 1:
                self._meet()
            for batch in self.parts[0].to_batches():
                nothing = [pa.nulls(len(batch), t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *nothing], names=["lang", "phrase", "n", "slot", "counts"])
        self.parts, self.rows = [], 0


def _counted(texts: DataFrame, n: int, least: int, further: bool, maps: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """One pass over texts (text, lang): phrases of n words with their counts in a task, or in a part of it, and parts of the
    counts of longer ones' buckets if they are asked for."""
    kind = np.min_scalar_type(least)
    sent = texts.sparkSession.sparkContext.broadcast(maps)

    def run(batches):
        frequent, enough = sent.value or (None, None)
        buckets, heap = np.zeros(BUCKETS if further else 0, kind), _Heap()
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for words in rounds(batch.column("text").filter(pc.equal(langs.indices, code))):
                    if not len(words.codes):
                        continue
                    ends, longer = _passing(words, lang, n, frequent, enough)
                    if further:
                        place, found = _tally(longer)
                        buckets[place] = np.minimum(buckets[place] + found, least)
                    yield from heap.add(lang, *_phrases(words, ends, n))
        yield from heap.out()
        if further:
            parts = _parts(buckets)
            nothing = [pa.nulls(len(parts), t) for t in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nothing, *parts.columns], names=["lang", "phrase", "n", "slot", "counts"])

    return texts.mapInArrow(run, _COUNTED)


def frequencies(docs: DataFrame, least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of up to so many words that stands there at least so often, and (lang, n): all
    words of each language. Both read stored tables."""
    if not 2 <= words <= WORDS:
        raise ValueError(f"phrases have 2 to {WORDS} words")
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    maps, frequent, totals = None, [], None
    for n in range(1, words + 1):
        counted = stored(spark, _counted(texts, n, least, n < words, maps), f"phrases{n}")
        found = counted.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            totals = stored(spark, counted.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        frequent.append(stored(spark, found.where(F.col("f") >= least).select("lang", "phrase", F.lit(n).alias("words"), "f"), f"frequent{n}"))
        if n < words:
            maps = _bitmap(_marks(frequent[-1], least), least), _bitmap(counted.where("slot IS NOT NULL"), least)
    return functools.reduce(DataFrame.unionByName, frequent), totals


def mine(docs: DataFrame, least: int = LEAST, words: int = WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first phrases of each language."""
    f, totals = frequencies(docs, least, words)
    candidates = f.where("words > 1")
    scored = _weakest_cut(candidates, f)
    split = F.split("phrase", " ")
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda k: F.array_join(F.slice(split, k, m), " ")))))
    around = candidates.where("words > 2").select("lang", inner.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < ABSORBS * F.col("a"))).drop("around")
    return _ranked(kept, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _weakest_cut(candidates: DataFrame, f: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r and score of each candidate, by the cut of the lowest score. What a cut gives is frequent itself,
    so f has it. A cut's parts are the phrase, which needn't travel beside them, and cuts meet by what the caller joins by, without
    a. Numbers have up to 15 digits, their products up to 38."""
    split, k = F.split("phrase", " "), F.col("k")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "a", "k", F.array_join(F.slice(split, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(split, k + 1, F.col("words") - k), " ").alias("rest"))
    side = lambda part, name: f.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = "CAST({} AS DECIMAL(15, 0))".format
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("cut")
    return cuts.groupBy("lang", F.concat_ws(" ", "first", "rest").alias("phrase")).agg(least).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")


def _ranked(phrases: DataFrame, top: int) -> DataFrame:
    """The first ones of each language. Groups of a language rank their own first, so that at most SALTS * top meet."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("salt")


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """The phrases of documents as SQL."""
    return f"""
WITH p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, '{UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents) d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
i AS (SELECT lang, unnest(ws) AS phrase, 1 AS words FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), 3 FROM w),
f AS (SELECT lang, phrase, words, count(*) AS f FROM i GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= {least}),
cuts AS (SELECT lang, phrase, a, 1 AS k, ws[1] AS first_, CASE WHEN words = 2 THEN ws[2] ELSE ws[2] || ' ' || ws[3] END AS rest FROM c
  UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE words = 3),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first_ JOIN f y ON y.lang = cuts.lang AND y.phrase = rest),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s) q WHERE nth = 1),
around AS (SELECT lang, part, max(a) AS a FROM (SELECT lang, ws[1] || ' ' || ws[2] AS part, a FROM c WHERE words = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE words = 3) q GROUP BY lang, part),
k AS (SELECT b.* FROM b LEFT JOIN around ON around.lang = b.lang AND around.part = b.phrase WHERE around.a IS NULL OR 100 * around.a < {ABSORBS} * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= {top}"""

