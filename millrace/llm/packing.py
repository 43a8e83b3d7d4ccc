"""Packing documents into sequences of a fixed number of tokens.

Pieces of the same length are alike for the packing, so it is planned on the histogram of lengths, which has at most as
many numbers as a sequence has tokens however large the corpus is. The plan says how many sequences hold which lengths;
every piece then finds its place from its rank among the pieces of its length. A loose first assignment is improved by
exchanges of pieces between underfull bins until bins empty.

Null text counts as empty: its document is the end id alone. Repeated rows, and rows of a repeated or null doc_id, are packed
each on its own. A very long text is encoded and cut in one task, which holds its ids. Extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm import tokens
from millrace.llm.bpe import slices
from millrace.session import ship, stored

CAPACITY, END_ID = 2048, 0
#: Pieces of text that an encoder keeps here, beside what other stages hold.
KEPT = 250_000
#: Pieces, or portions of equal pieces, up to which the local search takes all at once.
SEARCHED = 16_384
#: Of so many full bins of larger portions, one is searched again.
MIXED = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

Pattern = tuple[int, ...]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document, with the task that cut it (chunk) and its rank there among those of its length."""
    ship(docs.sparkSession)
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc, chunk, seen = tokens.encoder(vocabulary, KEPT), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in slices(batch.column("text")):
                out = []
                for doc, encoded in zip(ids[a:b], enc.ids(texts), strict=True):
                    encoded += tail
                    for k, at in enumerate(range(0, len(encoded), 4 * capacity)):
                        part = encoded[at : at + 4 * capacity]
                        n = len(part) // 4
                        out.append((doc, k, at // 4, n, zlib.crc32(part), chunk, seen[n]))
                        seen[n] += 1
                columns = zip(*out, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def loose_bins(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """A first assignment that is quick and loose: each bin takes the longest piece left, then the shortest ones until the
    next doesn't fit. As many bins as the counts allow are filled alike."""
    left, lengths, bins = dict(counts), sorted(n for n, c in counts.items() if c), Counter()
    while lengths:
        pattern, room = Counter([lengths[-1]]), capacity - lengths[-1]
        for n in lengths:
            if k := min(room // n, left[n] - pattern[n]):
                pattern[n] += k
                room -= k * n
            if left[n] > pattern[n]:
                break
        times = min(left[n] // k for n, k in pattern.items())
        bins[_sorted(pattern.elements())] += times
        for n, k in pattern.items():
            left[n] -= times * k
        lengths = [n for n in lengths if left[n]]
    return bins


def best_fit_bins(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit decreasing on the histogram: lengths from the longest on, each piece into the fullest bin that holds it. A bin that
    is the fullest one for a length stays so while the length fits, so bins of a kind take their pieces at once."""
    open_: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []

    def put(kind: Pattern, room: int, times: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            bisect.insort(rooms, room)
        open_[room][kind] += times

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            kind, bins = next(iter(open_[room].items())) if at < len(rooms) else ((), left)
            each = min(room // n, left)
            times = min(bins, left // each)
            if at < len(rooms):
                open_[room][kind] -= times
                if not open_[room][kind]:
                    del open_[room][kind]
                if not open_[room]:
                    del open_[room], rooms[at]
            put((*kind, *[n] * each), room - n * each, times)
            left -= times * each
    return sum(open_.values(), Counter())


def _sorted(pieces: Iterable[int]) -> Pattern:
    return tuple(sorted(pieces, reverse=True))


class _Underfull:
    """The underfull kinds of bin, as one row for each piece that a kind can give back (0: none): the most tokens that may
    come for it, the piece, and the kind's fill and number."""

    def __init__(self, capacity: int):
        self.capacity, self.kinds, self.number, self.rows = capacity, [], {}, {}
        self.table, self.used = np.full((4, 4096), -1, np.int64), 0

    def add(self, kind: Pattern) -> None:
        fill, backs = sum(kind), [0, *sorted(set(kind))]
        if fill == self.capacity:
            return
        if self.used + len(backs) > self.table.shape[1]:
            self._compact(len(backs))
        if kind not in self.number:
            self.number[kind] = len(self.kinds)
            self.kinds.append(kind)
        a, self.used = self.used, self.used + len(backs)
        own = self.table[:, a : self.used]
        own[0], own[1], own[2], own[3] = np.add(backs, self.capacity - fill), backs, fill, self.number[kind]
        self.rows[kind] = (a, self.used)

    def drop(self, kind: Pattern) -> None:
        if kind in self.rows:
            a, b = self.rows.pop(kind)
            self.table[0, a:b] = -1

    def _compact(self, more: int) -> None:
        live = self.table[:, np.flatnonzero(self.table[0, : self.used] >= 0)]
        self.used = live.shape[1]
        self.table = np.full((4, max(4096, 2 * (self.used + more))), -1, np.int64)
        self.table[:, : self.used] = live
        edges = np.flatnonzero(np.diff(live[3], prepend=-1, append=-1)).tolist()
        self.rows = {self.kinds[live[3, a]]: (a, b) for a, b in itertools.pairwise(edges)}

    def exchange(self, source: Pattern, alone: bool) -> tuple[Pattern, tuple[int, ...], int] | None:
        """The exchange of the source with any kind that raises the sum of squared fills most: (target, what goes there, what
        comes back). One piece moves, or goes for a shorter one, or two go for one. A source that is alone has no other
        bin of its kind to exchange with."""
        most, back, fill, number = self.table[:, : self.used]
        held, total = Counter(source), sum(source)
        items = sorted(held)
        twos = {a + b: (a, b) for k, a in enumerate(items) for b in items[k if held[a] > 1 else k + 1 :]}
        usable = most > 0
        if alone and source in self.number:
            usable &= number != self.number[source]
        best, gain = None, 0
        for given, allowed in (({n: (n,) for n in items}, usable), (twos, usable & (back > 0))):
            if not given:
                continue
            sums = np.array(sorted(given))
            place = np.searchsorted(sums, most, "right") - 1
            added = np.where(allowed & (place >= 0), sums[place] - back, 0)
            gains = np.where(added > 0, 2 * added * (fill - total + added), 0)
            k = int(gains.argmax()) if len(gains) else 0
            if len(gains) and gains[k] > gain:
                gain, best = gains[k], (self.kinds[number[k]], given[int(sums[place[k]])], int(back[k]))
        return best


def search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Swap-based local search: kinds of bins, from the emptiest on, exchange pieces with other underfull kinds as long as
    the sum of squared fills grows, in as many bins at once as both kinds have. It ends when no exchange helps any kind,
    or when no fewer bins could hold the pieces."""
    bins, total = Counter(bins), sum(bins.values())
    least = -(-sum(sum(p) * c for p, c in bins.items()) // capacity)
    underfull = _Underfull(capacity)
    for kind in bins:
        underfull.add(kind)
    helped = True
    while helped and total > least:
        helped = False
        for source in sorted(underfull.rows, key=lambda p: (sum(p), p)):
            while bins[source] and total > least and (found := underfull.exchange(source, bins[source] == 1)):
                target, given, back = found
                times = bins[source] // 2 if target == source else min(bins[source], bins[target])
                a, b = Counter(source), Counter(target)
                a.subtract(given)
                b.update(given)
                if back:
                    a[back] += 1
                    b[back] -= 1
                for kind, change in ((source, -times), (target, -times), (_sorted(a.elements()), times), (_sorted(b.elements()), times)):
                    before = bins[kind]
                    bins[kind] += change
                    if not kind:
                        total -= change
                    elif not before:
                        underfull.add(kind)
                    elif not bins[kind]:
                        underfull.drop(kind)
                helped = True
    del bins[()]
    return +bins


def portioned(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Kinds of bins for all pieces, from the loose start. The search begins with portions of equal pieces, as large as leave at most SEARCHED of
    them, and goes on with portions a quarter of the size, down to single pieces. Of what larger portions give, only full
    bins are used, and not every MIXED-th of them: the pieces in the others are searched again among what is left over, so
    that every search has lengths of all kinds. The steps grow with the lengths and the logarithm of the pieces only."""
    left, bins, portion = Counter(counts), Counter(), 1
    while sum(counts.values()) > SEARCHED * portion:
        portion *= 4
    while portion:
        found = search(loose_bins({n: c // portion for n, c in left.items()}, capacity), capacity)
        full = 0
        for kind, times in sorted(found.items()):
            if portion > 1:
                full, before = (full + times, full) if sum(kind) == capacity else (full, full)
                times = full - before - (full // MIXED - before // MIXED)
            bins[kind] += times * portion
            for n in kind:
                left[n] -= times * portion
        portion //= 4
    return +bins


def refilled(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """The bins, with the pieces of the underfull ones assigned anew by best fit and searched again, as long as that saves
    bins: where no exchange helps any more, a new start for what is left over often does."""
    while True:
        full = Counter({p: c for p, c in bins.items() if sum(p) == capacity})
        loose = Counter()
        for kind, times in bins.items():
            if kind not in full:
                for n in kind:
                    loose[n] += times
        again = full + search(best_fit_bins(loose, capacity), capacity)
        if sum(again.values()) >= sum(bins.values()):
            return bins
        bins = again


def bins_of(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Kinds of bins for all pieces: the search from the loose start, refilled, or the search from best fit decreasing where
    that ends with fewer bins. So there are never more than best fit decreasing has, however many pieces there are."""
    found = refilled(portioned(counts, capacity), capacity)
    other = search(best_fit_bins(counts, capacity), capacity)
    return found if sum(found.values()) <= sum(other.values()) else other


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, pieces in a bin, first sequence, offset of the first piece) in order of rank."""
    rows: dict[int, list] = {n: [] for n in counts}
    rank, sequence = Counter(), 0
    for pattern, times in sorted(bins_of(counts, capacity).items(), reverse=True):
        offset = 0
        for n, k in sorted(Counter(pattern).items(), reverse=True):
            rows[n].append((rank[n], k, sequence, offset))
            rank[n] += times * k
            offset += n * k
        sequence += times
    return {n: np.array(r, np.int64) for n, r in rows.items() if r}


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each piece's document, number, start, length and checksum, and its sequence and offset there."""
    spark = docs.sparkSession
    cut = stored(spark, pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most capacity rows
    places = plan({r["length"]: r["n"] for r in totals}, capacity)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ranked = cut.join(counts.select("chunk", "length", before.alias("before")), ["chunk", "length"])

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                own = order[a:b]
                n = int(length[own[0]])
                row = places[n][np.searchsorted(places[n][:, 0], rank[own], "right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own], offset[own] = row[:, 2] + nth // row[:, 1], row[:, 3] + n * (nth % row[:, 1])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank")]
    return ranked.select(*columns).mapInArrow(place, PLACED)
