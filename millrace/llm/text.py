"""Words and hashes of many texts at once, on the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one round of array arithmetic takes; a longer text is a round of its own, but for its words' hashes,
#: which are made in rounds of so many bytes too, or of one word.
CHUNK = 1 << 18
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_WHITE] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes each, or one row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased, and the number of words of each text."""
    n, docs = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    white = _WHITE[data]
    begins = np.ones(n, bool)
    begins[1:] = white[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(begins & ~white)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    lengths = np.diff(starts, append=n)
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = MULTIPLIER
    np.multiply.accumulate(powers, out=powers)
    hashes = np.empty(len(starts), np.uint64)
    for a, b in chunks(np.append(starts, n)):
        first, last = starts[a], starts[b] if b < len(starts) else n
        place = np.arange(first, last)
        place -= np.repeat(starts[a:b], lengths[a:b])
        values = _BYTE[data[first:last]]
        values *= powers[place]
        hashes[a:b] = np.add.reduceat(values, starts[a:b] - first)
    return mix(hashes), np.diff(np.searchsorted(starts, offsets))


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of width words (all words as one run where there are fewer), and how many each text has."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    begin = np.repeat(first, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = np.repeat(np.minimum(counts, width), per)
    out = size.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        out *= MULTIPLIER
        out += np.where(k < size, padded[begin + k], np.uint64(0))
    return mix(out), per
