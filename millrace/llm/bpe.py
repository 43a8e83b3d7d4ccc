"""Byte-pair encoding and decoding of whole texts.

A long text is encoded by tree concatenation: its halves, down to leaves, for themselves, then windows around each join: of
pieces where the text is split, of tokens inside a piece that isn't (unsplit.py).
A text of any length goes that way; memory is some tens of bytes for each of its tokens, and a slice of rows takes BATCH bytes
of text or one text. Null text counts as empty: no ids, and the decoded text is empty. A repeated row gives a repeated row. Extra columns stay;
a column that already has the name of a result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import tokens
from millrace.llm.text import buffers, chunks
from millrace.session import ship

#: Bytes of text that a worker takes at once, the most characters of a leaf, and pieces at its ends that a span knows.
BATCH, LEAF, KNOWN = 1 << 20, 4096, 4

#: Where the text is split for certain.
_NEAR = re.compile(r"\S \S")
#: A piece of a text, encoded by itself: its first place in the text, the place after its last, its number of tokens.
Unit = tuple[int, int, int]


class Span(NamedTuple):
    """A stretch of a text, encoded: its ids (little-endian), its first and last pieces, and whether these are all of its
    pieces (then head and tail are the same)."""

    begin: int
    end: int
    ids: bytes
    head: list[Unit]
    tail: list[Unit]
    whole: bool


def span(enc: tokens.Encoder, text: str, begin: int, end: int) -> Span:
    """text[begin:end] as if it stood alone."""
    pieces = enc.pieces(text[begin:end])
    ids = [enc.known[p] for p in pieces]
    gap, whole, head, tail = int(enc.drops_white), len(pieces) <= KNOWN, [], []
    at = begin
    for p, x in zip(pieces[:KNOWN], ids, strict=False):
        head.append((at, at + len(p), len(x) // 4))
        at += len(p) + gap
    at = end
    for p, x in zip(pieces[: -KNOWN - 1 : -1], ids[: -KNOWN - 1 : -1], strict=True):
        tail.append((at - len(p), at, len(x) // 4))
        at -= len(p) + gap
    return Span(begin, end, b"".join(ids), head, head if whole else tail[::-1], whole)


def cuts(text: str) -> list[int]:
    """Where a text is halved, and its halves, until no part has more than LEAF; its ends included. A cut that no split of
    the text is near to, LEAF characters on either side, is left out: what stands there is a piece of its own, which
    unsplit.Unsplit halves into tokens."""
    n, parts = len(text), 1
    while parts * LEAF < n:
        parts *= 2
    nominal = [n * k // parts for k in range(1, parts)]
    return [0, *[c for c in nominal if _NEAR.search(text, max(0, c - LEAF), c) and _NEAR.search(text, c, c + LEAF)], n]


def _agreed(enc: tokens.Encoder, text: str, left: Span, right: Span) -> tuple[Span, int, int]:
    """The window around the join of two spans, and how many tokens of the left's end and the right's beginning it
    replaces. The window grows on a side until its outermost piece there is that side's own, or the side is used up: where
    pieces end depends on the characters beside that place only, so what lies beyond agreeing pieces is right as it
    stands. Beyond the pieces that a span knows, the window takes all of it."""
    a = b = 1
    while True:
        from_left = a <= len(left.tail) - left.whole
        from_right = b <= len(right.head) - right.whole
        low = left.tail[-a][0] if from_left else left.begin
        high = right.head[b - 1][1] if from_right else right.end
        window = span(enc, text, low, high)
        left_agrees = not from_left or window.head[0][:2] == left.tail[-a][:2]
        right_agrees = not from_right or window.tail[-1][:2] == right.head[b - 1][:2]
        if left_agrees and right_agrees:
            dropped = 4 * sum(u[2] for u in left.tail[-a:]) if from_left else len(left.ids)
            passed = 4 * sum(u[2] for u in right.head[:b]) if from_right else len(right.ids)
            return window, dropped, passed
        a, b = a if left_agrees else 2 * a, b if right_agrees else 2 * b


def join(enc: tokens.Encoder, text: str, left: Span, right: Span) -> Span:
    """Two encoded neighbours as one."""
    window, dropped, passed = _agreed(enc, text, left, right)
    before = [u for u in left.head if u[1] <= window.begin]
    after = [u for u in right.tail if u[0] >= window.end]
    beside_left, beside_right = left.whole or len(before) < len(left.head), right.whole or len(after) < len(right.tail)
    head, tail = before, after
    if beside_left:
        head = before + window.head + ([u for u in right.head if u[0] >= window.end] if window.whole else [])
    if beside_right:
        tail = ([u for u in left.tail if u[1] <= window.begin] if window.whole else []) + window.tail + after
    ids = b"".join((left.ids[: len(left.ids) - dropped], window.ids, right.ids[passed:]))
    whole = left.whole and window.whole and right.whole and len(head) <= KNOWN
    return Span(left.begin, right.end, ids, head[:KNOWN], head if whole else tail[-KNOWN:], whole)


def tree_concat(enc: tokens.Encoder, text: str) -> bytes:
    """The ids of a whole text: its leaves are encoded independently of each other, then neighbours are joined in pairs, then
    pairs of those, up to the whole text."""
    level = [span(enc, text, a, b) for a, b in itertools.pairwise(cuts(text))]
    while len(level) > 1:
        level = [join(enc, text, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0].ids


def slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of about BATCH bytes of text, with their texts; null counts as empty."""
    for a, b in chunks(buffers(column)[1], BATCH):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def ids_array(encoded: list[bytes], arrow: pa.DataType) -> pa.Array:
    """A list column of ids, given as little-endian 32-bit numbers."""
    ends = [0]
    for x in encoded:
        ends.append(ends[-1] + len(x) // 4)
    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(arrow)


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", end_id: int | None = None) -> DataFrame:
    """Adds ids: the ids of each whole text, then end_id if one is given. The text column stays out of the result only
    where it is called like the ids."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    tail = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches):
        enc = tokens.encoder(vocabulary)
        for batch in batches:
            for a, b, texts in slices(batch.column(text)):
                found = ids_array([tree_concat(enc, t) + tail for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in kept), found], names=[*kept, ids])

    return docs.select(*kept, *([] if text in kept else [text])).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds text: what the library's decode(ids, skip_special_tokens=False) gives; null ids count as none."""
    ship(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != text]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField(text, T.StringType(), False)])

    def run(batches):
        spelling = _spellings(tokens.library(vocabulary))
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = [b"".join([spelling[k] for k in x or ()]).decode("utf-8", "replace") for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, text])

    return encoded.mapInArrow(run, schema)


def _spellings(tokenizer) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    back = {chr(tokens._SPELT.get(b, b)): b for b in range(256)}
    special = tokenizer.get_added_tokens_decoder()
    return [special[k].content.encode() if k in special else bytes(back[c] for c in tokenizer.id_to_token(k)) for k in range(tokenizer.get_vocab_size())]


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded in one pass."""
    ship(docs.sparkSession)

    def run(batches):
        enc = tokens.encoder(vocabulary)
        spelling = _spellings(enc.tokenizer)
        decimal = [str(k).encode() for k in range(len(spelling))]
        for batch in batches:
            for a, b, texts in slices(batch.column("text")):
                out = []
                for whole in texts:
                    ids = np.frombuffer(tree_concat(enc, whole), "<u4").tolist()
                    text = b"".join([spelling[k] for k in ids]).decode("utf-8", "replace")
                    out.append((len(ids), hashlib.sha256(b",".join([decimal[k] for k in ids])).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
