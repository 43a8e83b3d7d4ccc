"""Tree concatenation of tokens: byte-pair encoding of long stretches that the vocabulary's own splitting leaves whole.

Leaves are encoded side by side in threads (the library lets others run meanwhile), then neighbours are joined. A join encodes a
window of a few tokens on either side of it anew and looks in it for a token that the left side has at the same place, and for one
that the right side has: from there on both agree. Tokens that stand side by side in the encoding of some text stay so wherever
no pair of neighbours would merge, so the sides' other tokens are taken over as they are. A side that doesn't agree has its part
of the window made four times as long. A text whose encoding never falls into step again, such as a run with a period that doesn't
divide LEAF, is encoded anew up to its end at each of the joins above it: right, but log(n) times the work.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np

#: Characters of a leaf, tokens on each side in the first window, threads that encode leaves.
LEAF, KNOWN, THREADS = 4096, 4, 4


class Tokens(NamedTuple):
    """The tokens of unit[begin:end] as if it stood alone, and where each starts in the unit."""

    ids: np.ndarray
    starts: np.ndarray
    begin: int
    end: int


@functools.cache
def _pool() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(THREADS)


class Unsplit:
    """Encodes with a tokenizer's model alone. Texts are in the spelling of its vocabulary."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer

        self.tokenizer, self.bare = tokenizer, Tokenizer(tokenizer.model)
        suffix = tokenizer.model.end_of_word_suffix or ""
        self.ends_differ = bool(suffix)
        spelt = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
        self.lengths = np.array([len(s.removesuffix(suffix)) if suffix else len(s) for s in spelt])
        added = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: k for k, t in added.items()}
        #: Added tokens that change what stands beside them, or that are sought in normal form, need the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())

    def piece(self, text: str) -> bytes:
        """The ids of a stretch of text, as little-endian 32-bit numbers."""
        if not self.plain:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found = [(text.find(s), s) for s in self.special if s in text]
        if found:
            at, content = min(found, key=lambda x: (x[0], -len(x[1])))
            rest = text[at + len(content) :]
            before = self.piece(text[:at]) if at else b""
            return before + self.special[content].to_bytes(4, "little") + (self.piece(rest) if rest else b"")
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        units = [u for u, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        out, short = [], []
        for unit in units:
            if len(unit) > LEAF:
                out += [*self._each(short), self.unit(unit)]
                short = []
            else:
                short.append(unit)
        out += self._each(short)
        return np.concatenate([np.zeros(0, np.int64), *out]).astype("<u4").tobytes()

    def _each(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.bare.encode_batch(units, add_special_tokens=False)] if units else []

    def unit(self, text: str) -> np.ndarray:
        """The ids of one unit of the vocabulary's own splitting."""
        edges = list(range(0, len(text), LEAF)) + [len(text)]
        level = self.leaves(text, edges)
        while len(level) > 1:
            level = [self.join(text, *level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0].ids

    def leaves(self, text: str, edges: list[int]) -> list[Tokens]:
        """The leaves between the edges, every thread with a run of them."""
        spans = list(zip(edges, edges[1:], strict=False))
        share = -(-len(spans) // THREADS)
        runs = [spans[k : k + share] for k in range(0, len(spans), share)]
        made = _pool().map(lambda run: [self.encode(text, a, b) for a, b in run], runs)
        return [t for run in made for t in run]

    def encode(self, text: str, begin: int, end: int) -> Tokens:
        ids = np.array(self.bare.encode_batch([text[begin:end]], add_special_tokens=False)[0].ids, np.int64)
        ends = begin + np.cumsum(self.lengths[ids])
        return Tokens(ids, np.concatenate([[begin], ends[:-1]]), begin, end)

    def _same(self, window: Tokens, side: Tokens, first: int, last: int) -> np.ndarray:
        """Which tokens of the window the side has at the same place among its own from first to last. The window's last token
        doesn't count where the vocabulary marks ends of words, as the window mostly ends inside one."""
        starts, ids = side.starts[first:last], side.ids[first:last]
        place = np.minimum(np.searchsorted(starts, window.starts), max(len(starts) - 1, 0))
        same = (starts[place] == window.starts) & (ids[place] == window.ids) if len(starts) else np.zeros(len(window.ids), bool)
        if self.ends_differ:
            same[-1] = False
        return same

    def join(self, text: str, left: Tokens, right: Tokens) -> Tokens:
        """Two encoded neighbours as one."""
        a = b = KNOWN
        while True:
            first = max(len(left.ids) - a, 0)
            low = int(left.starts[first])
            high = int(right.starts[b]) if b < len(right.ids) else right.end
            window = self.encode(text, low, high)
            u, v = 0, len(window.ids)
            if first:  # the left's last token may only be its own end's
                same = self._same(window, left, first, len(left.ids) - self.ends_differ)
                u = int(same.argmax()) if same.any() else -1
            if high < right.end:
                same = self._same(window, right, 0, b)
                v = len(same) - 1 - int(same[::-1].argmax()) if same.any() else -1
            if u >= 0 and v >= 0:
                break
            a, b = a if u >= 0 else 4 * a, b if v >= 0 else 4 * b
        kept = int(np.searchsorted(left.starts, window.starts[u])) if first else 0
        taken = int(np.searchsorted(right.starts, window.starts[v])) if high < right.end else len(right.ids)
        ids, starts = (np.concatenate([getattr(left, c)[:kept], getattr(window, c)[u:v], getattr(right, c)[taken:]]) for c in ("ids", "starts"))
        return Tokens(ids, starts, left.begin, right.end)

