"""Encoding with the tokenizers library, one call for each new word instead of each text.

Both vocabularies split a text at least where a single space stands between two other visible characters, so the ids of
a text are those of its pieces in order. Workers keep the ids of short pieces that they have met.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

from millrace.llm.unsplit import Unsplit

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Pieces and runs of punctuation that a worker keeps, twice, at some 160 bytes each, and the longest piece that it keeps.
MAX_KEPT, MAX_MARKS, MAX_PIECE = 400_000, 20_000, 64
#: Pieces of more characters are encoded by halves; the ids of the last few are remembered.
LONG, REMEMBERED = 4096, 4
#: Latin letters that are their own normal form, then ASCII punctuation but for the apostrophe: two units of the splitting.
_LATIN, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]", r"[!-&(-/:-@\[-`{-~]"
_WORD, _SPACED_WORD = re.compile(f"({_LATIN}+)({_MARKS}*)"), re.compile(f"( ?{_LATIN}+)({_MARKS}*)")
#: Byte-level vocabularies spell bytes that aren't visible Latin-1 characters as the code points from 256 on.
_SPELT = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_SPACE = chr(_SPELT[32])
_SPLIT = re.compile(r"(?<=\S) (?=\S)")


class _Kept(dict):
    """Values by text, made when they are missed. When it is full, its entries become the older half: an entry that is
    missed again comes back from there, the others go with the next filling."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__()
        self.most, self.make, self.older = most, make, {}

    def __missing__(self, text: str) -> bytes:
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
            if len(text) > MAX_PIECE:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


@functools.cache
def library(path: str):
    """This worker's tokenizer of a vocabulary file, without truncation and padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Encoder:
    """ids(texts) gives the ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = MAX_KEPT):
        self.tokenizer = library(path)
        #: Words carry their end, and white space goes, if the vocabulary's model has a suffix for ends of words.
        self.drops_white = bool(self.tokenizer.model.end_of_word_suffix)
        self.simple = (_WORD if self.drops_white else _SPACED_WORD).fullmatch
        self.halves, self.long = None, {}
        self.known, self.marks = _Kept(most, self._piece), _Kept(MAX_MARKS, self._run)

    def pieces(self, text: str) -> list[str]:
        if self.drops_white:
            return text.replace("\n", " ").split(" ")
        found = text.split(" ") if "  " not in text and text[:1] != " " and text[-1:] != " " and not _odd_white(text) else _SPLIT.split(text)
        return [found[0], *[" " + x for x in found[1:]]]

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece: letters and the punctuation after them each for themselves, others by the library. Letters
        alone, lower-cased where the vocabulary does that, are a piece of their own and kept as one."""
        if len(piece) <= MAX_PIECE and (m := self.simple(piece)):
            letters, marks = m.groups()
            if self.drops_white:
                letters = letters.lower()
            if marks:
                return self.known[letters] + self.marks[marks]
            return self._run(letters) if letters == piece else self.known[letters]
        if len(piece) > LONG:
            return self._long(piece)
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _long(self, piece: str) -> bytes:
        """The ids of a long piece, by halves."""
        if piece not in self.long:
            self.halves = self.halves or Unsplit(self.tokenizer)
            while len(self.long) >= REMEMBERED:
                del self.long[next(iter(self.long))]
            self.long[piece] = self.halves.piece(piece)
        return self.long[piece]

    def _run(self, run: str) -> bytes:
        """The ids of one unit of the vocabulary's own splitting: Latin letters (after a space), or ASCII punctuation."""
        if run.isascii():  # only its first character can be a space
            spelt = run if run[0] != " " else _SPACE + run[1:]
        else:
            spelt = run.encode().decode("latin-1").translate(_SPELT)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        find = self.known.__getitem__
        return [b"".join(map(find, self.pieces(t))) for t in texts]


def _odd_white(text: str) -> bool:
    """Whether white space other than the plain space may stand beside a space."""
    return not text.isprintable()


@functools.cache
def encoder(path: str, most: int = MAX_KEPT) -> Encoder:
    """This worker's encoder for a vocabulary file, which keeps so many pieces, twice."""
    return Encoder(path, most)
