"""Tree concatenation of tokens inside unsplit text against the library."""

import random

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import bpe, unsplit
from millrace.llm.tokens import Encoder, library

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "theandofing", "é", "日本語漢字", "=-", "'st", "aA1", "🙂‍", "Σİß", "0", "é")


def own(path, text):
    return library(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 2, 5, 16, 100, 4096])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_pieces_equal_the_library(path, leaf, monkeypatch):
    monkeypatch.setattr(unsplit, "LEAF", leaf)
    draw, made = random.Random(leaf), unsplit.Unsplit(library(path))
    for alphabet in ALPHABETS:
        for n in (1, 2, 7, 33, 250, 1200) + ((20_000,) if leaf > 99 else ()):
            text = "".join(draw.choices(alphabet, k=n))
            assert np.frombuffer(made.piece(text), "<u4").tolist() == own(path, text), (alphabet, n)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_added_tokens_inside_a_piece(path):
    made = unsplit.Unsplit(library(path))
    for text in ("<|endoftext|>", "a<|endoftext|><|endoftext|>b", "x" * 5000 + "<|endoftext|>" + "y" * 5000, "<|startoftext|>q", "<|endof" + "z" * 4100):
        assert np.frombuffer(made.piece(text), "<u4").tolist() == own(path, text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_million_characters_are_encoded_once_and_little_more(path, monkeypatch):
    draw, enc = random.Random(1), Encoder(path)
    text = "".join(draw.choices("theandofingbrwk", k=1_000_000))
    encoded, taken = [], []
    encode, join = unsplit.Unsplit.encode, unsplit.Unsplit.join

    def counted(self, text, begin, end):
        encoded.append(end - begin)
        return encode(self, text, begin, end)

    def watched(self, text, left, right):
        out = join(self, text, left, right)
        both = np.intersect1d(left.starts, out.starts).size + np.intersect1d(right.starts, out.starts).size
        taken.append((both, len(out.ids)))
        return out

    monkeypatch.setattr(unsplit.Unsplit, "encode", counted)
    monkeypatch.setattr(unsplit.Unsplit, "join", watched)
    ids = np.frombuffer(bpe.tree_concat(enc, text), "<u4").tolist()
    assert ids == own(path, text)
    assert len(taken) == -(-1_000_000 // unsplit.LEAF) - 1
    assert sum(encoded) < 1_050_000  # each character once, and the windows
    assert all(both > 0.99 * n for both, n in taken)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_unsplit_stretches_in_spaced_text(path):
    draw, enc = random.Random(2), Encoder(path)
    word = lambda n: "".join(draw.choices("abcdeé日'1-", k=n))
    for sizes in ([9000], [3, 20_000, 4], [5000, 5000, 5000], [1] * 3000 + [12_000] + [2] * 3000):
        text = " ".join(word(n) for n in sizes)
        assert np.frombuffer(bpe.tree_concat(enc, text), "<u4").tolist() == own(path, text)


def test_runs_that_never_fall_into_step_stay_right(monkeypatch):
    monkeypatch.setattr(unsplit, "LEAF", 50)
    made = unsplit.Unsplit(library(BYTE))
    for text in ("abc" * 900, "=" * 1001, "-" * 777, "ab" * 501 + "a"):
        assert np.frombuffer(made.piece(text), "<u4").tolist() == own(BYTE, text)
