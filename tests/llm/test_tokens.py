import hashlib
import random
import shutil
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from millrace.llm import bpe, packing, token_files
from millrace.llm.tokens import Encoder, library

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "a   b", " a b ", "a \n b", "x<|endoftext|> y <|endoftext|>", "don't I'll 'S É é ́x  İstanbul ΣΑΣ ß", "\x1c a \x1d b", "日本 語 　 x", "\r\n a", "🙂 🙂x", "A ̀B", "a_b a^ ſt ŉ"]
DOCS = [(k, t, "extra") for k, t in enumerate([*ODD, None, "word " * 3000, "ab" * 5000, "same text", "same text"])] + [(0, "", "extra"), (None, "no id", None)]
SCHEMA = "doc_id long, text string, ids string"


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    draw, alphabet = random.Random(3), " \n\tab'sé́.1 Σ🙂<\x1cÉŸ,_`^~"
    texts = ODD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    library = Tokenizer.from_file(path)
    for text, got in zip(texts, Encoder(path).ids(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("leaf", [2, 7, 1024])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_concatenation_equals_library(path, leaf, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    draw, own, enc = random.Random(5), library(path), Encoder(path)
    for alphabet in ("a", "ab", "theandofing", "é日a", "=-", "abc.1\n", " ", " \n\ta", "'sla ", "e\u0301\u0323x ", "🙂‍ 漢字1", "Σİß "):
        for n in (0, 1, 30, 1025, 3001):
            text = "".join(draw.choice(alphabet) for _ in range(n)) + draw.choice(["", "<|endoftext|>x", "<|endoftext|><|endoftext|>", "<|endof"])
            assert np.frombuffer(bpe.tree_concat(enc, text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text[:50])


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_tree_concatenation_joins_documents(path, monkeypatch):
    joined, join = [], bpe.join
    monkeypatch.setattr(bpe, "join", lambda *a: joined.append(a[2].end) or join(*a))
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    own, enc = library(path), Encoder(path)
    for text in texts:
        assert np.frombuffer(bpe.tree_concat(enc, text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
    assert len(joined) >= sum(len(t) > bpe.LEAF for t in texts) > 0


def test_kind_of_vocabulary_stands_in_its_file(tmp_path):
    for k, path in enumerate((WORD, BYTE)):
        shutil.copy(path, tmp_path / f"v{k}.json")
        assert Encoder(str(tmp_path / f"v{k}.json")).drops_white == (path == WORD)


def test_bpe_query_rows(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    library = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert r["ids"] == ids(BYTE, r["text"])
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r["doc_id"], len(r["ids"]), digest(",".join(map(str, r["ids"])).encode()), digest(r["decoded"].encode())) for r in got]
    assert sorted(map(tuple, bpe.digests(docs, BYTE).collect()), key=str) == sorted(want, key=str)
    assert bpe.digests(docs.limit(0), BYTE).count() == 0


def test_token_files(spark, tmp_path):
    token_files.write(spark.createDataFrame(DOCS, SCHEMA), f"file://{tmp_path}/t", WORD)
    rows = sorted(token_files.digests(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    back = {(r["doc_id"], r["start"]): r["ids"] for r in token_files.read(spark, f"file://{tmp_path}/t").collect()}
    assert all(zlib.crc32(np.array(back[r["doc_id"], r["start"]], "<u4")) == r["ids_crc32"] for r in rows)
    assert [r["doc_id"] for r in rows] == sorted((d[0] for d in DOCS), key=lambda k: (k is not None, k))
    start = 0
    want = sorted((d if d is not None else -1, zlib.crc32(np.array([*ids(WORD, t), 1], "<u4"))) for d, t, _ in DOCS)
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids_crc32"]) for r in rows) == want
    token_files.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/e", WORD)
    assert token_files.read(spark, f"file://{tmp_path}/e").count() == token_files.digests(spark, f"file://{tmp_path}/e").count() == 0


def check_packing(rows, docs, capacity):
    whole, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        whole[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    for doc, text in docs:
        want = [*ids(WORD, text), 0]
        parts = [want[k : k + capacity] for k in range(0, len(want), capacity)]
        own = sorted(whole[doc], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4"))) for k, p in enumerate(parts)]
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark):
    docs = [(k, t, "x") for k, (_, t, _) in enumerate(DOCS)]
    rows = packing.pack(spark.createDataFrame(docs, SCHEMA), WORD).collect()
    used, least = check_packing(rows, [(d, t) for d, t, _ in docs], packing.CAPACITY)
    assert used == least
    assert packing.pack(spark.createDataFrame([], SCHEMA), WORD).count() == 0


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check_packing(packing.pack(docs, WORD).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()], packing.CAPACITY)
    assert used <= least + 1


def test_files_skip_row_groups(spark, tmp_path):
    """A filter on doc_id reaches the reader, which then reads far fewer rows than there are."""
    docs = spark.range(40_000).selectExpr("id * 7 % 40000 AS doc_id", "concat('text ', id) AS text")
    token_files.write(docs, f"file://{tmp_path}/t", WORD)
    rows = token_files.rows_of(spark, f"file://{tmp_path}/t").where("doc_id = 7777")
    assert rows.count() == 1
    plan = rows.select("doc_id", "ids")
    assert "EqualTo(doc_id,7777)" in plan._jdf.queryExecution().toString()
    plan.collect()
    scan = plan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numOutputRows").value() <= 4 * token_files.ROW_GROUP
    data = b"".join(p.read_bytes() for p in (tmp_path / "t").glob("*.orc"))
    assert b"doc_id" in data
    metadata = [orc.ORCFile(p) for p in (tmp_path / "t").glob("*.orc")]
    assert sum(f.nrows for f in metadata) == 40_000 and all(f.row_index_stride == token_files.ROW_GROUP for f in metadata)


def test_clashing_columns_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b", 5, "x", 1), (1, "a b", 6, "y", 2), (None, "c", 7, "z", 3), (None, None, 8, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, n_tokens string, length int")
    token_files.write(docs, f"file://{tmp_path}/c", WORD)
    assert sorted(r["n_tokens"] for r in token_files.digests(spark, f"file://{tmp_path}/c").collect()) == [1, 2, 3, 3]
    packed = packing.pack(docs, WORD).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packed) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == 4
