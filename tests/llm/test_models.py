import zlib

import numpy as np
import pytest

from millrace.llm import audio, html_extract, language, near_dedup, quality, topk
from millrace.llm.text import buffers, chunks, mix, shingles, word_hashes
from pyspark.sql import functions as F

import pyarrow as pa

ODD = [(0, None, "en"), (1, "", "en"), (2, "12 34 !?", None), (None, "no id at all", "en"), (3, "x" * 200_000, "de"), (4, "same", None), (4, "same", None), (5, "퟿ é 日本", "fr")]
DOCS = "doc_id long, text string, lang string"


def test_word_hashes_follow_the_definition():
    texts = ["", "  ", "The the\tTHE", "a\x0bb\x0cc\r\nd e f", "é É", "word", " x " * 700, "\x1c\x85"]
    hashes, counts = word_hashes(*buffers(pa.array(texts)))
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    words = [[lower(w) for w in t.encode().split()] for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) == len({*zip(flat, hashes.tolist(), strict=True)})
    runs, per = shingles(hashes, counts, 5)
    want = [tuple(ws[k : k + 5]) for ws in words for k in range(max(len(ws) - 4, min(len(ws), 1)))]
    assert len(runs) == len(want) == per.sum()
    assert len(set(want)) == len(set(runs.tolist())) == len({*zip(want, runs.tolist(), strict=True)})


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(ODD, DOCS)
    rows = language.predict(odd.withColumn("score", F.lit("clash")), language.fit(docs.union(odd))).collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and rows[0]["score"] == 0.0 and len(rows) == len(ODD)
    assert rows[5][:2] == rows[6][:2] and rows[5]["lang_pred"] == rows[6]["lang_pred"] != "und"
    assert language.identify(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def bucket(three):
    """The hash of up to three characters, written out with Python's whole numbers."""
    state = 0
    for c, factor in zip(three, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        state = ((state ^ ord(c)) * factor) % 2**32
        state ^= state >> 15
    return (state * 0x27D4EB2F) % 2**32 >> 17


def test_ngrams_equal_brute_force():
    texts = ["ab", "", "Aé c", "x", "İΣ 日本"]
    grams, begins = language.ngrams(texts)
    for k, t in enumerate(texts):
        padded = " " + t.lower() + "  "
        want = [bucket(padded[i : i + n]) for i in range(len(padded) - 2) for n in (1, 2, 3)] + [0, 0, 0]
        assert grams[begins[k] : begins[k + 1]].tolist() == want


def test_language_of_a_long_text_in_slices(monkeypatch):
    text = "Der Anfang und das Ende İ. " * 3_000
    whole = language.ngrams([text])[0]
    monkeypatch.setattr(language, "CHUNK", 1000)
    monkeypatch.setattr(language, "chunks", lambda offsets: chunks(offsets, 1000))
    slices = list(language.parts(["a", text, "b"]))
    assert len(slices) > 50 and np.array_equal(np.concatenate([g for a, _, g, _ in slices if a == 1]), whole)


def test_no_letter_is_undetermined(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    rows = language.predict(spark.createDataFrame([(1, "²½①"), (2, "_ 7 \u0301"), (3, "²a"), (4, "日")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(rows)] == [True, True, False, False]


def test_quality_of_documents_that_nothing_was_learned_from(spark, sf):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.resample(docs, labels.where("doc_id % 4 <> 1")).join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["keep"] == bool(r["quality"]) for r in rows]) > 0.9
    again = {(r["doc_id"], r["keep"]) for r in quality.resample(docs, labels.where("doc_id % 4 <> 1")).collect()}
    assert again >= {(r["doc_id"], r["keep"]) for r in rows}


def grams_of(text):
    """The buckets of words and pairs of words, from the words' hashes alone."""
    hashes = word_hashes(*buffers(pa.array([text or ""])))[0].tolist()
    pairs = [int(mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) for a, b in zip(hashes, hashes[1:])]
    return [h >> 49 for h in hashes + pairs]


def test_quality_equals_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = quality.labelled(labels)
    assert {d: q for d, (q, _) in known.items()} == {r["doc_id"]: r["quality"] for r in labels.collect()} and {h for _, h in known.values()} == {0, 1}
    weights = quality.fit(docs, known)
    raw, good, each = np.zeros(quality.BUCKETS), np.zeros((2, quality.BUCKETS)), {}
    for r in docs.collect():
        each[r["doc_id"]] = own = grams_of(r["text"])
        np.add.at(raw, own, 1)
        q, half = known.get(r["doc_id"], (0, 0))
        if q:
            np.add.at(good[half], own, 1)
    want = []
    for g in good:
        g = g + (g.sum() + 1) / (raw.sum() + 1)
        want.append(np.log(g / g.sum()) - np.log((raw + 1) / (raw + 1).sum()))
    assert np.allclose(weights, want)
    mean = lambda d, n: want[n][each[d]].sum() / (len(each[d]) + quality.SHRINK)
    ratio = {d: mean(d, 1 - known[d][1]) if d in known else (mean(d, 0) + mean(d, 1)) / 2 for d in each}
    x, y = np.array([ratio[d] for d in known]), np.array([q > 0 for q, _ in known.values()])
    a, b = quality.curve(x, y)

    def loss(a, b):
        n = y.sum()
        t, z = np.where(y, (n + 1) / (n + 2), 1 / (len(y) - n + 2)), a + b * x
        return (np.logaddexp(0, z) - t * z).sum()

    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.1, 0, 0.1))
    noise = {r["doc_id"]: (r["noise"], r["log_ratio"]) for r in quality.ratios(docs, weights, known).collect()}
    keys, size = {}, 0.0
    for d, own in each.items():
        assert np.isclose(noise[d][1], ratio[d])
        u = int(mix(np.array([(d * 0x9E3779B97F4A7C15 + len(own) + quality.SEED) % 2**64], np.uint64))[0])
        assert np.isclose(noise[d][0], -np.log(-np.log((u >> 11) / 2**53 + 2**-54)))
        log_weight = -np.logaddexp(0, -(a + b * ratio[d]))
        size += np.exp(log_weight)
        keys[d] = log_weight + noise[d][0]
    kept = {r["doc_id"] for r in quality.resample(docs, labels).where("keep").collect()}
    assert kept == set(sorted(keys, key=keys.get)[-max(1, round(size)) :])


def test_gumbel_draws_follow_the_weights():
    """Of one document drawn, each is drawn as often as its share of the weights."""
    weights, ids = np.array([1.0, 2.0, 5.0]), np.arange(3)
    drawn = np.bincount([int(np.argmax(np.log(weights) + quality._gumbel(ids + 1000 * k, np.full(3, k, np.uint64)))) for k in range(20_000)], minlength=3) / 20_000
    assert np.abs(drawn - weights / weights.sum()).max() < 0.02


def test_quality_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "good words here", 1, "x"), (2, "bad", 2, "y")], "doc_id long, text string, noise int, label string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.resample(docs, labels, ("doc_id", "noise", "label", "text")).columns == ["doc_id", "label", "text", "log_weight", "gumbel_key", "keep"]


def test_quality_odd_rows(spark):
    odd, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.resample(odd, none).collect()
    assert len(rows) == len(ODD) and all(r["keep"] for r in rows)
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0), (4, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.resample(odd, labels).collect()
    assert len(rows) == len(ODD) and len({r["keep"] for r in rows if r["doc_id"] == 4}) == 1
    assert quality.resample(odd.limit(0), labels).count() == 0


@pytest.mark.parametrize("k", [1, 7, 50, 100])
def test_kth_largest(spark, k):
    values = np.random.default_rng(k).normal(0, 9, 90).tolist() + [5.0] * 8 + [float("-inf"), 1e300]
    df = spark.createDataFrame([(v,) for v in values], "gumbel_key double").select("gumbel_key", quality.ordered(F.col("gumbel_key")).alias("o"))
    whole = sorted(r["o"] for r in df.collect())
    assert quality.kth_largest(df, k) == whole[-k] and whole == [r["o"] for r in df.orderBy("gumbel_key").collect()]


def brute_top(rows, k=20):
    ints = {}
    usable = [(i, np.floor(np.array(v, np.float64) * 64).astype(int)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, x in usable:
        if q % 20 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in usable if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = topk.top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == brute_top(rows)


def test_top_k_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=3).tolist()) for k in range(60)] + [(k, [0.5, 0.5, 0.5]) for k in range(60, 100)]
    rows += [(100, None), (101, [float("nan"), 1.0, 1.0]), (102, [None, 1.0, 1.0]), (103, [float("inf"), 0.0, 0.0]), (104, [0.0, 0.0, 0.0]), (120, [0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_audio_round_trip(spark):
    import hashlib

    docs = spark.createDataFrame(ODD, DOCS)
    media = audio.store(docs)
    rows = audio.digests(media).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for r in rows:
        texts = [t for i, t, _ in ODD if i == r["doc_id"]]
        raw = (texts[0] or "").encode()
        own = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]))
        assert by_text.setdefault(texts[0] or "", r[1:]) == r[1:]
    assert audio.digests(audio.store(docs.limit(0))).count() == 0
    blocks = audio.tensors(media).collect()
    assert all(len(b["log_mel"]) == audio.BLOCK * audio.MELS and b["start_s"] < b["end_s"] for b in blocks)


def test_audio_features():
    t = np.arange(8000)
    x = np.sin(2 * np.pi * 500 * t / 8000).astype(np.float32)
    y = audio.resample(x)
    slow = [sum(audio.PHASES[n * 4 % 3][j] * (x[n * 4 // 3 - 15 + j] if n * 4 // 3 - 15 + j >= 0 else 0) for j in range(16)) for n in range(0, 6000, 97)]
    assert len(y) == 6000 and np.allclose(y[::97], slow, atol=1e-5)
    assert abs(np.abs(y[100:]).max() - 1) < 0.05 and np.abs(np.fft.rfft(y)).argmax() == 500
    energy = np.array([0, 0, 5, 2.4, 2.3, 0, 2.4, 5, 0.0])
    assert audio.active_frames(energy).tolist() == [False, False, True, True, True, False, False, True, False]


def test_log_mel_equals_brute_force():
    samples = bytes((37 * k * k + 11 * k) % 251 for k in range(1_600))
    f = audio.analyse(samples)
    x = audio.resample((np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128)
    frames = 1 + -(-(len(x) - 256) // 128)
    x = np.concatenate([x, np.zeros(128 * frames + 256 - len(x))])
    n, top = np.arange(256), 3_000
    hertz = lambda mel: 700 * (10 ** (mel / 2595) - 1)
    edges = [hertz(2595 * np.log10(1 + top / 700) * j / 25) for j in range(26)]
    for t in (0, 1, frames // 2, frames - 1):
        part = x[128 * t : 128 * t + 256] * (0.5 - 0.5 * np.cos(2 * np.pi * n / 255))
        power = [abs(sum(part * np.exp(-2j * np.pi * b * n / 256))) ** 2 for b in range(129)]
        for j in range(24):
            low, mid, high = edges[j : j + 3]
            energy = sum(p * max(0, min((b * top / 128 - low) / (mid - low), (high - b * top / 128) / (high - mid))) for b, p in enumerate(power))
            assert abs(f.tensors.reshape(-1, 24)[t, j] - np.log10(energy + 1e-6)) < 1 / 64
    assert f.frames == frames and (f.tensors.reshape(-1, 24)[frames:] == audio.FLOOR).all()
    assert np.isclose(audio.STEP, 128 / 6_000) and np.allclose(f.blocks[:, 0], np.arange(len(f.blocks)) * 32 * audio.STEP)


def test_rounds_change_nothing(monkeypatch):
    samples = bytes((k * k) % 256 for k in range(64 * 900))
    whole = audio.analyse(samples)
    monkeypatch.setattr(audio, "ROUND", 2_048)
    again = audio.analyse(samples)
    assert audio.describe(whole) == audio.describe(again) and np.array_equal(whole.spans, again.spans)


def test_media_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a", "m", 3)], "doc_id long, text string, media string, n_bytes int")
    assert audio.digests(audio.store(docs)).count() == 1


def test_texts_of_twenty_megabytes(spark):
    text = "word of a long text " * 1_000_000
    odd = spark.createDataFrame([(1, text, "en"), (2, "x" * 2_000_000, "de"), (3, "short text", "en")], DOCS)
    assert {r["doc_id"]: r["n_bytes"] for r in audio.digests(audio.store(odd)).collect()}[1] == len(text)
    assert language.identify(odd).count() == 3
    assert {r["doc_id"]: r["n_shingles"] for r in near_dedup.dedup(odd).collect()} == {1: 5, 2: 1, 3: 1}
    page = spark.createDataFrame([(1, "<html><body><nav><a href=/>x</a></nav><article><p>" + text + "</p></article></body></html>")], "page_id long, html string")
    assert html_extract.extract(page).first()["n_chars"] == len(text) - 1


def test_pairs_of_blocks_and_partial_sums(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(k, (draw.normal(size=12) * draw.choice([0.2, 1.0, 6.0])).astype(np.float32).tolist()) for k in range(900)]
    for name, value in (("BLOCK", 64), ("STEP", 16), ("QUERIES", 16), ("SEEDS", 64), ("GRID", 3)):
        monkeypatch.setattr(topk, name, value)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()} == brute_top(rows)
    q = np.array([[3, 0, 0, 0], [0, 2, 0, 0]], np.int64)
    counted, products = [], topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: counted.append(a.shape[0] * b.shape[0]) or products(a, b))
    search = topk.Search(q, np.array([1, 2]), np.full(2, -np.inf), np.eye(4), 1)
    search.add(np.array([[9, 0, 0, 0], [0, 9, 0, 0]] + [[1, 1, 0, 0]] * 62, np.int64), np.arange(10, 74))
    assert search.rows().to_pylist() == [{"query_id": 1, "vec_id": 10, "score": 27}, {"query_id": 2, "vec_id": 11, "score": 18}]
    assert sum(counted) < 2 * 64


def test_languages_in_blocks_equal_one_block(spark, sf, monkeypatch):
    """Blocks of three languages learn and say what one block does; every language counts, however many there are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.concat("lang", (F.col("doc_id") % 2).cast("string")).alias("lang"))
    whole = language.fit(docs)
    assert len(whole.languages) == 8
    monkeypatch.setattr(language, "BLOCK", 3)
    parts = language.fit(docs)
    assert parts.languages == whole.languages and np.array_equal(parts.likelihood, whole.likelihood) and np.array_equal(parts.prior, whole.prior)
    many = spark.range(600).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"), F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("lang"))
    monkeypatch.setattr(language, "BLOCK", 256)
    model = language.fit(many)
    assert len(model.languages) == 600 and model.likelihood.shape == (language.BUCKETS, 600)
    found = language.predict(many.select(F.col("id").alias("doc_id"), "text"), model).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id']:03}" for r in found]) > 0.9
