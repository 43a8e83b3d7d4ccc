import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm import collocations as co
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, least, top, words=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for ws in pieces(text or ""):
            n[lang] += len(ws)
            for m in range(1, words + 1):
                f.update((lang, tuple(ws[i : i + m])) for i in range(len(ws) - m + 1))
    out = []
    for lang in n:
        own = {p: a for (l, p), a in f.items() if l == lang and len(p) > 1 and a >= least}
        found = []
        for p, a in own.items():
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def drawn(seed, n, vocabulary):
    draw = random.Random(seed)
    marks = ["", "", "", "", "", ".", ",", "\n", "\r\n", " ! ", "\t", "  ", "\x0b"]
    return [("".join(draw.choice(vocabulary) + draw.choice(marks) + " " for _ in range(draw.randint(0, 60))), draw.choice(["en", "en", "de", None, ""])) for _ in range(n)]


VOCABULARY = ["The", "the", "a", "New", "new", "york", "É", "é", "x\x00y", "日本", "b", "\x85", "in", "of"]


@pytest.mark.parametrize("least", [2, 10, 300])
def test_equals_brute_force(spark, least):
    rows = [*drawn(1, 150, VOCABULARY), (None, "en"), ("", "de"), (" . ", "fr"), ("one " * 40, "und")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS).withColumn("phrase", F.lit(1)).withColumn("N", F.lit(2)).repartition(5)
    got = sorted(map(tuple, co.mine(docs, least).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == brute(rows, least, 2000)


def test_only_the_first_of_each_language(spark):
    rows = drawn(2, 120, VOCABULARY)
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], DOCS)
    want = brute(rows, 3, 7)
    got = sorted(map(tuple, co.mine(docs, 3, top=7).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    assert got == want


def test_bitmaps_spare_rare_phrases(spark):
    texts = [(k, f"alpha beta u{k} v{k} w{k}", "en") for k in range(400)]
    docs = spark.createDataFrame(texts, DOCS).select("text", "lang")
    co.ship(spark)
    first = co._counted(docs, 1, 10, True, None)
    frequent = first.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where("f >= 10")
    maps = co._bitmap(co._marks(frequent, 10), 10), co._bitmap(first.where("slot IS NOT NULL"), 10)
    second = {r["phrase"] for r in co._counted(docs, 2, 10, False, maps).collect()}
    assert second == {"alpha beta"}  # of 1,601 pairs of words
    assert maps[0].nbytes == maps[1].nbytes == co.BUCKETS // 8


def test_rounds_of_a_long_text_share_their_last_words(monkeypatch):
    draw = random.Random(3)
    text = "".join(draw.choice(["ab", "c", "De", "f" * 30]) + draw.choice([" ", ", ", "  ", "\t", "\n"]) for _ in range(3000))
    column = pa.array(["short one", text, None, "x y z"])
    whole = Counter()
    for t in column.to_pylist():
        for ws in pieces(t or ""):
            for m in (1, 2, 3):
                whole.update(" ".join(ws[i : i + m]) for i in range(len(ws) - m + 1))
    for size in (1 << 22, 1000, 64, 7, 1):
        monkeypatch.setattr(co, "ROUND", size)
        found = Counter()
        for words in co.rounds(column):
            begins, before = words.begins, words.before
            for m in (1, 2, 3):
                ends = [i for i in range(max(m - 1, before), len(words.codes)) if not any(begins[i - m + 2 : i + 1])]
                phrases, counts = co._phrases(words, co.np.array(ends, int), m)
                found.update(dict(zip(phrases.to_pylist(), counts.tolist(), strict=True)))
        assert found == whole, size


def test_large_numbers_stay_exact(spark):
    huge = 987_654_321_012_345
    f = spark.createDataFrame([("en", "a b", 2, huge), ("en", "a", 1, huge + 1), ("en", "b", 1, huge + 12_345)], "lang string, phrase string, words int, f long")
    row = co._weakest_cut(f.where("words > 1"), f).first()
    assert row["score"] == 1_000_000 * huge * huge // ((huge + 1) * (huge + 12_345)) == 999_999


def test_empty_and_frequentless(spark):
    empty = spark.createDataFrame([], DOCS)
    assert co.mine(empty).count() == 0
    assert co.mine(spark.createDataFrame([(1, "only once here", "en")], DOCS)).count() == 0
    with pytest.raises(ValueError):
        co.mine(empty, words=4)


def test_marks_are_the_buckets_of_each_phrase(spark):
    phrases = [("en", "a b"), ("en", "b a"), ("de", "a b"), ("", "É x\x00y"), ("en", "日本 b"), ("de", "a a")]
    for kept in (phrases, [(l, p.split(" ")[0]) for l, p in phrases], [(l, f"{p} z") for l, p in phrases]):
        want = set()
        for lang, phrase in kept:
            first, *rest = (co._hashes([w.encode()], lang) for w in phrase.split(" "))
            want.add(int(co._bucket(co.functools.reduce(co._longer, rest, first))[0]))
        marks = co._marks(spark.createDataFrame(kept, "lang string, phrase string").coalesce(1), 10)
        assert set(co.np.flatnonzero(co.np.unpackbits(co._bitmap(marks, 10))).tolist()) == want


def test_phrases_of_rounds_with_many_words():
    codes = co.np.array([0, 1, 2, 0, 1, 2, 2, 2], co.np.int64)
    begins = co.np.zeros(len(codes), bool)
    words = co.Words(codes, begins, pa.array([b"a", b"b", b"c"], pa.large_binary()), 0)

    class Many(list):  # as if a round had so many distinct words that three of them don't fit into a number
        take = staticmethod(words.known.take)

        def __len__(self):
            return 1 << 22

    for n in (1, 2, 3):
        ends = co.np.arange(n - 1, len(codes))
        found = [co._phrases(w, ends, n) for w in (words, words._replace(known=Many()))]
        counted = [dict(zip(p.to_pylist(), c.tolist(), strict=True)) for p, c in found]
        assert counted[0] == counted[1] == Counter(" ".join("abc"[c] for c in codes[e - n + 1 : e + 1]) for e in ends)


def test_held_phrases_are_counted_whole_and_frequent_ones_stay(monkeypatch):
    monkeypatch.setattr(co, "HELD", 8)
    draw, heap, rows, want = random.Random(5), co._Heap(), [], Counter()
    for k in range(60):
        some = Counter(draw.choices(["often", "and often", "x", *(f"u{k}-{i}" for i in range(6))], [5, 5, 2, *[1] * 6], k=12))
        for lang in ("en", ""):
            want.update({(lang, p): n for p, n in some.items()})
            rows += heap.add(lang, pa.array([*some]), co.np.array([*some.values()]))
        assert heap.rows <= 8
    rows += heap.out()
    assert not heap.rows and not [*heap.out()]
    got, sent = Counter(), Counter()
    for batch in rows:
        for r in batch.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
            sent[r["phrase"]] += 1
    assert got == want and sent["often"] < 60


def test_cuts_meet_the_phrases_around_without_another_exchange(spark):
    f = spark.createDataFrame([("en", "a b c", 3, 10), ("en", "a b", 2, 12), ("en", "b c", 2, 40), ("en", "a", 1, 50), ("en", "b", 1, 60), ("en", "c", 1, 70)], "lang string, phrase string, words int, f long")
    cut = co._weakest_cut(f.where("words > 1"), f)
    assert {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in cut.collect()} == {"a b c": (10, 50, 40, 50_000), "a b": (12, 50, 60, 48_000), "b c": (40, 60, 70, 380_952)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        around = f.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
        plan = cut.join(around, ["lang", "phrase"], "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(lang#\d+, phrase#\d+, a#", plan)) == 0
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 6  # the cuts three times, both sides of parts, and around
