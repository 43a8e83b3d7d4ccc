import itertools
import random
import re
from collections import Counter

from millrace.llm import filter_audit
from pyspark.sql import functions as F

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(docs, labels):
    """Every order, applied to the rows one filter after the other."""
    out, failing = {}, []
    for doc_id, text, lang in docs:
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "") for i, t, _ in docs)
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        good, toxic = any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)
        failing.append((lang or "", {k for k, v in fails(text or "").items() if v} | ({"E"} if copy else set()), good, toxic))
    for part in {f[0] for f in failing}:
        rows, shapley = [f for f in failing if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, c in enumerate(order):
                gone = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(gone)
                all_ = sum(c in f[1] for f in rows)
                out[part, "".join(order), k + 1] = [len(left), len(gone), all_ - len(gone), sum(f[1] == {c} for f in rows), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def found(docs, labels):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(docs, labels).collect()}


def drawn(seed, n):
    draw = random.Random(seed)
    texts = ["", None, "a b", "A B C", "x " * 250, " ".join(f"w{k}" for k in range(220)), " ".join(f"w{k}" for k in range(220)) + " $", "\x0bq\x0c|", "É é" * 80, "Q" + " v" * 300]
    return [(draw.choice([None, *range(n)]), draw.choice(texts), draw.choice(["en", "de", "", None])) for _ in range(n)]


def test_equals_brute_force(spark):
    for seed in range(3):
        docs = drawn(seed, 120)
        labels = [(k % 90, k % 2, k % 3 // 2) for k in range(0, 120, 2)] + [(None, 1, 1), (5, None, 1)]
        df = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit("clash")).withColumn("Mask", F.lit(1)).repartition(7)
        assert found(df, spark.createDataFrame(labels, LABELS)) == brute(docs, labels)


def test_small_heaps_give_the_same(spark, monkeypatch):
    docs = drawn(9, 200)
    rows = [(i, t or "", p or "", hash(t) & 1) for i, t, p in docs]  # two fingerprints only: long chains
    monkeypatch.setattr(filter_audit, "HELD", 10)
    routed = sorted(filter_audit._settled(iter(rows)), key=lambda kv: kv[0])
    texts = {}
    for i, t, _, _ in rows:
        if i is not None:
            texts[t] = min(i, texts.get(t, i))
    masks = Counter()
    for doc_id, part, failed, n in filter_audit._decided(iter(routed)):
        masks[doc_id, part, failed] += n
    plain = Counter((i, p, filter_audit.mask(t, t.encode()) | (16 if i is not None and i > texts[t] else 0)) for i, t, p, _ in rows)
    assert masks == plain


def test_a_hot_text_travels_once_for_each_task(spark):
    docs = spark.range(0, 4000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("text")).rdd.mapPartitions(filter_audit._settled).collect()
    assert sum(data == b"same text" for _, (_, data) in rows) == 8
    keys = Counter(k % 8 for k, (_, data) in rows if data is None)
    assert max(keys.values()) < 2 * min(keys.values())
    copies = filter_audit.masks(docs).where("mask >= 16").agg(F.sum("n")).first()[0]
    assert copies == docs.where("text = 'same text'").count() - 1


def test_empty_tables(spark):
    labels = spark.createDataFrame([], LABELS)
    assert found(spark.createDataFrame([], DOCS), labels) == {}
    docs = [(1, None, None), (2, "", "en")]
    assert found(spark.createDataFrame(docs, DOCS), labels) == brute(docs, [])
