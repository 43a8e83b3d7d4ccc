import numpy as np

import corpus_pipeline as c
from millrace.llm import language, packing
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import check_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, docs, sf_dir):
    out = []
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs.collect())
    return out


def test_stages_follow_their_definitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang, good, single, packed = stages(spark, docs, sf)
    rows = docs.collect()
    assert [list(r.asDict()) for r in lang[:1] + good[:1] + single[:1]] == [list(c.COLUMNS)] * 3

    model = language.fit(docs.where(~language.held_out(docs["doc_id"])))
    for r in rows[:60]:  # naive Bayes by hand
        grams = language.ngrams([r["text"]])[0]
        logs = model.prior + model.likelihood[grams].sum(0)
        chance = np.exp(logs - logs.max())
        known = language.has_letter(r["text"]) and (chance / chance.sum()).max() >= c.LEAST_SCORE
        assert (r["doc_id"] in {x["doc_id"] for x in lang}) == known

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["doc_id"] in {x["doc_id"] for x in good}) for r in lang if r["doc_id"] in labels]
    assert sum(bool(q) == k for q, k in judged) > 0.9 * len(judged)  # tests of the models have the draw by hand

    assert sorted(r["doc_id"] for r in single) == sorted(d for d, _, _, kept in brute([(r["doc_id"], r["text"]) for r in good]) if kept)
    used, least = check_packing(packed, [(r["doc_id"], r["text"]) for r in single], packing.CAPACITY)
    assert used <= least + 1


def test_odd_rows(spark, sf):
    text = " ".join(f"the of and to word{k}" for k in range(30))
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "12 !", "en", "s", 4), (None, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (4, text.upper(), "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("row_key", c.F.lit("clash"))
    lang, good, single, packed = stages(spark, docs, sf)
    assert len(lang) == 4
    assert [r["doc_id"] for r in single] in ([4], [])
    assert [len(x) for x in stages(spark, docs.limit(0), sf)] == [0, 0, 0, 0]


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r)[:5] for r in c.run(spark, sf).collect()} == {tuple(r)[:5] for r in stages(spark, docs, sf)[-1]}
