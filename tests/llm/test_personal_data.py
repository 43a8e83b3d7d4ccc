import hashlib
import random
import re
import time

from millrace.llm import personal_data as pd_
from pyspark.sql import functions as F

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = 0
        for k, d in enumerate(map(int, digits[::-1])):
            total += d if k % 2 == 0 else sum(divmod(2 * d, 10))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    """The base spans by the plain patterns."""
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def base(text):
    return [(s.kind, s.start, s.end) for s in pd_.find(text) if s.kind in pd_.BASE]


def test_base_spans_equal_the_patterns_on_random_texts():
    draw = random.Random(5)
    for alphabet in ("a.@-+ ", "0123. -+()", "01.", "a1@.-é", "4 -", "+1 ().-9x", "aB9._%+-@ é"):
        for _ in range(3000):
            text = "".join(draw.choices(alphabet, k=draw.randint(0, 40)))
            assert base(text) == brute(text), text


def test_base_spans_equal_the_patterns_on_documents(spark, sf):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert sum(len(base(t)) for t in texts) > 3
    assert [base(t) for t in texts] == [brute(t) for t in texts]


def test_edges_of_the_base_kinds():
    assert base("a@b.c_d@e.f@g.h") == brute("a@b.c_d@e.f@g.h")
    assert base("0255.000.1.2 256.1.1.1 1.2.3.4.5.6.7.8") == [("ip", 0, 12), ("ip", 23, 30), ("ip", 31, 38)]
    assert base("4111 1111 1111 1111") == [("card", 0, 19)] and base("4111 1111 1111 1112") == []
    assert base("4111 1111 1111 1111 7") == []  # the whole run fails, and there is no second try
    assert base("x +49 (0)30 123456. y") == [("phone", 2, 18)]


def test_further_kinds_need_their_checksum_or_a_word_nearby():
    iban = "DE89 3704 0044 0532 0130 00"
    assert [s.kind for s in pd_.find(f"Konto {iban} IS") if s.kind == "iban"] == ["iban"]
    assert not [s for s in pd_.find(iban.replace("89", "88")) if s.kind == "iban"]
    assert pd_.mod97("GB82WEST12345698765432") and not pd_.mod97("GB82WEST1234569876543") and not pd_.mod97("ZZ82WEST12345698765432")
    assert [(s.kind, s.start, s.end) for s in pd_.find("her SSN 123-45-6789")] == [("ssn", 8, 19)]
    assert pd_.find("part 123-45-6789") == [] and pd_.find("ssn 000-45-6789 666-45-6789 123-00-6789") == []
    assert [s.kind for s in pd_.find("call (030) 555-1234 now")] == ["local"] and pd_.find("the 030 555-1234 thing") == []
    assert [s.kind for s in pd_.find("call +1 (030) 555-1234")] == ["phone"]  # no further span over a base one


def test_words_nearby_adjust_the_score():
    plain, raised, lowered = (pd_.find(t)[0].score for t in ("x 10.1.2.3", "login from 10.1.2.3", "version 10.1.2.3"))
    assert lowered < plain < raised and len(base("version 10.1.2.3")) == 1


def test_long_runs_take_time_in_proportion():
    began = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a-" * 150_000, "+1" * 150_000, "@a-b" * 75_000, "1." * 150_000, "A1" * 150_000, "+" + "1 " * 150_000 + "x"):
        pd_.find(text)
    assert time.time() - began < 20


def test_rows_of_any_kind(spark):
    odd = [(1, None, "a"), (2, "", "b"), (3, "mail x@y.zz now 4111-1111-1111-1111", "c"), (3, "mail x@y.zz now 4111-1111-1111-1111", "c"), (None, "É" * 70_000 + " +1 234 567 890", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, Spans string").withColumn("scores", F.lit(1))
    rows = sorted(pd_.digests(pd_.annotate(docs)).collect(), key=lambda r: (r["doc_id"] or 9, r["spans"]))
    empty = hashlib.sha256(b"").hexdigest()
    assert [r["spans"] for r in rows] == ["", "", "email:5:11,card:16:35", "email:5:11,card:16:35", "phone:70001:70015"]
    assert [r["base_sha256"] for r in rows[:2]] == [empty] * 2
    assert rows[2]["base_sha256"] == hashlib.sha256(b"email:5:11,card:16:35").hexdigest() and (rows[2]["n_email"], rows[2]["n_card"], rows[2]["n_ip"]) == (1, 1, 0)
    assert pd_.digests(pd_.annotate(docs.limit(0))).count() == 0
    clean = [r["text"] for r in pd_.redact(docs).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert clean[:3] == [None, "", "mail <email> now <card>"] and clean[4].endswith(" <phone>")


def test_query_equals_brute_force(spark, sf):
    from millrace.llm import queries

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_personal_data(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[0] == k for w in want) for k in BASE]
        assert [tuple(s.split(":")) for s in r["spans"].split(",") if s and s.split(":")[0] in BASE] == [(k, str(a), str(b)) for k, a, b in want]
