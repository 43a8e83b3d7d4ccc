import random
import re

import numpy as np
import pytest

from millrace.llm import components, near_dedup, setsketch
from millrace.llm.text import mix


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))


def brute(rows):
    """(doc_id, n, component, kept) by comparing all pairs of distinct sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    distinct = sorted(set(sets), key=sorted)
    place = {s: k for k, s in enumerate(distinct)}
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for k, s in enumerate(distinct):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(distinct):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & distinct[j])
            if 100 * both >= 75 * (len(s) + len(distinct[j]) - both):
                root[max(find(j), find(k))] = min(find(j), find(k))
    least = {}
    for (d, _), s in zip(rows, sets):
        if s and d is not None:
            c = find(place[s])
            least[c] = min(least.get(c, d), d)
    out = []
    for (d, _), s in zip(rows, sets):
        c = least.get(find(place[s])) if s else d
        out.append((d, len(s), c, d is not None and d == c))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.dedup(df).collect()], key=str)


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert got(docs) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows_and_hot_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SINGLY", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    draw = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    texts = [None, "", " \n", "one two", "ONE\ttwo", "one two three four five six", "\x1c", "x " * 20_000]
    for _ in range(120):  # copies of one text at all distances
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(60)] = f"n{draw.randrange(200)}"
        texts.append(" ".join(words))
    rows = [(k, t) for k, t in enumerate(texts * 2)] + [(3, "one two"), (3, "one two"), (None, "one two"), (None, "lonely text of no id here")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_components(spark):
    draw = random.Random(2)
    edges = [(k, k + 1) for k in range(1000, 1100)] + [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(5, 5), (7, 2000), (2000, 7)]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    named = {x for e in edges for x in e if e[0] != e[1]}
    assert len(rows) == len(named) and {(r["node"], r["component"]) for r in rows} == {(x, find(x)) for x in named}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.75, 0.9])
def test_sketches_tell_similarity(share):
    draw = np.random.default_rng(1)
    agree, kept, best = [], [], []
    for _ in range(60):
        x = mix(draw.integers(0, 2**63, 400).astype(np.uint64))
        n = round(400 * 2 * share / (1 + share))
        y = np.concatenate([x[:n], mix(draw.integers(0, 2**63, 400 - n).astype(np.uint64))])
        r = setsketch.registers(np.concatenate([x, y]), np.array([0, 400]))
        agree.append((r[0] == r[1]).mean())
        kept.append(setsketch.plausible(r[:1], r[1:], np.array([400]), np.array([400]))[0])
        grid = np.linspace(0.01, 0.99, 99)
        up, down = (r[0] > r[1]).sum(), (r[0] < r[1]).sum()
        best.append(grid[np.argmax(setsketch.log_likelihood(up, down, 0.5, 0.5, grid))])
    assert abs(np.mean(agree) - share) < 0.03
    assert abs(np.mean(best) - share) < 0.03
    assert np.mean(kept) == (1 if share >= 0.75 else 0 if share == 0.3 else np.mean(kept))


def test_sketches_merge():
    x = mix(np.arange(1, 1001, dtype=np.uint64))
    parts = setsketch.registers(x, np.array([0, 400]))
    assert (parts.max(0) == setsketch.registers(x, np.array([0]))[0]).all()


def test_sets_join_nodes_once_for_all_their_buckets(spark):
    names = [bytes([k]) * 16 for k in range(90)]
    members = spark.createDataFrame([(b, n, 5, n, 90) for b in range(6) for n in names], "bucket long, node binary, n long, component binary, k long")
    sets = spark.createDataFrame([(n, 5, np.arange(5, dtype=np.uint64).tobytes()) for n in names], "node binary, n long, elements binary")
    linked = near_dedup._in_blocks(members, sets)
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner, (node#" in x]
    assert len(joins) == plan.count("collect_list(struct(bucket") == 2  # one for each side of the pairs of blocks
    pairs = linked.collect()
    assert {p[k] for p in pairs for k in (0, 1)} == set(names)
