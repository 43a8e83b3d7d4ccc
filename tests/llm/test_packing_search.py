import bisect
import itertools
import random
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from millrace.llm import packing
from millrace.llm.tokens import encoder


def pieces(bins):
    return sum((Counter({n: k * c for n, k in Counter(p).items()}) for p, c in bins.items()), Counter())


def exchange(source, target, capacity=1000):
    table = packing._Underfull(capacity)
    table.add(target)
    return table.exchange(source, True)


def test_the_three_exchanges():
    assert exchange((300, 100), (600,)) == ((600,), (300,), 0)
    assert exchange((500,), (600, 200)) == ((600, 200), (500,), 200) or exchange((500,), (600, 200)) is None
    assert exchange((450, 20), (600, 380)) == ((600, 380), (20,), 0)
    assert exchange((10,) * 41, (979, 12)) == ((979, 12), (10, 10), 12)
    assert exchange((10, 10), (979, 12)) == ((979, 12), (10, 10), 12)
    assert exchange((10,), (979, 12)) is None
    assert exchange((250,), (600, 200)) == ((600, 200), (250,), 200)


def test_no_exchange_is_left(monkeypatch):
    draw = random.Random(3)
    counts = Counter(draw.randint(30, 700) for _ in range(400))
    found = packing.search(packing.loose_bins(counts, 1000), 1000)
    if sum(found.values()) > -(-sum(n * c for n, c in counts.items()) // 1000):
        table = packing._Underfull(1000)
        for kind in found:
            table.add(kind)
        assert all(table.exchange(kind, times == 1) is None for kind, times in found.items() if sum(kind) < 1000)


@pytest.mark.parametrize("seed", range(6))
def test_search_keeps_pieces_and_saves_bins(seed):
    draw = random.Random(seed)
    counts = Counter({draw.randint(1, 100): draw.randint(1, 30) for _ in range(draw.randint(1, 60))})
    first = packing.loose_bins(counts, 100)
    last = packing.search(first, 100)
    for bins in (first, last, packing.bins_of(counts, 100)):
        assert pieces(bins) == counts and all(sum(p) <= 100 for p in bins)
    squares = [sum(sum(p) ** 2 * c for p, c in bins.items()) for bins in (first, last)]
    assert sum(last.values()) <= sum(first.values()) and squares[0] <= squares[1]


def optimum(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[k] and rooms[j] not in rooms[:j]:
                place(k + 1, [*rooms[:j], rooms[j] - sizes[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_small_cases_against_the_optimum():
    over = []
    for seed in range(150):
        draw = random.Random(seed)
        sizes = sorted((draw.randint(1, 60) for _ in range(draw.randint(1, 9))), reverse=True)
        over.append(sum(packing.bins_of(Counter(sizes), 60).values()) - optimum(sizes, 60))
    assert min(over) == 0 and max(over) <= 1 and sum(over) <= 8


def test_exchanges_empty_bins_on_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    counts = Counter()
    for ids in encoder(public_tokenizers.path("word_bpe_49k.json")).ids(texts):
        n = len(ids) // 4 + 1
        counts.update([2048] * (n // 2048) + ([n % 2048] if n % 2048 else []))
    first, accepted, exchange = packing.loose_bins(counts, 2048), [], packing._Underfull.exchange
    try:
        packing._Underfull.exchange = lambda *a: (found := exchange(*a)) and (accepted.append(found) or found)
        last = packing.bins_of(counts, 2048)
    finally:
        packing._Underfull.exchange = exchange
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert len(accepted) > 100 and sum(last.values()) <= least + 1 < sum(first.values())
    assert {len(given) for _, given, _ in accepted} == {1, 2} and any(back for _, given, back in accepted if len(given) == 1)


def test_portions(monkeypatch):
    draw = random.Random(8)
    counts = Counter({draw.randint(1, 2048): draw.randint(1, 90_000) for _ in range(120)})
    monkeypatch.setattr(packing, "SEARCHED", 2_000)
    bins = packing.bins_of(counts, 2048)
    assert pieces(bins) == counts and all(sum(p) <= 2048 for p in bins)
    direct = packing.search(packing.loose_bins(counts, 2048), 2048)
    assert sum(bins.values()) <= 1.01 * sum(direct.values())


def best_fit_decreasing(sizes, capacity):
    rooms, bins = [], 0
    for n in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += room == capacity and at == len(rooms)
        bisect.insort(rooms, room - n)
    return bins


def families():
    draw = random.Random(4)
    few = [draw.randint(400, 1025) for _ in range(8)]
    return {
        "eight lengths": draw.choices(few, k=2000),
        "uniform": [draw.randint(1, 2048) for _ in range(2000)],
        "halves": [draw.randint(600, 1100) for _ in range(2000)],
        "thirds": [draw.randint(500, 800) for _ in range(2000)],
        "short": [draw.randint(1, 60) for _ in range(9000)],
        "documents": [min(2048, 1 + int(draw.expovariate(1 / 600))) for _ in range(3000)],
        "simple parts": draw.choices([683, 1024, 1025, 342], k=2000),
        "primes": draw.choices([701, 509, 307, 1201, 89], k=2500),
        "short and long": [draw.randint(1, 50) if draw.random() < 0.5 else draw.randint(900, 1100) for _ in range(2500)],
        "many": [min(2048, 1 + int(draw.expovariate(1 / 600))) for _ in range(40_000)],
        "one length": [700] * 1001,
        "none": [],
    }


@pytest.mark.parametrize("name", families())
def test_never_more_bins_than_best_fit_decreasing(name):
    sizes = families()[name]
    counts, plain = Counter(sizes), best_fit_decreasing(sizes, 2048)
    quick = packing.best_fit_bins(counts, 2048)
    assert pieces(quick) == counts and sum(quick.values()) == plain
    bins = packing.bins_of(counts, 2048)
    assert pieces(bins) == counts and all(sum(p) <= 2048 for p in bins) and sum(bins.values()) <= plain
