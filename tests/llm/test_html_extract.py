import html
import random
import re

import numpy as np
import pytest

from millrace.llm import boosting, html_extract, html_pages
from millrace.llm.html_tree import TEXT, parse

OUTSIDE = '<html><head><title>t</title><script>var a="</p><p>no";</script></head><body>'
PAGES = [
    (None, ""),
    ("", ""),
    (OUTSIDE + '<nav><ul><li><a href="/">Home</a></li></ul></nav><main><h1>Big &amp; small</h1><p>One\n two&nbsp;three<p>Four <b>five</b> &lt;six&gt;</main><footer>&copy; me</footer>', "Big & small\nOne two three\nFour five <six>"),
    (OUTSIDE + '<header class="site-header"><a href="/">Logo</a></header><div class="cookie-notice">We use cookies.</div><article><p>Text of the article, long enough to be one.</p><div class="ad">Buy now.</div><p>And its end.</p><section class="comments"><p>First! I like this text, and I say so at length.</p></section></article><aside>Related</aside><form><label>Mail</label><input></form></body>', "Text of the article, long enough to be one.\nAnd its end."),
    (OUTSIDE + "<article><p>" + "word " * 30_000 + "</p></article>", ("word " * 30_000).strip()),
]


def test_pages(spark):
    rows = [(k, "u", p, 7) for k, (p, _) in enumerate(PAGES)] + [(2, "u", PAGES[2][0], 7), (None, None, PAGES[2][0], 7)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = PAGES[2 if r["page_id"] is None else r["page_id"]][1]
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html_extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def article(page):
    """The article's text cut with regular expressions, which the tables' plain markup allows."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_table_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    assert all(r["text"] == article(raw[r["page_id"]]) for r in html_extract.extract(pages).collect())


@pytest.mark.parametrize(("names", "most"), [(True, 0.03), (False, 0.15)])
def test_drawn_pages_not_learned_from(names, most):
    """The share of characters on the wrong side, with names and with all classes, ids, roles and itemprops removed."""
    trees, wrong, all_ = html_extract.model(), 0, 0
    for seed in range(50_000, 50_200):
        nodes, label = html_pages.page(seed, names)
        kept = html_extract.decode(nodes, trees.log_odds(html_extract.features(nodes)).tolist())
        for n, a, b in zip(nodes, label, kept, strict=True):
            wrong, all_ = wrong + len(n.text) * (a != b), all_ + len(n.text)
    assert wrong / all_ < most


LONG = "A sentence of an article, with some words and then more of them, until it is as long as such sentences are. " * 4


@pytest.mark.parametrize(("body", "want"), [
    ("<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><header><h1>Head line</h1><p>By A. Writer</p></header><p>{0}</p><p>{0}</p></article><footer>(c) <a href=/>us</a></footer>", "Head line\nBy A. Writer\n{0}\n{0}"),
    ("<h1>Head line</h1><p>{0}</p><p>{0}</p>", "Head line\n{0}\n{0}"),
    ("<div><div><div><p>{0}</p><p>{0}</p></div></div></div>", "{0}\n{0}"),
    ('<article><h1>Head line</h1><div class="header-image"><img src=x><figcaption>Caption of a picture</figcaption></div><p>{0}</p></article>', "Head line\nCaption of a picture\n{0}"),
    ("<article><h1>Head line</h1><p>{0} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "Head line\n{0} x=2 holds."),
])
def test_structures_without_telling_names(body, want):
    found = html_extract.texts(["<html><body>" + body.format(LONG.strip()) + "</body></html>"], html_extract.model())
    assert found == [want.format(LONG.strip())]


@pytest.mark.parametrize("seed", range(5))
def test_decoding_is_the_best_consistent_choice(seed):
    draw = random.Random(seed)
    nodes = parse("".join(draw.choice(["<div>", "<p>", "</div>", "x", "<b>y</b>"]) for _ in range(14))).nodes[:10]
    odds = [draw.gauss(0, 2) for _ in nodes]
    kept = html_extract.decode(nodes, odds)
    allowed = lambda c: all(not c[k] or n.parent < 0 or c[n.parent] for k, n in enumerate(nodes))
    value = lambda c: sum(o for o, k in zip(odds, c) if k)
    choices = ([bool(m >> k & 1) for k in range(len(nodes))] for m in range(2 ** len(nodes)))
    assert allowed(kept) and abs(value(kept) - max(value(c) for c in choices if allowed(c))) < 1e-9


def test_boosting_learns_an_exclusive_or():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x[:1500], y[:1500], trees=30, depth=3)
    assert np.mean((trees.log_odds(x[1500:]) > 0) == y[1500:]) > 0.95
