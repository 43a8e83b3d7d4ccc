"""The main text of web pages: boosted trees score the nodes of a page, and a decoding over the tree chooses among them.

Null or empty html, and pages without main text, give an empty text. A very long page is parsed whole, by itself. Markup that never ends counts up to the page's end.
Repeated rows stay repeated. Extra columns stay; columns called text or n_chars are replaced. An empty table gives an
empty result. A line break ends a block, as block elements do.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm import boosting
from millrace.llm.html_tree import TEXT, Node, Page, parse
from millrace.llm.text import chunks
from millrace.session import ship

#: Bytes of html whose nodes are held at once; a longer page is a round of its own.
ROUND = 1 << 20
#: Drawn pages that the trees learn from; trees, and questions on the way through one.
PAGES, TREES, DEPTH = 700, 60, 5
#: Attribute tokens of parts that aren't main text, and of main text.
AWAY = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal alert newsletter subscribe signup login search comment comments reply respond disqus sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended toolbar pagination pager copyright legal".split())
MAIN = frozenset("article articlebody body content entry main post story text".split())
AWAY_TAGS, MAIN_TAGS = frozenset("nav footer aside form header dialog button label".split()), frozenset(["article", "main"])
HEADINGS, FLOWING = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p li blockquote pre td dd em b i strong span".split())
CONTROLS = frozenset("form input button label select textarea option".split())
_KINDS = [{TEXT}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "input", "button", "label", "select", "textarea"}, MAIN_TAGS, {"section"}, {"div"}, {"p"}, {"h1"}, {"h2", "h3"}, {"h4", "h5", "h6"}, {"ul", "ol", "li", "dl", "dd", "dt"}, {"table", "tbody", "thead", "tr", "td", "th"}, {"a"}, {"html", "body"}, {"blockquote", "pre", "code"}, {"figure", "figcaption", "img"}, {"ins", "iframe"}]
_KIND = {t: k for k, tags in enumerate(_KINDS) for t in tags}
#: Features of a node: its kind, its parent's, and OTHERS more.
OTHERS = 30
WIDTH = 2 * len(_KINDS) + OTHERS


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node: kinds, attribute tokens of its own and above, depth, and of its subtree, its siblings and its
    parent how much text they have, how much of it is linked, how dense it is, how long its runs are, and where it stands."""
    n = len(nodes)
    own, links, tags, stops = [0] * n, [0] * n, [1] * n, [0] * n
    longest, runs, anchors, controls, flowing, heads = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    children: list[list[int]] = [[] for _ in nodes]
    sign, near, away, main, before = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    seen = 0
    for k, node in enumerate(nodes):
        p = node.parent
        a, m = len(node.marks & AWAY) + (node.tag in AWAY_TAGS), len(node.marks & MAIN) + (node.tag in MAIN_TAGS)
        away[k], main[k] = a + (away[p] if p >= 0 else 0), m + (main[p] if p >= 0 else 0)
        sign[k], near[k] = ((-1 if a >= m else 1), 0) if a or m else (sign[p], near[p] + 1) if p >= 0 else (0, 0)
        before[k] = seen
        if p >= 0:
            children[p].append(k)
        if node.tag == TEXT:
            own[k] = longest[k] = len(node.text)
            runs[k] = 1
            stops[k] = node.text.count(".") + node.text.count(",")
            seen += own[k]
            flowing[k] = own[k] if p >= 0 and nodes[p].tag in FLOWING else 0
        anchors[k], controls[k], heads[k] = node.tag == "a", node.tag in CONTROLS, node.tag in HEADINGS
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        if node.tag == "a":
            links[k] = own[k]
        if node.parent >= 0:
            p = node.parent
            for part in (own, links, tags, stops, runs, anchors, controls, flowing, heads):
                part[p] += part[k]
            longest[p] = max(longest[p], longest[k])
    whole = sum(own[k] for k in range(n) if nodes[k].parent < 0) or 1
    most = max(longest, default=0) or 1
    x = np.zeros((n, WIDTH), np.float32)
    place = [0] * n
    for group in children:
        for j, k in enumerate(group):
            place[k] = j
    rows = []
    for k, node in enumerate(nodes):
        p = node.parent
        if node.tag in _KIND:
            x[k, _KIND[node.tag]] = 1
        if p >= 0 and nodes[p].tag in _KIND:
            x[k, len(_KINDS) + _KIND[nodes[p].tag]] = 1
        a, m = len(node.marks & AWAY) + (node.tag in AWAY_TAGS), len(node.marks & MAIN) + (node.tag in MAIN_TAGS)
        size, siblings = own[k], len(children[p]) if p >= 0 else 1
        beside = (own[p] - size) / max(1, siblings - 1) if p >= 0 else 0
        rows.append((
            node.depth, a, m, sign[k], near[k], away[k] - a, main[k] - m, math.log1p(size), size / whole, links[k] / max(1, size), tags[k] / (size + 1), len(children[k]), place[k] / max(1, siblings - 1), siblings, math.log1p(beside),
            stops[k] / (size + 1), links[p] / max(1, own[p]) if p >= 0 else 0, own[p] / whole if p >= 0 else 1, sign[p] if p >= 0 else 0, tags[k],
            math.log1p(longest[k]), longest[k] / most, size / max(1, runs[k]), anchors[k], controls[k], flowing[k] / max(1, size), heads[k], (before[k] + size / 2) / whole,
            *(math.log1p(longest[children[p][j]]) if p >= 0 and 0 <= j < siblings else 0.0 for j in (place[k] - 1, place[k] + 1)),
        ))
    if rows:
        x[:, 2 * len(_KINDS) :] = rows
    return x


@functools.cache
def model() -> boosting.Trees:
    """The trees, learned from the drawn pages; the same on every call."""
    from millrace.llm.html_pages import page

    drawn = [page(seed) for seed in range(PAGES)]
    return boosting.fit(np.concatenate([features(nodes) for nodes, _ in drawn]), np.concatenate([np.array(y, np.float64) for _, y in drawn]), TREES, DEPTH, share=0.4)


def decode(nodes: list[Node], odds: list[float]) -> list[bool]:
    """The likeliest choice of nodes in which every chosen node's parent is chosen too: a dropped node takes all of its
    descendants with it, and main text brings its ancestors along."""
    n = len(nodes)
    gain, drop = [0.0] * n, [0.0] * n  # log P(kept or not, as best) - log P(all dropped) of the subtree
    for k in range(n - 1, -1, -1):
        gain[k] = max(0.0, odds[k] + drop[k])
        if nodes[k].parent >= 0:
            drop[nodes[k].parent] += gain[k]
    kept = [False] * n
    for k in range(n):
        p = nodes[k].parent
        kept[k] = gain[k] > 0 and (p < 0 or kept[p])
    return kept


def main_text(page: Page, kept: list[bool]) -> str:
    blocks: list[str] = []
    now: list[str] = []
    for k in [*page.flow, -1]:
        if k >= 0:
            if kept[k]:
                now.append(page.nodes[k].text)
        elif now:
            if block := " ".join("".join(now).split()):
                blocks.append(block)
            now = []
    return "\n".join(blocks)


def texts(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    parsed = [parse(p) for p in pages]
    odds = trees.log_odds(np.concatenate([features(p.nodes) for p in parsed])).tolist() if parsed else []
    out, at = [], 0
    for p in parsed:
        out.append(main_text(p, decode(p.nodes, odds[at : at + len(p.nodes)])))
        at += len(p.nodes)
    return out


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars; the html column is left out."""
    spark = pages.sparkSession
    ship(spark)
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    shared = spark.sparkContext.broadcast(model())

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(html)), 0).to_numpy()
            for at, to in chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), ROUND):
                part = batch.slice(at, to - at)
                found = texts(part.column(html).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*kept, "text", "n_chars"])

    schema = pages.select(*kept).schema.add("text", "string", False).add("n_chars", "long", False)
    return pages.select(*kept, html).mapInArrow(run, schema)
