"""Synthetic pages with known main text, from which the node classifier learns. They are drawn, not taken from any site.

A page draws how it names its parts: by telling elements and attributes, by none at all (unnamed div, section or table cells,
or the bare body), or by names that mislead. What is main text is written into the page as an attribute data-part when
it is drawn, which the classifier never sees, so that no label follows from a name.
"""

from __future__ import annotations

import random
import re

from millrace.llm.html_tree import Node, parse

_MAIN = ['article', 'main', 'div class="content"', 'div class="post-body"', 'div id="main-content"', 'div class="entry-content"', 'section class="story"', 'div itemprop="articleBody"', 'div role="main"']
_AWAY = {
    "menu": ['nav', 'div class="menu"', 'ul class="nav"', 'div role="navigation"', 'div class="breadcrumbs"', 'div id="navbar"'],
    "header": ['header', 'div id="header"', 'div class="masthead"'],
    "footer": ['footer', 'div class="footer"', 'div id="site-footer"', 'div class="copyright"'],
    "side": ['aside', 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"'],
    "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div role="alert"', 'div class="popup"'],
    "advert": ['div class="ad"', 'div class="advert"', 'div id="banner"', 'div class="sponsored"', 'section class="promo"', 'p class="ad"', 'ins class="ads"'],
    "form": ['form', 'div class="newsletter"', 'div class="search"', 'form class="login"'],
    "comments": ['section id="comments"', 'div class="comments"', 'div class="comment"', 'ol class="comment-list"', 'div id="respond"'],
    "share": ['div class="share"', 'ul class="social"', 'div class="pagination"'],
}
_NOISE = ["", "", "", ' class="a1"', ' id="x7"', ' class="row"', ' class="wrap"', ' style="margin:0"', ' data-k="ad"']
_UNNAMED = ["div", "div", "section", "td", "center"]
#: Parts of the article whose names sound like something else.
_INSIDE = ['div class="header-image"', 'figure class="banner-image"', 'div class="side-figure"', 'div id="alert-picture"', 'figure class="widget-image"']


class _Page:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)
        self.out: list[str] = []
        self.naming = self.draw.choices(["named", "unnamed", "misleading"], [0.6, 0.3, 0.1])[0]

    def words(self, low: int, high: int) -> str:
        n = self.draw.randint(low, high)
        words = ["".join(self.draw.choice("aeiounrstldm") for _ in range(self.draw.randint(1, 9))) for _ in range(n)]
        return " ".join(w + self.draw.choice(["", "", "", "", ",", ".", "&amp;"]) for w in words)

    def put(self, tag: str, body, closed: float = 1.0, part: str = "") -> None:
        name, noise = tag.split()[0], self.draw.choice(_NOISE) if " " not in tag and self.naming != "unnamed" else ""
        mark = f' data-part="{part}"' if part else ""
        self.out.append(f"<{tag}{noise}{mark}>")
        body() if callable(body) else self.out.append(body)
        if self.draw.random() < closed:
            self.out.append(f"</{name}>")

    def links(self, item: str = "li") -> None:
        for _ in range(self.draw.randint(2, 8)):
            self.put(item, lambda: self.put('a href="/x"', self.words(1, 3)))

    def paragraph(self) -> None:
        kind = self.draw.random()
        text = self.words(1, self.draw.choice([5, 30, 120]))
        if kind < 0.55:
            self.put("p", (f"<b>{text}<br>" if self.draw.random() < 0.15 else text), 0.8)
        elif kind < 0.65:
            self.put("p", f'{self.words(1, 9)} <a href="/y">{self.words(1, 4)}</a> <em>{self.words(1, 3)}</em> {text}')
        elif kind < 0.72:
            self.put(self.draw.choice(["ul", "ol"]), lambda: [self.put("li", self.words(1, 20)) for _ in range(self.draw.randint(1, 5))])
        elif kind < 0.79:
            self.put(self.draw.choice(["blockquote", "pre", "div", "section"]), text)
        elif kind < 0.84:
            self.put("figure", lambda: self.put("figcaption", self.words(2, 12)))
        elif kind < 0.92:
            self.put(self.draw.choice(["h2", "h3"]), self.words(1, 6))
        elif kind < 0.94:
            self.put("p", lambda: self.out.append(f"{self.words(2, 9)} <math><mi>{self.words(1, 1)}</mi><mo>=</mo><mn>2</mn></math> {text}"))
        elif kind < 0.96:
            self.put(self.draw.choice(["object", "noscript", "canvas", "details"]), lambda: self.put("p", text))
        else:
            self.put("table", lambda: self.put("tr", lambda: [self.put("td", self.words(1, 5)) for _ in range(3)]))

    def away(self, kind: str) -> None:
        unnamed = self.naming == "unnamed" and kind != "comments" and self.draw.random() < 0.8
        tag = self.draw.choice(["div", "div", "section", "td"]) if unnamed else self.draw.choice(_AWAY[kind])
        if self.naming == "misleading" and " " not in tag:
            tag += self.draw.choice([' class="content"', ' class="main-nav"', ' id="story-links"', ""])

        def body() -> None:
            if kind in ("menu", "share") or self.draw.random() < 0.1:
                if tag.startswith(("ul", "ol")):
                    self.links()
                elif self.draw.random() < 0.3:
                    self.links("span")
                else:
                    self.put("ul", self.links)
            elif kind == "form":
                self.out.append(f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button>")
                if self.draw.random() < 0.3:
                    self.put("select", lambda: [self.put("option", self.words(1, 2)) for _ in range(3)])
            elif kind == "comments":
                for _ in range(self.draw.randint(1, 5)):
                    self.put(self.draw.choice(["div", "li", "article"]), lambda: self.put("p", self.words(1, 60)))
            elif kind in ("side", "footer", "header") and (unnamed or self.draw.random() < 0.3):
                self.put(self.draw.choice(["p", "h4", "span", "strong"]), self.words(1, 5))
                self.links(self.draw.choice(["li", "p", "span", "div"]))
            elif unnamed or self.draw.random() < 0.5:
                self.out.append(self.words(1, 9 if unnamed else 25))
                self.put('a href="/z"', self.words(1, 3)) if unnamed else None
            else:
                self.put(self.draw.choice(["p", "div", "h4", "span", "noscript", "svg"]), self.words(1, 40))

        self.put(tag, body, part="away")

    def some(self, kinds: str, most: int) -> None:
        for kind in self.draw.sample(kinds.split(), self.draw.randint(0, most)):
            self.away(kind)

    def main(self) -> None:
        opening = self.draw.random()
        if opening < 0.25:
            self.put(self.draw.choice(["header", "header", "hgroup", "div"]), lambda: [self.put("h1", self.words(1, 9)), self.put(self.draw.choice(["p", "div", "time", "span"]), self.words(1, 7))], part="main")
        elif opening < 0.85:
            self.put("h1", self.words(1, 9), part="main")
        for _ in range(self.draw.choice([1, 2, 3, 5, 12])):
            if self.draw.random() < 0.05:
                self.put(self.draw.choice(_INSIDE), lambda: [self.put("img src=x", "", 0.0), self.put("figcaption", self.words(2, 25))], part="main")
            self.paragraph()
            if self.draw.random() < 0.15:
                self.some("advert share side form notice", 1)
        if self.naming == "unnamed" or self.draw.random() < 0.6:  # most articles have a text of some length
            for _ in range(self.draw.randint(1, 3)):
                self.put("p" if self.draw.random() < 0.9 else "div", self.words(25, 120))
        if self.draw.random() < 0.3:
            self.some("comments comments share side", 1)

    def html(self) -> str:
        self.out.append("<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head>")
        bare = self.draw.random() < 0.15
        self.out.append('<body data-part="main">' if bare else "<body>")
        wraps = self.draw.randint(0, 2)
        self.out += ['<div class="wrap">' if self.naming == "named" else "<div>"] * wraps
        self.some("menu header notice advert form", 4)
        if bare:
            self.main()
        elif self.naming == "named":
            self.put(self.draw.choice(_MAIN), self.main, part="main")
        else:
            depth = self.draw.randint(1, 3)
            tags = [self.draw.choice(_UNNAMED) for _ in range(depth)]
            if self.naming == "misleading":
                tags[-1] = self.draw.choice(['div class="widget-text"', 'div id="banner-story"', 'div class="side-main"', 'section class="top"', "article"])
            self.out += [f'<{t} data-part="main">' for t in tags]
            self.main()
            self.out += [f"</{t.split()[0]}>" for t in reversed(tags)]
        self.some("side advert comments share footer form notice menu", 5)
        self.out += ["</div>"] * wraps + ["</body></html>"]
        return "".join(self.out)


def html(seed: int, names: bool = True) -> str:
    """A drawn page; without names, none of its elements has a class, id, role or itemprop."""
    page = _Page(seed).html()
    return page if names else re.sub(r' (?:class|id|role|itemprop)="[^"]*"', "", page)


def page(seed: int, names: bool = True) -> tuple[list[Node], list[int]]:
    """The nodes of one page, and for each 1 if it is, holds or belongs to main text."""
    nodes = parse(html(seed, names)).nodes
    inside, label = [False] * len(nodes), [0] * len(nodes)
    for k, n in enumerate(nodes):
        inside[k] = 'data-part="main"' in n.written or ('data-part="away"' not in n.written and n.parent >= 0 and inside[n.parent])
        label[k] = int(inside[k])
        if inside[k]:
            p = n.parent
            while p >= 0 and not label[p]:
                label[p], p = 1, nodes[p].parent
    return nodes, label
