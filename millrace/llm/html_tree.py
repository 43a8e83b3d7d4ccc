"""A page as a flat list of nodes in page order: its elements and its runs of text."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text where they begin and where they end.
BLOCKS = frozenset("address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe input label legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul video audio".split())
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("head script style template title".split())
#: An element that begins closes an open one of these, up to the nearest of the elements named last.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_CLOSERS = BLOCKS - {"br", "body", "html", "button", "label", "input", "option", "select", "textarea", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "iframe", "object", "noscript", "video", "audio"}
_P_SCOPE = frozenset("table td th button object caption html body".split())
TEXT = "#text"


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    #: Tokens of class, id, role and itemprop; the attributes as written, for the drawn pages.
    marks: frozenset[str] = frozenset()
    written: str = ""
    text: str = ""


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    #: In page order: the number of a run of text, or -1 where a block begins or ends.
    flow: list[int] = field(default_factory=list)


def _tokens(value: str) -> list[str]:
    spaced = "".join(" " + c if c.isupper() else c if c.isalnum() else " " for c in value)
    return [t.lower() for t in (spaced.split() if not value.isupper() else value.split())]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.silent = Page(), [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _P_CLOSERS:
            self._close({"p"}, _P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS:
            self.page.flow.append(-1)
        if tag == "body":  # what an unclosed head holds stays silent, the body doesn't
            self._close({"head"}, frozenset())
        marks = frozenset(t for k, v in attrs for t in (_tokens(v or "") if k in ("class", "id", "role", "itemprop") else ()))
        written = " ".join(f'{k}="{v}"' for k, v in attrs)
        self.page.nodes.append(Node(tag, self.open[-1] if self.open else -1, len(self.open), marks, written))
        if tag not in VOID:
            self.open.append(len(self.page.nodes) - 1)
            self.silent += tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.page.flow.append(-1)
        self._close({tag}, frozenset() if tag not in ("li", "p") else frozenset({"ul", "ol", "table", "article", "body"}))

    def _close(self, tags: set[str], scope: frozenset[str]) -> None:
        """Closes the nearest open element of these tags, and what stands in it, unless one of scope is nearer."""
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.page.nodes[self.open[at]].tag
            if tag in tags:
                self.silent -= sum(self.page.nodes[k].tag in SILENT for k in self.open[at:])
                if tag in BLOCKS:
                    self.page.flow.append(-1)
                del self.open[at:]
                return
            if tag in scope:
                return

    def handle_data(self, data: str) -> None:
        if self.silent or not data:
            return
        self.page.flow.append(len(self.page.nodes))
        self.page.nodes.append(Node(TEXT, self.open[-1] if self.open else -1, len(self.open), text=data))


def parse(html: str | None) -> Page:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.page
