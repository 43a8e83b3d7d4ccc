"""Personal data in whole texts: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) stay whatever their score; the further kinds (iban, ssn, local) need LEAST_SCORE and must
not overlap a base span. Matches of a base kind are leftmost and don't overlap; one that fails its test is dropped without a
second try inside it. Spans of different kinds may overlap. Starts and ends count code points.

Null and empty texts have no spans. A very long text is searched whole, in time that grows with its length: every pattern
either begins where a run begins, or is possessive. Repeated rows give repeated rows and ties don't arise: a kind has at most
one span at a start. Extra columns stay; one that has the name of a result, in any case of letters, is replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bpe import slices
from millrace.session import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local")
#: What a span of a further kind needs, and how many code points before and after a span count as near.
LEAST_SCORE, NEAR = 0.5, 48
#: Scores before the context: what the pattern and its test say by themselves.
_START = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "local": 0.3}
#: Words that raise a kind's score, then words that lower any kind's.
_RAISE = {
    "email": "email mail e-mail contact write correo courriel",
    "ip": "ip address host server login adresse dirección",
    "card": "card credit visa mastercard amex payment karte kreditkarte tarjeta carte",
    "phone": "phone tel telephone call mobile cell fax telefon handy teléfono móvil téléphone",
    "iban": "iban account bank transfer konto cuenta compte",
    "ssn": "ssn social security taxpayer",
    "local": "phone tel telephone call mobile cell fax telefon handy teléfono móvil téléphone",
}
_LOWER = frozenset("version release isbn issn order sku serial example sample placeholder dummy".split())
_RAISING = {k: frozenset(v.split()) for k, v in _RAISE.items()}
_UP, _DOWN = 0.3, 0.25

_LOCAL_PART = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_NOT_DIGITS = {c: None for c in map(ord, " ().-+")}
#: Lengths of international bank account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}
SPAN = T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False)])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before it."""
    doubled = sum(int(d) if k % 2 == 0 else (2 * int(d) - 1) % 9 + 1 if d != "0" else 0 for k, d in enumerate(reversed(digits)))
    return doubled % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an international bank account number without spaces has its country's length and the right check digits."""
    return len(iban) == IBAN_LENGTHS.get(iban[:2]) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Before each @ the longest run of local characters that the last match and the @ before leave, behind it a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        part = text[free:at]
        start = free + len(part.rstrip(_LOCAL_PART))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].translate(_NOT_DIGITS)
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(m[0].translate(_NOT_DIGITS)) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The country says how many characters belong to the number, so that capitals after it don't spoil it."""
    for m in _IBAN.finditer(text):
        left, end = IBAN_LENGTHS.get(m[1], 99), m.start()
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        if not left and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": lambda t: (m.span() for m in _SSN.finditer(t)), "local": lambda t: (m.span() for m in _LOCAL.finditer(t))}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, higher if a word near the span speaks for the kind, lower if one speaks against any."""
    words = {w.lower() for side in (text[max(0, start - NEAR) : start], text[end : end + NEAR]) for w in _WORD.findall(side)}
    value = _START[kind] + _UP * bool(words & _RAISING[kind]) - _DOWN * bool(words & _LOWER)
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[Span]:
    """All spans of a text, by start, then by kind as listed in KINDS."""
    spans = [Span(kind, a, b, score(text, kind, a, b)) for kind in BASE for a, b in _FINDERS[kind](text)]
    taken = sorted((s.start, s.end) for s in spans)
    for kind in KINDS[len(BASE) :]:
        further = [Span(kind, a, b, score(text, kind, a, b)) for a, b in _FINDERS[kind](text)]
        spans += _clear([s for s in further if s.score >= LEAST_SCORE], taken)
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def _clear(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """The spans that overlap none of the taken ones; both are in order of their starts."""
    out, k, reach = [], 0, 0
    for s in spans:
        while k < len(taken) and taken[k][0] < s.end:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s.start:
            out.append(s)
    return out


def annotate(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """docs with their spans as an array of (kind, start, end, score). The text column doesn't go on."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), spans.lower())]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(spans, T.ArrayType(SPAN, False), False)])

    def run(batches):
        for batch in batches:
            column = batch.column(len(kept))
            for a, b, texts in slices(column):
                found = pa.array([[s._asdict() for s in find(t)] for t in texts], _ARROW)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(kept))), found], names=[*kept, spans])

    return docs.select(*kept, text).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", least: float = 0.0) -> DataFrame:
    """docs with every span of at least that score replaced by its kind in angle brackets; of spans that overlap, the whole
    stretch by the kind of the first. Null stays null."""
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            for a, b, texts in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                clean = pa.array([None if null else _redacted(t, least) for t, null in zip(texts, part.column(at).is_null().to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([clean if k == at else part.column(k) for k in range(part.num_columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def _redacted(text: str, least: float) -> str:
    out, done, hidden = [], 0, 0
    for s in find(text):
        if s.score >= least:
            if s.start >= hidden:
                out += [text[done : s.start], f"<{s.kind}>"]
            hidden = done = max(hidden, s.end)
    return "".join([*out, text[done:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Of doc_id and spans: how many of each base kind, a digest of the base spans, all spans in writing, and their scores."""
    spans = F.col("spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    scores = F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *counts[: len(BASE)], F.sha2(_joined(of(*BASE)), 256).alias("base_sha256"), _joined(spans).alias("spans"), scores, *counts[len(BASE) :])
