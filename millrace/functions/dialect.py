"""Regular expressions with ASCII word boundaries on the JVM, whose own \\b knows all letters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where an ASCII word character begins or ends.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_WORD = "[A-Za-z0-9_]"


def jvm(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Spark: every \\b is an ASCII boundary. Beside a literal word character it is a single look-around."""
    parts = pattern.split(r"\b")
    out = parts[0]
    for before, after in zip(parts, parts[1:], strict=False):
        literal_before = re.search(rf"(?<!\\){_WORD}$", before)
        out += f"(?<!{_WORD})" if re.match(_WORD, after) else f"(?!{_WORD})" if literal_before else BOUNDARY
        out += after
    return ("(?i)" if ignore_case else "") + out


def literal_of(pattern: str) -> str | None:
    """The lower-cased text that every match of a simple pattern holds: letters, digits and spaces, with \\b at the ends."""
    found = re.fullmatch(r"(?:\\b)?([A-Za-z0-9 ]+)(?:\\b)?", pattern)
    return found and found[1].lower()


def any_in_lowered(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether any pattern, whatever the case, fits a text that is lower-cased already. Patterns of literals only run where
    the literal stands."""
    out = F.lit(False)
    for p in patterns:
        lower = not re.search("[A-Z]", re.sub(r"\\.", "", p))
        literal = literal_of(p)
        if literal is None:
            out = out | text.rlike(jvm(p, not lower))
            continue
        # the literal first, which the matcher can look for, then what stands beside it
        begins, ends = f"(?<!{_WORD}{literal})" if p.startswith(r"\b") else "", f"(?!{_WORD})" if p.endswith(r"\b") else ""
        out = out | (text.contains(literal) & text.rlike(literal + begins + ends) if begins or ends else text.contains(literal))
    return out


def any_of(patterns: tuple[str, ...] | list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(patterns: tuple[str, ...] | list[str] | str, ignore_case: bool = True) -> str:
    """The same patterns as a SQL literal for an engine whose \\b is ASCII."""
    return sql_literal(("(?i)" if ignore_case else "") + (patterns if isinstance(patterns, str) else any_of(patterns)))
