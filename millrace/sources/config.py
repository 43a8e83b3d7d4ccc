"""Configured sources: which feed is read by which parser, for which keywords."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.json_feeds import FEEDS, RAW_JOB, parse


@dataclass(frozen=True)
class Source:
    name: str
    strategy: str
    url: str | None = None
    keywords: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


def load(text: str, known: frozenset[str] = frozenset(FEEDS)) -> list[Source]:
    """The enabled sources of a YAML list whose strategy is known; of sources of the same name the last counts. Keywords
    may be a list or a line with commas."""
    found: dict[str, Source] = {}
    for entry in (yaml.safe_load(text) or {}).get("sources") or []:
        if entry.get("enabled", True) and str(entry.get("strategy", "")).upper() in known:
            words = entry.get("keywords") or ()
            words = tuple(w.strip() for w in (words.split(",") if isinstance(words, str) else words) if w.strip())
            found[entry["name"]] = Source(entry["name"], entry["strategy"].upper(), entry.get("url"), words, {k: str(v) for k, v in (entry.get("config") or {}).items()})
    return list(found.values())


def read_all(spark: SparkSession, sources: list[Source], payloads: Callable[[Source], DataFrame]) -> DataFrame:
    """The raw postings of all sources, with the source's name; payloads gives what was fetched for a source."""
    frames = [parse(payloads(s), s.strategy).select(F.lit(s.name).alias("source"), *RAW_JOB) for s in sources]
    if not frames:
        return spark.createDataFrame([], "source string, external_id string, title string, company_name string, location string, description string, apply_url string, posted_date date, salary_min decimal(12,2), salary_max decimal(12,2), salary_currency string, raw_json string")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
