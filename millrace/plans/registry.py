"""All registered queries of the library, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import decisions, feeds, gates, intake, lookups, matching, more, nested_pages, network, people, reports, scalars, screens

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return scalars.QUERIES | decisions.QUERIES | reports.QUERIES | feeds.QUERIES | intake.QUERIES | network.QUERIES | more.QUERIES | screens.QUERIES | people.QUERIES | gates.QUERIES | lookups.QUERIES | matching.QUERIES | nested_pages.QUERIES


def oracle_sql() -> dict[str, str]:
    return scalars.SQL | decisions.SQL | reports.sql() | feeds.SQL | intake.SQL | network.SQL | more.SQL | screens.SQL | people.SQL | gates.SQL | lookups.SQL | matching.SQL | nested_pages.SQL
