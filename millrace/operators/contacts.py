"""Contacts with their relationships and jobs, discovery of companies, and what expires or has to be scored again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Orders of the contact list by name, each before the id; unknown names sort by priority.
CONTACT_ORDERS = {"priority": F.desc_nulls_last, "warmth": F.desc_nulls_last, "name": F.asc_nulls_last, "created_at": F.desc_nulls_last}


def contact_order(sort: str) -> list[Column]:
    name = sort if sort in CONTACT_ORDERS else "priority"
    return [CONTACT_ORDERS[name](name), F.asc("contact_id")]


def with_relationships(contacts: DataFrame, companies: DataFrame, relationships: DataFrame) -> DataFrame:
    """contacts (contact_id, company_id, ...) with company_name, and status and last_contact_at of their relationship, where
    they have any. Missing warmth and priority show as 0."""
    shown = contacts.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("warmth", "priority")})
    named = shown.join(companies.select("company_id", F.col("name").alias("company_name")), "company_id", "left")
    return named.join(relationships.select("contact_id", "status", "last_contact_at"), "contact_id", "left")


def linked_jobs(bridge: DataFrame, contacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each link (job_id, contact_id), once, the columns of its contact and its job."""
    return bridge.select("job_id", "contact_id").distinct().join(contacts, "contact_id").join(jobs, "job_id")


def without_endpoints(companies: DataFrame, endpoints: DataFrame, active_only: bool = False) -> DataFrame:
    """Companies that have no endpoint, or no active one."""
    held = endpoints.where("is_active") if active_only else endpoints
    return companies.join(held.select("company_id"), "company_id", "left_anti")


def crawl_order() -> list[Column]:
    """Never crawled ones first, then the longest ago, then the id."""
    return [F.asc_nulls_first("last_crawled_at"), F.asc("endpoint_id")]


def searches(sources: DataFrame) -> DataFrame:
    """All pairs of a source's keywords and locations (arrays of a configuration), in order."""
    each = sources.select("source", "locations", F.posexplode("keywords").alias("k", "keyword"))
    return each.select("source", "keyword", "k", F.posexplode("locations").alias("l", "location"))


def all_keywords(sources: DataFrame) -> DataFrame:
    """The distinct keywords of enabled sources, in the order of their first mention (rank, then place there)."""
    said = sources.where("enabled").select("rank", F.posexplode("keywords").alias("place", "keyword"))
    return said.groupBy("keyword").agg(F.min(F.struct("rank", "place")).alias("first"))


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    """Cached rows that hold beyond now; those without an end don't."""
    return rows.where(F.col("expires_at") > now)


def forget_recruiters(jobs: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Names and addresses of recruiters go from postings found more than so many days ago."""
    old = F.coalesce(F.col("discovered_date") < F.date_sub(as_of, days), F.lit(False))
    return jobs.withColumns({c: F.when(~old, F.col(c)) for c in ("recruiter_name", "recruiter_email")})


def still_valid_scores(scores: DataFrame, jobs: DataFrame, described: DataFrame) -> DataFrame:
    """Scores (id, score, matched) that stay when descriptions come later: not of the postings that were described just now,
    and not those of 0 without any matched skill whose active, kept posting has a description by now. The postings left
    without one are to be scored again."""
    kept = scores.join(described.select("id"), "id", "left_anti")
    empty = kept.where((F.col("score") == 0) & (F.size("matched") == 0)).select("id")
    stale = jobs.where("is_active AND decision = 'KEEP' AND description IS NOT NULL").select("id").join(empty, "id")
    return kept.join(stale, "id", "left_anti")


def unscored(jobs: DataFrame, scores: DataFrame) -> DataFrame:
    return jobs.where("decision = 'KEEP'").join(scores.select("id"), "id", "left_anti")
