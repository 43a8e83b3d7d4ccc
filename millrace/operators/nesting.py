"""Rows with their parts as arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Heaps in which the parts of one row gather before they are put together.
HEAPS = 16


def nested(rows: DataFrame, parts: DataFrame, key: str, fields: list[str | Column], order: list[str], name: str) -> DataFrame:
    """rows with an array of the parts' fields in a total order; empty where a row has no parts. The parts of a key gather and
    are sorted in HEAPS heaps first, so that a key with very many of them is sorted in several tasks; the row itself holds them
    all. Parts without a key belong to no row."""
    part = F.struct(F.struct(*order).alias("_at"), F.struct(*fields).alias("_part"))
    heaps = parts.where(F.col(key).isNotNull()).groupBy(key, F.pmod(F.xxhash64(*order), F.lit(HEAPS)).alias("_heap")).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    whole = heaps.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("_parts"))).alias("_parts"))
    values = whole.select(key, F.transform("_parts", lambda p: p["_part"]).alias(name))
    out = rows.join(values, key, "left")
    kind = out.schema[name].dataType.simpleString()
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def company_details(companies: DataFrame, endpoints: DataFrame, jobs: DataFrame) -> DataFrame:
    """companies with endpoints (endpoint_id, is_active, last_crawled_at) in order of their ids and the number of their active
    jobs, both empty where there are none."""
    active = jobs.where("is_active").groupBy("company_id").agg(F.count("*").alias("active_jobs"))
    whole = nested(companies, endpoints, "company_id", ["endpoint_id", "is_active", "last_crawled_at"], ["endpoint_id"], "endpoints")
    return whole.join(active, "company_id", "left").withColumn("active_jobs", F.coalesce("active_jobs", F.lit(0).cast("long")))


def company_summaries(companies: DataFrame, endpoints: DataFrame) -> DataFrame:
    """companies with the number of their endpoints."""
    counts = endpoints.groupBy("company_id").agg(F.count("*").alias("endpoint_count"))
    return companies.join(counts, "company_id", "left").withColumn("endpoint_count", F.coalesce("endpoint_count", F.lit(0).cast("long")))


def application_details(applications: DataFrame, jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """applications with their job's title and company and their outcomes (stage, occurred_at, notes) in order of day and
    stage."""
    named = applications.join(jobs.select(F.col("id").alias("job_id"), "title", F.col("company").alias("company_name")), "job_id", "left")
    return nested(named, outcomes, "application_id", ["stage", "occurred_at", "notes"], ["occurred_at", "stage", "notes"], "outcomes")
