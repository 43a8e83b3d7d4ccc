"""Fetched profiles of people: one JSON object each, with fields under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.json_feeds import Pick, at


def _named(*names: str) -> Pick:
    """The first of the names that is there and isn't null."""
    return lambda v: F.coalesce(*[at(f"$.{n}")(v) for n in names])


def _list(whole: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(whole, path, "array<variant>"), F.array().cast("array<variant>"))


def profile(payloads: DataFrame, *kept: str) -> DataFrame:
    """name, headline, company, experience (with a title), skills (texts or objects) and posts (with a text) of profiles."""
    v = F.col("_v")
    job = lambda x: F.struct(_named("title", "role")(x).alias("title"), _named("company", "company_name")(x).alias("company"), _named("duration", "dates", "time_period")(x).alias("duration"))
    post = lambda x: F.struct(_named("text", "content", "summary")(x).alias("text"), _named("date", "posted_at", "created_at")(x).alias("date"), F.coalesce(at("$.reactions", "int")(x), F.lit(0)).alias("reactions"))
    # an object as a whole would read as its JSON text
    skill = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).otherwise(_named("name", "skill")(x))
    return payloads.select(*kept, F.try_parse_json("payload").alias("_v")).where("_v IS NOT NULL").select(
        *kept,
        _named("name", "full_name")(v).alias("name"),
        _named("headline", "title")(v).alias("headline"),
        _named("company", "current_company")(v).alias("company"),
        F.filter(F.transform(_list(v, "$.experience"), job), lambda x: x["title"].isNotNull()).alias("experience"),
        F.array_compact(F.transform(_list(v, "$.skills"), skill)).alias("skills"),
        F.filter(F.transform(_list(v, "$.posts"), post), lambda x: x["text"].isNotNull()).alias("posts"),
    )


def beside(payloads: DataFrame, *kept: str) -> DataFrame:
    """name, title and url of the people named beside a profile: `profiles`, the payload itself or `results`."""
    whole = F.try_parse_json("payload")
    people = F.coalesce(*[F.try_variant_get(whole, p, "array<variant>") for p in ("$.profiles", "$", "$.results")])
    rows = payloads.select(*kept, F.explode(people).alias("x"))
    made = rows.select(*kept, _named("name", "full_name")(F.col("x")).alias("name"), _named("title", "headline")(F.col("x")).alias("title"), _named("linkedin_url", "url", "profile_url")(F.col("x")).alias("url"))
    return made.where("name IS NOT NULL AND url IS NOT NULL")
