"""Funnels, effectiveness, gaps and velocity. Rates are 0 where nothing is counted, and have three decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import half_up, is_blank, trim_control


def rate(part: Column, whole: Column, digits: int = 3) -> Column:
    return F.when(whole > 0, half_up(part / whole, digits)).otherwise(0.0)


def outcome_funnel(applications: DataFrame, outcomes: DataFrame, stages: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Distinct applications (application_id) that reached each stage (name -> stage value), and the rate of each stage to
    the one before it."""
    joined = applications.join(outcomes.select("application_id", "stage"), "application_id", "left")
    names = ["applications", *stages]
    counts = [F.count_distinct("application_id").alias("applications"), *[F.count_distinct(F.when(F.col("stage") == v, F.col("application_id"))).alias(n) for n, v in stages.items()]]
    grouped = joined.groupBy(*by).agg(*counts) if by else joined.agg(*counts)
    return grouped.withColumns({f"{a}_to_{b}": rate(F.col(b), F.col(a)) for a, b in zip(names, names[1:], strict=False)})


def stage_gaps(applications: DataFrame, outcomes: DataFrame, stages: dict[str, str]) -> DataFrame:
    """Average days between neighbouring stages, one decimal; the earliest outcome of a stage counts, gaps below 0 don't."""
    first = outcomes.groupBy("application_id").agg(*[F.min(F.when(F.col("stage") == v, F.col("occurred_at"))).alias(n) for n, v in stages.items()])
    joined = applications.join(first, "application_id", "left")
    names = ["applied_date", *stages]
    gap = lambda a, b: F.datediff(b, a)
    return joined.agg(*[F.coalesce(half_up(F.avg(F.when(gap(a, b) >= 0, gap(a, b))), 1), F.lit(0.0)).alias(f"days_to_{b}") for a, b in zip(names, names[1:], strict=False)])


RESPONDED, INTERVIEWING = ("PHONE_SCREEN", "INTERVIEWING", "OFFERED"), ("INTERVIEWING", "OFFERED")


def status_funnel(applications: DataFrame) -> DataFrame:
    """Counts by status, each later status counting for the earlier ones too."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    out = applications.agg(F.count("*").alias("applied"), count(*RESPONDED).alias("responded"), count(*INTERVIEWING).alias("interviewing"), count("OFFERED").alias("offered"), count("REJECTED").alias("rejected"))
    return out.withColumns({f"{n}_rate": rate(F.col(n), F.col("applied")) for n in ("responded", "interviewing", "offered", "rejected")})


def score_comparison(applications: DataFrame, scores: DataFrame, positive: Column, negative: Column) -> DataFrame:
    """Mean scores of positive and negative outcomes, and the least of the positive ones."""
    score = F.col("overall_score")
    return applications.join(scores, "job_id").agg(
        F.coalesce(half_up(F.avg(F.when(positive, score)), 3), F.lit(0.0)).alias("positive_mean"),
        F.count_if(positive).alias("positive_count"),
        F.coalesce(half_up(F.avg(F.when(negative, score)), 3), F.lit(0.0)).alias("negative_mean"),
        F.count_if(negative).alias("negative_count"),
        F.coalesce(F.min(F.when(positive, score)), F.lit(0)).alias("threshold"),
    )


def frequencies(df: DataFrame, value: Column, name: str, n: int | None = None) -> DataFrame:
    """How often each value occurs, most frequent first, ties by value; the first n if given."""
    out = df.where(value.isNotNull()).groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(n) if n else out


def effectiveness(messages: DataFrame, key: Column, name: str) -> DataFrame:
    """Sent messages, replies, and interview signals (replies to referral or recruiter messages) by template or channel."""
    replied = F.coalesce(F.col("replied"), F.lit(False))
    signal = replied & F.col("message_type").isin("REFERRAL", "RECRUITER")
    out = messages.where("direction = 'OUT'").groupBy(key.alias(name)).agg(F.count("*").alias("sent"), F.count_if(replied).alias("replies"), F.count_if(signal).alias("signals"))
    return out.withColumns({"reply_rate": rate(F.col("replies"), F.col("sent")), "signal_rate": rate(F.col("signals"), F.col("sent"))})


def hiring_velocity(companies: DataFrame, jobs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Active jobs of every active company that were discovered in the last days, zero included."""
    recent = jobs.where(F.col("is_active") & (F.col("discovered_date") >= F.date_sub(as_of, days))).groupBy("company_id").agg(F.count("*").alias("n"))
    return companies.where("is_active").join(recent, "company_id", "left").select("company_id", F.coalesce("n", F.lit(0).cast("long")).alias("velocity"))


def source_quality(companies: DataFrame) -> DataFrame:
    out = companies.groupBy("discovered_via").agg(F.sum("total_applications").alias("applications"), F.sum("total_interviews").alias("interviews"))
    return out.withColumn("quality", rate(F.col("interviews"), F.col("applications")))


def blockers(applications: DataFrame, outcomes: DataFrame) -> DataFrame:
    """How often rejected applications' outcomes of rejection name each reason (lower-cased, trimmed; blank ones don't count)."""
    rejected = applications.where(F.col("status") == "REJECTED").select("application_id")
    named = outcomes.where((F.col("stage") == "REJECTED") & ~is_blank(F.col("notes"))).join(rejected, "application_id", "left_semi")
    return frequencies(named, F.lower(trim_control(F.col("notes"))), "reason")


def daily_digest(jobs: DataFrame, scores: DataFrame, day: Column) -> DataFrame:
    """How many active postings a day brought, and the id and score of the best of them; a score of 0 never wins, ties go to
    the smaller id. scores has id and score."""
    rows = jobs.where(F.col("is_active") & (F.col("discovered_date") == day)).select("id").join(scores.select("id", "score"), "id", "left")
    best = F.max(F.when(F.col("score") > 0, F.struct("score", (-F.col("id")).alias("neg"))))
    return rows.agg(F.count_distinct("id").alias("fresh"), best.alias("best")).select("fresh", (-F.col("best.neg")).alias("top_id"), F.coalesce("best.score", F.lit(0).cast("long")).alias("top_score"))


def counts_by(jobs: DataFrame, column: str) -> DataFrame:
    """Rows by a column's values, nulls as UNKNOWN."""
    return jobs.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias(column)).agg(F.count("*").alias("n"))
