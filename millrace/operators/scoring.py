"""Scores as single expressions over a posting's columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.config import Scoring
from millrace.functions.dialect import any_in_lowered
from millrace.functions.text import clamp, half_up, is_blank

#: Countries of the location factor, the name of the bonus, words of a hiring surge.
EU = ("germany", "france", "netherlands", "spain", "italy", "austria", "belgium", "ireland", "sweden", "denmark", "finland", "poland", "portugal", "czech republic", "romania", "luxembourg")
BONUS_NAME = "AI/ML"
SURGE_WORDS = ("growing team", "rapid growth", "scaling", "hiring", "series b", "series c", "expansion", "new office")


def _title_has(title: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.coalesce(title.contains(w), F.lit(False)) for w in words], F.lit(False))


def with_match(df: DataFrame, rules: Scoring, title: str = "title", description: str = "description") -> DataFrame:
    """Adds match, a struct(score, matched, missing, recommendation) of a posting against the profile's skills. Each step
    is a column of its own, so that every pattern runs once for each row."""
    c = F.col
    low = F.lower(F.coalesce(c(title), F.lit("")))
    out = df.withColumns({"_text": F.lower(F.concat(F.coalesce(c(title), F.lit("")), F.lit(" "), F.coalesce(c(description), F.lit("")))), "_low": low})
    named = [F.struct(F.lit(s.name).alias("name"), F.lit(s.weight).alias("weight"), (any_in_lowered(c("_text"), s.variants) if s.variants else c("_text").contains(s.name.lower())).alias("hit")) for s in rules.skills]
    bonus = any_in_lowered(c("_text"), [p if r"\b" in p else rf"\b{p}\b" for p in rules.bonus_signals])
    out = out.withColumns({"_hits": F.array(*named), "_bonus": bonus})
    names = lambda wanted: F.transform(F.filter("_hits", lambda h: h["hit"] == wanted), lambda h: h["name"])
    extra = F.when(c("_bonus"), F.array(F.lit(BONUS_NAME))).otherwise(F.array().cast("array<string>"))
    earned = F.aggregate("_hits", F.lit(0.0), lambda a, h: a + F.when(h["hit"], h["weight"]).otherwise(0.0)) + F.when(c("_bonus"), rules.bonus_weight).otherwise(0.0)
    out = out.withColumns({"_matched": F.concat(names(True), extra), "_missing": names(False), "_score": clamp(half_up(earned / rules.benchmark_weight * 100)).cast("int")})
    primary = F.exists("_matched", lambda n: F.lower(n).isin(*[p.lower() for p in rules.primary_skills]))
    cap = F.least(F.when(any_in_lowered(c("_low"), rules.competing), F.lit(rules.competing_cap)).otherwise(100), F.when(primary, F.lit(100)).otherwise(rules.primary_cap))
    out = out.withColumn("_score", F.least("_score", cap))
    out = out.withColumn("_score", F.when(_title_has(c("_low"), rules.senior_words), half_up(c("_score") * F.lit(rules.senior_multiplier)).cast("int")).otherwise(c("_score")))
    n = F.size("_matched")
    advice = F.when((c("_score") >= rules.apply_score) & (n >= rules.apply_matches), "APPLY").when((c("_score") >= rules.maybe_score) & (n >= rules.maybe_matches), "MAYBE").otherwise("SKIP")
    some, none = ~is_blank(c("_text")), F.array().cast("array<string>")
    full = F.struct(F.when(some, c("_score")).otherwise(0).alias("score"), F.when(some, c("_matched")).otherwise(none).alias("matched"), F.when(some, c("_missing")).otherwise(none).alias("missing"), F.when(some, advice).otherwise("SKIP").alias("recommendation"))
    # a generator of one row: filters on the score stay above it, where they don't repeat the patterns
    return out.select(*[x for x in df.columns if x != "match"], F.explode(F.array(full)).alias("match"))


def interview_factor(rate: Column) -> Column:
    return F.when(rate.isNull() | (rate == 0), 50).otherwise(half_up(20 + rate * 80)).cast("int")


def salary_factor(low: Column, high: Column, target: float) -> Column:
    ratio = F.coalesce(high, low).cast("double") / target
    return F.when(ratio.isNull() | F.lit(target <= 0), 50).when(ratio >= 1.3, 100).when(ratio >= 1.0, 80).when(ratio >= 0.85, 60).when(ratio >= 0.7, 40).otherwise(20)


def company_factor(priority: Column) -> Column:
    return F.when(priority.isNull(), 50).otherwise(half_up(clamp(priority))).cast("int")


def seniority_factor(title: Column) -> Column:
    low = F.lower(title)
    return (
        F.when(is_blank(title), 50)
        .when(_title_has(low, ("staff", "principal", "director", "vp", "head")), 90)
        .when(_title_has(low, ("senior", "sr", "lead")), 75)
        .when(_title_has(low, ("junior", "jr", "entry", "intern", "graduate")), 40)
        .otherwise(60)
    )


def location_factor(remote: Column, country: Column, visa: Column, wanted: tuple[str, ...]) -> Column:
    low = F.lower(country)
    preferred = reduce(Column.__or__, [low.contains(w.lower()) for w in wanted], F.lit(False))
    eu = low.isin(*EU)
    boosted = F.when(visa == "CONFIRMED", 100).when(visa == "LIKELY", 85).otherwise(70)
    return F.when(remote.isNotNull() & (remote != "ONSITE"), 100).when(is_blank(country), 50).when(preferred, 100).when(eu, boosted).otherwise(30)


WEIGHTS = {"matchScore": 0.30, "interviewHistory": 0.20, "salary": 0.20, "companyQuality": 0.15, "seniority": 0.10, "locationFit": 0.05}


def opportunity(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """struct(score, breakdown): the weighted sum of the six factors; a missing match counts 50."""
    weights = weights or WEIGHTS
    factors = factors | {"matchScore": F.coalesce(factors["matchScore"], F.lit(50))}
    total = reduce(Column.__add__, [factors[k] * F.lit(w) for k, w in weights.items()])
    return F.struct(clamp(half_up(total)).cast("int").alias("score"), F.create_map(*[x for k in weights for x in (F.lit(k), factors[k].cast("int"))]).alias("breakdown"))


def contact_priority(interview_weight: Column, warmth: Column) -> Column:
    return (0.6 * interview_weight + 0.4 * warmth).cast("int")


def jaccard_points(mine: Column, theirs: Column, points: int = 15) -> Column:
    """Truncated points for the share of common skills."""
    union = F.size(F.array_union(mine, theirs))
    return F.when(union > 0, (F.size(F.array_intersect(mine, theirs)) / union * points).cast("int")).otherwise(0)


def urgency(total_days: Column, remaining_days: Column) -> Column:
    """1.2 when overdue or without any time, else 1 - remaining / total between 0 and 1.5; 1 without dates."""
    return F.when(total_days.isNull() | remaining_days.isNull(), 1.0).when((remaining_days < 0) | (total_days <= 0), 1.2).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.5), 1 - remaining_days / total_days)))


def visa_friendliness(*signals: Column) -> Column:
    """Of three nullable signals: HIGH for all, MEDIUM for some, LOW for none, UNKNOWN if any is null."""
    n = reduce(Column.__add__, [s.cast("int") for s in signals])
    return F.when(n.isNull(), "UNKNOWN").when(n == len(signals), "HIGH").when(n >= 1, "MEDIUM").otherwise("LOW")


def hiring_surge(text: Column, words: tuple[str, ...] = SURGE_WORDS, least: int = 5) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(Column.__add__, [low.contains(w).cast("int") for w in words]) >= least


def liveness(status: Column, body: Column, expired: tuple[str, ...], active: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    has = lambda words: reduce(Column.__or__, [low.contains(w) for w in words], F.lit(False))
    return F.when(status.isin(404, 410), "EXPIRED").when(status >= 400, "UNCERTAIN").when(has(expired), "EXPIRED").when(has(active), "ACTIVE").otherwise("UNCERTAIN")


CADENCE = (7, 7, 14)


def next_follow_up(sent: Column, count: Column, cadence: tuple[int, ...] = CADENCE) -> Column:
    """The date of the next follow-up after so many, null after the last."""
    days = F.try_element_at(F.array(*map(F.lit, cadence)), (count + 1).cast("int"))
    return F.date_add(sent, days)


def evaluation(scores: dict[str, Column]) -> Column:
    """Weighted overall of five 1..5 scores, each 3 where it is missing."""
    weights = dict(zip(scores, (0.35, 0.20, 0.20, 0.15, 0.10), strict=True))
    return reduce(Column.__add__, [clamp(F.coalesce(c, F.lit(3)), 1, 5) * w for c, w in zip(scores.values(), weights.values(), strict=True)])


def company_priority(match: Column, rate: Column, velocity: Column, visa: Column, salary: Column) -> Column:
    """.35 / .25 / .15 / .15 / .10 of five factors from 0 to 100; a missing one counts 50."""
    parts = zip((match, rate, velocity, visa, salary), (0.35, 0.25, 0.15, 0.15, 0.10), strict=True)
    return reduce(Column.__add__, [clamp(F.coalesce(c.cast("double"), F.lit(50.0))) * w for c, w in parts])
