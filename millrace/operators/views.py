"""Rows as screens and timers want them: details with scores, sorts, what is due, what has expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.keys import fingerprint
from millrace.functions.text import is_blank, trim_control
from millrace.operators.postings import supersede


def with_scores(jobs: DataFrame, matches: DataFrame, opportunities: DataFrame) -> DataFrame:
    """jobs with their match (id, score, recommendation, matched, missing) and opportunity (id, score), where they have any;
    a missing score shows as 0, missing skills as none."""
    m = matches.select("id", F.col("score").alias("_match"), F.col("recommendation").alias("recommendation"), F.col("matched").alias("_matched"), F.col("missing").alias("_missing"))
    o = opportunities.select("id", F.col("score").alias("_opportunity"))
    none = F.array().cast("array<string>")
    joined = jobs.drop("recommendation").join(m, "id", "left").join(o, "id", "left")
    shown = {"match_score": F.coalesce("_match", F.lit(0)), "opportunity_score": F.coalesce("_opportunity", F.lit(0)), "matched": F.coalesce("_matched", none), "missing": F.coalesce("_missing", none)}
    return joined.withColumns(shown).drop("_match", "_opportunity", "_matched", "_missing")


#: Orders of the applied list by name, each before the id; unknown names sort by the day of application.
APPLIED_ORDERS = {"matchScore": F.desc_nulls_last, "opportunity": F.desc_nulls_last, "company": F.asc_nulls_last, "title": F.asc_nulls_last, "date": F.desc_nulls_last, "appliedAt": F.desc_nulls_last}
_APPLIED_COLUMNS = {"matchScore": "match_score", "opportunity": "opportunity_score", "company": "company", "title": "title", "date": "posted_date", "appliedAt": "applied_at"}


def applied_order(sort: str) -> list[Column]:
    name = sort if sort in APPLIED_ORDERS else "appliedAt"
    return [APPLIED_ORDERS[name](_APPLIED_COLUMNS[name]), F.asc("id")]


def today_order(sort: str = "matchScore") -> list[Column]:
    """By day of posting, or by match, day and opportunity; nulls last, then the id."""
    keys = ["posted_date"] if sort == "date" else ["match_score", "posted_date", "opportunity_score"]
    return [*(F.desc_nulls_last(k) for k in keys), F.asc("id")]


def liveness_due(jobs: DataFrame, cutoff: Column, batch: int = 50) -> DataFrame:
    """Ids whose liveness was never checked or not since the cutoff: all active applied postings, and of active, unapplied,
    kept ones without an endpoint but with an address the newest so many (a top-k report)."""
    due = jobs.where(F.col("is_active") & (F.col("last_check").isNull() | (F.col("last_check") < cutoff)))
    loose = due.where(~F.col("applied") & F.col("endpoint_id").isNull() & F.col("apply_url").isNotNull() & (F.col("decision") == "KEEP"))
    return due.where("applied").select("id").unionByName(loose.orderBy(F.desc("created_at"), "id").limit(batch).select("id"))


def aggregator_issues(runs: DataFrame) -> DataFrame:
    """Runs that failed, came out empty, or succeeded with nothing fetched."""
    status = F.col("last_status")
    return runs.where(status.isin("ERROR", "EMPTY") | ((status == "SUCCESS") & (F.col("fetched") == 0)))


def stale_for_enrichment(companies: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Companies with an address that were never enriched, or so many days ago."""
    return companies.where(F.col("url").isNotNull() & (F.col("enriched_at").isNull() | (F.col("enriched_at") < F.date_sub(as_of, days))))


def reap_pending_visa(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Active postings whose visa decision has waited since before that day become inactive, of unknown status."""
    old = F.coalesce(F.col("is_active") & (F.col("visa") == "PENDING") & (F.col("discovered_date") < as_of), F.lit(False))
    return jobs.withColumns({"reason": F.when(old, "visa: pending expired").otherwise(F.col("reason")), "is_active": F.col("is_active") & ~old, "visa": F.when(old, "UNKNOWN").otherwise(F.col("visa"))})


def unhealthy(crawls: DataFrame, empty: int = 2, error: int = 3) -> DataFrame:
    """Endpoints whose last crawls (crawled_at, crawl_id) all failed: so many empty ones or so many errors in the streak
    since the last other status. Counts are pre-aggregated by the last good crawl of each endpoint."""
    place = F.struct("crawled_at", "crawl_id")
    good = crawls.where(~F.col("status").isin("EMPTY", "ERROR")).groupBy("endpoint_id").agg(F.max(place).alias("_good"))
    after = crawls.join(good, "endpoint_id", "left").where(F.col("_good").isNull() | (place > F.col("_good")))
    count = lambda s: F.count_if(F.col("status") == s)
    return after.groupBy("endpoint_id").agg(count("EMPTY").alias("empty"), count("ERROR").alias("errors")).where((F.col("empty") >= empty) | (F.col("errors") >= error))


def reindex(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs with the fingerprints of active ones made anew and aggregators' rows superseded by active own ones, and the counts
    of both (updated, superseded)."""
    new = fingerprint(F.col("title"), F.coalesce("company", F.lit("")), F.col("location"))
    fresh = jobs.withColumn("_old", F.col("fingerprint")).withColumn("fingerprint", F.when(F.col("is_active"), new).otherwise(F.col("fingerprint")))
    # an inactive own row supersedes nothing
    owner = fresh.withColumn("_decision", F.col("decision")).withColumn("decision", F.when(F.col("is_aggregator") | F.col("is_active"), F.col("decision")).otherwise("INACTIVE"))
    done = supersede(owner).withColumn("decision", F.when(F.col("decision") == "INACTIVE", F.col("_decision")).otherwise(F.col("decision")))
    counts = done.agg(F.count_if(~F.col("fingerprint").eqNullSafe(F.col("_old"))).alias("updated"), F.count_if(F.col("decision") != F.col("_decision")).alias("superseded"))
    return done.drop("_old", "_decision"), counts


def new_contacts(found: DataFrame, known: DataFrame) -> DataFrame:
    """People found that aren't known: by address where they have one, else by name (lower-cased, trimmed) in the company;
    one of several alike, that of the smallest id."""
    name = F.lower(trim_control(F.col("name")))
    by_url, by_name = found.where("url IS NOT NULL"), found.where("url IS NULL").where(~is_blank(F.col("name"))).withColumn("_name", name)
    first = by_url.groupBy("url").agg(F.min("id").alias("id")).join(known.select("url"), "url", "left_anti").select("id")
    names = known.select("company_id", name.alias("_name")).distinct()
    second = by_name.groupBy("company_id", "_name").agg(F.min("id").alias("id")).join(names, ["company_id", "_name"], "left_anti").select("id")
    return found.join(first.union(second), "id", "left_semi")


#: Which messages may follow in which state of a relationship.
VARIANTS = {
    "DISCOVERED": ("INFO_CHAT", "TECH_DISCUSSION", "RECRUITER_PITCH"), "CONTACTED": ("FOLLOW_UP", "TECH_DISCUSSION", "REFERRAL_ASK"), "REPLIED": ("FOLLOW_UP", "TECH_DISCUSSION", "REFERRAL_ASK"),
    "ENGAGED": ("REFERRAL_ASK", "FOLLOW_UP"), "REFERRED": ("REFERRAL_ASK", "FOLLOW_UP"), "INTERVIEW_OBTAINED": ("REFERRAL_ASK", "FOLLOW_UP"), "GHOSTED": ("FOLLOW_UP",), "COLD": ("FOLLOW_UP",),
}


def message_variants(status: Column) -> Column:
    """The messages that a contact may get; one without a relationship counts as discovered."""
    table = F.create_map(*[x for s, v in VARIANTS.items() for x in (F.lit(s), F.array(*map(F.lit, v)))])
    return F.try_element_at(table, F.coalesce(status, F.lit("DISCOVERED")))


def may_connect(sent_today: Column, last_contact: Column, now: Column, limit: int = 5, days: int = 7) -> Column:
    """Whether the day's limit of connections leaves room and the contact's cooldown is over."""
    return (sent_today < limit) & (last_contact.isNull() | (last_contact + F.make_interval(days=F.lit(days)) <= now))


def expires_in(urgency: Column) -> Column:
    """`overdue`, or the days left of a week, from an urgency of 0 to 1.2."""
    days = F.when(urgency >= 1.2, 0).otherwise(F.greatest(F.lit(0), ((F.lit(1.0) - urgency) * 7).cast("long")))
    return F.when(days == 0, "overdue").otherwise(F.concat(days.cast("string"), F.lit("d")))
