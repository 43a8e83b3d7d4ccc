"""Contacts: seniority, addresses, warmth, and the queue of next actions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dialect import jvm
from millrace.functions.text import is_blank, name_parts
from millrace.operators.scoring import jaccard_points, urgency
from millrace.operators.views import expires_in
from millrace.session import ship

#: Fixed values: (seniority, pattern) of posters' titles, and (seniority, words) of contacts' titles, each in its order.
POSTER_LEVELS = (("RECRUITER", r"\b(?:recruit|talent\s+acqui|sourcer|ta\b)\b"), ("DIRECTOR", r"\b(?:director|vp|vice\s+president)\b"), ("MANAGER", r"\b(?:manager|head\s+of|lead)\b"), ("STAFF", r"\b(?:staff|principal|distinguished)\b"), ("SENIOR", r"\b(?:senior|sr\.?)\b"))
CONTACT_LEVELS = (("RECRUITER", ("recruit", "talent acquisition")), ("MANAGER", ("manager", "head of")), ("DIRECTOR", ("director",)), ("STAFF", ("staff",)), ("SENIOR", ("senior", "sr.")))


def poster_seniority(title: Column) -> Column:
    out = F.when(is_blank(title), None)
    for level, pattern in POSTER_LEVELS:
        out = out.when(title.rlike(jvm(pattern)), level)
    return out.otherwise("IC")


def contact_seniority(title: Column) -> Column:
    out, low = F.when(is_blank(title), None), F.lower(title)
    for level, words in CONTACT_LEVELS:
        out = out.when(reduce(Column.__or__, [low.contains(w) for w in words]), level)
    return out.otherwise("IC")


def email_candidates(name: Column, domain: Column) -> Column:
    """array of struct(email, pattern, confidence), most likely first; empty without a first and last name and a domain."""
    parts, at = name_parts(name), F.concat(F.lit("@"), F.lower(F.trim(domain)))
    first, last = parts["first"], parts["last"]
    letter = F.left(first, F.lit(1))
    forms = (("firstname.lastname", "HIGH", F.concat(first, F.lit("."), last, at)), ("firstname", "MEDIUM", F.concat(first, at)), ("f.lastname", "MEDIUM", F.concat(letter, F.lit("."), last, at)), ("flastname", "LOW", F.concat(letter, last, at)), ("firstname_lastname", "LOW", F.concat(first, F.lit("_"), last, at)))
    made = F.array(*[F.struct(e.alias("email"), F.lit(p).alias("pattern"), F.lit(c).alias("confidence")) for p, c, e in forms])
    return F.when(~is_blank(name) & ~is_blank(domain) & (last != ""), made).otherwise(F.array().cast("array<struct<email:string,pattern:string,confidence:string>>"))


def warmth(companies: Column, location: Column, skills: Column, mutuals: Column, title: Column, places: tuple[str, ...], mine: Column) -> Column:
    """Up to 100 points: a shared employer 30, a wanted place 25, common skills up to 15, mutual contacts 15, 10 or 5."""
    employer = F.when(F.exists(companies, lambda c: F.contains(F.lower(title), F.lower(F.trim(c)))), 30).otherwise(0)
    near = F.when(reduce(Column.__or__, [F.lower(location).contains(p.lower()) for p in places], F.lit(False)), 25).otherwise(0)
    known = F.when(mutuals >= 10, 15).when(mutuals >= 5, 10).when(mutuals >= 1, 5).otherwise(0)
    return F.least(F.lit(100), employer + near + F.coalesce(jaccard_points(mine, skills), F.lit(0)) + known)


def action_queue(replied: DataFrame, contacts: DataFrame, applications: DataFrame, as_of: Column, impacts: tuple[float, float, float], n: int | None = None) -> DataFrame:
    """Follow-ups of replies (relationship_id, contact_id, last_activity), connections to open contacts (contact_id,
    priority, created_at) and stale applications (application_id, updated_at) as one list: action score, best first."""
    c = F.col
    row = lambda entity, kind, start, days, impact: [entity.cast("string").alias("entity_id"), F.lit(kind).alias("action"), start.alias("last_activity"), F.lit(days).alias("window"), impact.cast("double").alias("impact")]
    follow = replied.select(*row(c("relationship_id"), "FOLLOW_UP", c("last_activity"), 7, F.lit(impacts[0])))
    connect = contacts.where("priority > 50").select(*row(c("contact_id"), "CONNECT", c("created_at"), 14, impacts[1] * c("priority") / 100))
    stale = applications.where(c("updated_at") < as_of - F.make_interval(days=F.lit(14))).select(*row(c("application_id"), "REVIVE", c("updated_at"), 14, F.lit(impacts[2])))
    remaining = c("window") - F.timestamp_diff("SECOND", c("last_activity"), as_of) / 86_400
    out = follow.unionByName(connect).unionByName(stale).withColumn("score", c("impact") * urgency(c("window").cast("double"), remaining)).drop("window", "impact")
    ordered = out.orderBy(F.desc("score"), "action", "entity_id")
    return ordered.limit(n) if n else ordered


def _alike(a: str, b: str) -> bool:
    a, b = a.lower(), b.lower()
    return a == b or len(a) > 10 and b.startswith(a) or len(b) > 10 and a.startswith(b)


def align_once(references: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """References (key, position, title) with the first text row (key, position, title, company) of the same key whose
    title is alike or a long prefix, each text row for one reference only, in order. A key is one fetched page; the rows
    of a page stream by in order, so that a task holds one page at a time."""
    ship(references.sparkSession)
    both = references.select(key, F.lit(1).alias("side"), "position", "title", F.lit(None).cast("string").alias("company")).unionByName(texts.select(key, F.lit(0).alias("side"), "position", "title", "company"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, free = None, []
        for batch in batches:
            rows = []
            for own, side, position, title, company in batch.itertuples(index=False, name=None):
                if own != page:
                    page, free = own, []
                if side == 0:
                    free.append((title, company))
                else:
                    hit = next((k for k, t in enumerate(free) if _alike(title, t[0])), None)
                    rows.append((own, position, title, None if hit is None else free.pop(hit)[1]))
            yield pd.DataFrame(rows, columns=[key, "position", "title", "company"])

    ordered = both.repartition(key).sortWithinPartitions(key, "side", "position")
    return ordered.mapInPandas(run, f"{key} {references.schema[key].dataType.simpleString()}, position int, title string, company string")


def containing_company(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows whose company holds the wanted name or is held by it."""
    low = F.lower("company")
    return rows.where(low.contains(wanted.lower()) | F.contains(F.lit(wanted.lower()), low))


def display_rows(actions: DataFrame, contacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Scored actions (entity_id, action, score, urgency, contact_id, job_id) as rows for display: ids as text, a label, when the
    action expires, the contact's name (contact_id, contact_name, company_name), and the posting's title (job_id, title, company). The
    company is the contact's, else the posting's."""
    named = actions.join(contacts.select("contact_id", "contact_name", "company_name"), "contact_id", "left").join(jobs.select("job_id", F.col("title").alias("job_title"), "company"), "job_id", "left")
    text = lambda c: F.col(c).cast("string").alias(c)
    return named.select(text("entity_id"), "action", "score", "urgency", F.lower(F.replace(F.col("action"), F.lit("_"), F.lit(" "))).alias("label"), expires_in(F.col("urgency")).alias("expires_in"), text("contact_id"), text("job_id"), "contact_name", F.coalesce("company_name", "company").alias("company_name"), "job_title")
