"""The library's entities as the star-schema tables show them, each as a DataFrame and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Filters, Profile, Scoring, Skill
from millrace.functions.dialect import sql_literal
from millrace.session import table

AGGREGATORS = ("src0", "src1", "src2", "src3", "src4", "src5", "src6", "src7")
PLACES = ("Berlin, Germany", "Amsterdam, NL", "Vienna", "Remote - EU", "Paris, France", "London", "Kraków", "Springfield; US", "Zürich (Hybrid)", None, "", "Hamburg, HH, De")
COMPANIES = ("SAP SE", "SAP Deutschland GmbH", "Deutsche Bank AG", "Stripe Inc.", "Booking.com BV", "Smith GmbH & Co. KG", "Meta Global Inc", "Acme", None)
#: A profile over the invented words of the tables.
PROFILE = Profile(
    Scoring(
        skills=(Skill("Thing", 5.0, (r"\bthing\b", r"\bthings\b")), Skill("Onthe", 4.5), Skill("Ered", 3.0, (r"\bered\b",)), Skill("Ention", 3.0), Skill("Keit", 2.5), Skill("Ción", 2.5), Skill("Ement", 2.0), Skill("Ation", 2.0), Skill("Edtion", 1.5)),
        primary_skills=("thing", "onthe"), bonus_signals=("onand", "der", "la"), competing=(r"\btio\b", r"\beder\b", r"\bou\b"), senior_words=("ingth", "keit"),
    ),
    Filters(role_include=("er", "on", "la"), role_exclude=("une", "das", "of"), language_exclude=(r"with\s+th", r"\bpour\s", r"nicht\s"), language_soft=(r"\bof\b", "des"), visa_negative=(r"\bis\s+th", r"\bno\b"), visa_positive=(r"\band\s+th", r"\bcon\b")),
)


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values: tuple, n: str) -> str:
    return f"([{', '.join('NULL' if v is None else sql_literal(v) for v in values)}])[{n} % {len(values)} + 1]"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings."""
    d = F.col("doc_id")
    first = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("description"),
        "lang",
        "source",
        F.col("source").isin(*AGGREGATORS).alias("is_aggregator"),
        F.when(d % 13 != 0, F.date_add(first, (d % 60).cast("int"))).alias("posted_date"),
        F.date_add(first, (d % 67).cast("int")).alias("discovered_date"),
        _pick(PLACES, d).alias("location"),
        _pick(COMPANIES, d).alias("company"),
        (d % len(COMPANIES)).alias("company_id"),
        (d % 11 != 0).alias("is_active"),
        (d % 17 == 0).alias("applied"),
        (d % 29 == 0).alias("hidden"),
        F.when(d % 7 == 0, "SKIP").otherwise("KEEP").alias("decision"),
        F.when(d % 3 != 0, (40_000 + d % 50 * 1_000).cast("double")).alias("salary_min"),
        F.when(d % 4 != 0, (50_000 + d % 50 * 1_000).cast("double")).alias("salary_max"),
        F.when(d % 5 == 0, "REMOTE").when(d % 5 == 1, "ONSITE").alias("remote"),
    )


JOBS = f"""jobs AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS description, lang, source,
         source IN ({', '.join(map(sql_literal, AGGREGATORS))}) AS is_aggregator,
         CASE WHEN doc_id % 13 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) END AS posted_date,
         DATE '2024-01-01' + CAST(doc_id % 67 AS INTEGER) AS discovered_date,
         {_pick_sql(PLACES, 'doc_id')} AS location, {_pick_sql(COMPANIES, 'doc_id')} AS company,
         doc_id % {len(COMPANIES)} AS company_id, doc_id % 11 <> 0 AS is_active, doc_id % 17 = 0 AS applied, doc_id % 29 = 0 AS hidden,
         CASE WHEN doc_id % 7 = 0 THEN 'SKIP' ELSE 'KEEP' END AS decision,
         CASE WHEN doc_id % 3 <> 0 THEN CAST(40000 + doc_id % 50 * 1000 AS DOUBLE) END AS salary_min,
         CASE WHEN doc_id % 4 <> 0 THEN CAST(50000 + doc_id % 50 * 1000 AS DOUBLE) END AS salary_max,
         CASE doc_id % 5 WHEN 0 THEN 'REMOTE' WHEN 1 THEN 'ONSITE' END AS remote
  FROM documents)"""

STAGES = {"recruiter_screen": "SCREEN", "technical": "TECHNICAL", "final_round": "FINAL", "offers": "OFFER"}
STATUSES = ("APPLIED", "PHONE_SCREEN", "INTERVIEWING", "OFFERED", "REJECTED")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as applications; the job is the order's customer."""
    k = F.col("o_orderkey")
    via = F.when(k % 4 == 0, "REFERRAL").when(k % 4 == 1, "RECRUITER").when(k % 4 == 2, "APPLICATION")
    return table(spark, sf_dir, "orders").select(k.alias("application_id"), F.col("o_custkey").alias("job_id"), F.to_date("o_orderdate").alias("applied_date"), _pick(STATUSES, k).alias("status"), via.alias("interview_source"))


APPLICATIONS = f"""applications AS (
  SELECT o_orderkey AS application_id, o_custkey AS job_id, CAST(o_orderdate AS DATE) AS applied_date, {_pick_sql(STATUSES, 'o_orderkey')} AS status,
         CASE o_orderkey % 4 WHEN 0 THEN 'REFERRAL' WHEN 1 THEN 'RECRUITER' WHEN 2 THEN 'APPLICATION' END AS interview_source
  FROM orders)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as outcomes of applications; further lines repeat stages."""
    stage = _pick(tuple(STAGES.values()), F.col("l_linenumber") - 1)
    notes = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(" Reason "), F.col("l_linestatus")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("application_id"), stage.alias("stage"), F.to_date("l_shipdate").alias("occurred_at"), notes.alias("notes"))


OUTCOMES = f"""outcomes AS (
  SELECT l_orderkey AS application_id, {_pick_sql(tuple(STAGES.values()), '(l_linenumber - 1)')} AS stage, CAST(l_shipdate AS DATE) AS occurred_at,
         CASE WHEN l_returnflag = 'R' THEN ' Reason ' || l_linestatus END AS notes
  FROM lineitem)"""

EVENTS = {"signup": "CONTACT_DISCOVERED", "view": "REFERRAL_REQUESTED", "click": "MESSAGE_SENT", "purchase": "REPLIED", "error": "GHOSTED_AUTO"}


def relationship_events(events: DataFrame) -> DataFrame:
    """events as events of the relationship with a user."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair]), F.col("event_type"))
    return events.select("event_id", F.col("user_id").alias("relationship_id"), kind.alias("event_type"), F.col("ts").alias("occurred_at"))


RELATIONSHIP_EVENTS = f"""relationship_events AS (
  SELECT event_id, user_id AS relationship_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENTS.items())} END AS event_type, ts AS occurred_at
  FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages; one has a reply if a later turn exists."""
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    kinds = ("INFO_CHAT", "REFERRAL", "RECRUITER")
    n = F.col("conv_id") + F.col("turn")
    return c.join(last, "conv_id").select("conv_id", "turn", F.when(F.col("role") == "user", "OUT").otherwise("IN").alias("direction"), _pick(("EMAIL", "CHAT", None), F.col("conv_id")).alias("channel"), _pick(kinds, n).alias("message_type"), _pick(("template_a", "template_b", None, "template_c"), n).alias("template_used"), (F.col("turn") < F.col("last")).alias("replied"))


MESSAGES = f"""messages AS (
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'OUT' ELSE 'IN' END AS direction, {_pick_sql(('EMAIL', 'CHAT', None), 'conv_id')} AS channel,
         {_pick_sql(('INFO_CHAT', 'REFERRAL', 'RECRUITER'), '(conv_id + turn)')} AS message_type,
         {_pick_sql(('template_a', 'template_b', None, 'template_c'), '(conv_id + turn)')} AS template_used,
         turn < max(turn) OVER (PARTITION BY conv_id) AS replied
  FROM conversations)"""


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as companies."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("company_id"), F.col("s_name").alias("name"), (k % 6 != 0).alias("is_active"), _pick(("SEARCH", "REFERRAL", "LIST"), k).alias("discovered_via"), (k % 9).alias("total_applications"), (k % 4).alias("total_interviews"), F.when(k % 5 != 0, k % 2 == 0).alias("has_sponsored_before"), (k % 3 == 0).alias("english_speaking"), (k % 2 == 0).alias("international_workforce"))


SQL_COMPANIES = f"""companies AS (
  SELECT s_suppkey AS company_id, s_name AS name, s_suppkey % 6 <> 0 AS is_active, {_pick_sql(('SEARCH', 'REFERRAL', 'LIST'), 's_suppkey')} AS discovered_via,
         s_suppkey % 9 AS total_applications, s_suppkey % 4 AS total_interviews,
         CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 2 = 0 END AS has_sponsored_before, s_suppkey % 3 = 0 AS english_speaking, s_suppkey % 2 = 0 AS international_workforce
  FROM supplier)"""


#: Events of users stand an hour for a day in the log of their relationships, so that some stay silent.
MACHINE_EVENTS = {"click": "MESSAGE_SENT", "purchase": "REPLIED", "error": "STATUS_OVERRIDE"}
_DAY_ZERO = 1_704_067_200_000_000


def machine_events(events: DataFrame) -> DataFrame:
    """events as messages, replies and overrides of the relationship with a user; the others lead to no status."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in MACHINE_EVENTS.items() for x in pair]), F.col("event_type"))
    at = F.timestamp_micros(_DAY_ZERO + 24 * (F.unix_micros(F.col("ts").cast("timestamp")) - _DAY_ZERO))
    override = F.when(kind == "STATUS_OVERRIDE", _pick(("CONTACTED", "ENGAGED", None), F.col("event_id")))
    return events.select(F.col("user_id").alias("relationship_id"), "event_id", F.coalesce(kind, F.lit("NOTE")).alias("event_type"), at.alias("occurred_at"), override.alias("override"))


SQL_MACHINE_EVENTS = f"""machine_events AS (
  SELECT user_id AS relationship_id, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MACHINE_EVENTS.items())} ELSE 'NOTE' END AS event_type,
         make_timestamp({_DAY_ZERO} + 24 * (epoch_us(ts) - {_DAY_ZERO})) AS occurred_at,
         CASE WHEN event_type = 'error' THEN {_pick_sql(('CONTACTED', 'ENGAGED', None), 'event_id')} END AS override
  FROM events)"""
