"""Queries of funnels, effectiveness, state and streaks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import analytics, search, state
from millrace.plans import bindings as b
from millrace.session import shared_dir, table
from millrace.streaming import machine, relationships, snapshots

_R = "CASE WHEN {w} > 0 THEN floor(CAST({p} AS DOUBLE) / {w} * 1000 + 0.5) / 1000 ELSE 0.0 END"


def _rate(part: str, whole: str) -> str:
    return _R.format(p=part, w=whole)


def _in_range(df: DataFrame) -> DataFrame:
    return df.where(F.col("applied_date").between(F.lit("1995-01-01").cast("date"), F.lit("1997-12-31").cast("date")))


def agg01_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.outcome_funnel(_in_range(b.applications(spark, sf_dir)), b.outcomes(spark, sf_dir), b.STAGES)


def agg03_funnel_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = b.applications(spark, sf_dir).withColumn("interview_source", F.coalesce("interview_source", F.lit("APPLICATION")))
    return analytics.outcome_funnel(named, b.outcomes(spark, sf_dir), b.STAGES, by=["interview_source"])


_STEPS = ["applications", *b.STAGES]
_COUNTS = "count(DISTINCT application_id) AS applications, " + ", ".join(f"count(DISTINCT CASE WHEN stage = '{v}' THEN application_id END) AS {n}" for n, v in b.STAGES.items())
_RATES = ", ".join(f"{_rate(y, x)} AS {x}_to_{y}" for x, y in zip(_STEPS, _STEPS[1:], strict=False))


def _funnel_sql(extra: str = "", where: str = "") -> str:
    return f"WITH {b.APPLICATIONS}, {b.OUTCOMES}, c AS (SELECT {extra} {_COUNTS} FROM applications LEFT JOIN outcomes USING (application_id) {where} {'GROUP BY 1' if extra else ''}) SELECT *, {_RATES} FROM c"


def agg02_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.stage_gaps(b.applications(spark, sf_dir), b.outcomes(spark, sf_dir), b.STAGES)


_DAYS = ["applied_date", *b.STAGES]
GAPS = f"""WITH {b.APPLICATIONS}, {b.OUTCOMES}, f AS (SELECT application_id, {', '.join(f"min(CASE WHEN stage = '{v}' THEN occurred_at END) AS {n}" for n, v in b.STAGES.items())} FROM outcomes GROUP BY 1),
j AS (SELECT * FROM applications LEFT JOIN f USING (application_id))
SELECT {', '.join(f"coalesce(floor(avg(CASE WHEN date_diff('day', {x}, {y}) >= 0 THEN date_diff('day', {x}, {y}) END) * 10 + 0.5) / 10, 0.0) AS days_to_{y}" for x, y in zip(_DAYS, _DAYS[1:], strict=False))} FROM j"""


def agg04_status_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.status_funnel(b.applications(spark, sf_dir))


_STATUS = f"WITH {b.APPLICATIONS}, c AS (SELECT count(*) AS applied, count(*) FILTER (status IN ('PHONE_SCREEN', 'INTERVIEWING', 'OFFERED')) AS responded, count(*) FILTER (status IN ('INTERVIEWING', 'OFFERED')) AS interviewing, count(*) FILTER (status = 'OFFERED') AS offered, count(*) FILTER (status = 'REJECTED') AS rejected FROM applications) SELECT *, {', '.join(f'{_rate(n, "applied")} AS {n}_rate' for n in ('responded', 'interviewing', 'offered', 'rejected'))} FROM c"


def agg05_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive and negative outcomes by label, against scores from texts' lengths."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), "quality")
    scores = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), (F.col("n_chars") % 101).alias("overall_score"))
    return analytics.score_comparison(labels, scores, F.col("quality") == 1, F.col("quality") == 0)


SCORES = """SELECT floor(avg(n_chars % 101) FILTER (quality = 1) * 1000 + 0.5) / 1000 AS positive_mean, count(*) FILTER (quality = 1) AS positive_count, floor(avg(n_chars % 101) FILTER (quality = 0) * 1000 + 0.5) / 1000 AS negative_mean,
  count(*) FILTER (quality = 0) AS negative_count, min(n_chars % 101) FILTER (quality = 1) AS threshold FROM labels JOIN documents USING (doc_id)"""


def agg06_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of lines, every second of which is a rejection; some notes are blank."""
    n = F.col("l_linenumber")
    notes = F.when(n % 4 == 0, F.lit(" ")).when(F.col("l_returnflag") != "A", F.concat(F.lit(" Reason "), F.col("l_linestatus"), F.col("l_returnflag")))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("application_id"), F.when(n % 2 == 0, "REJECTED").otherwise("SCREEN").alias("stage"), notes.alias("notes"))
    return analytics.blockers(b.applications(spark, sf_dir), o)


def agg07_skill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 missing skills named most (a top-k report)."""
    from millrace.plans.decisions import sco01_match

    missing = sco01_match(spark, sf_dir).select(F.explode(F.split("missing", ",")).alias("skill")).where("skill <> ''")
    return analytics.frequencies(missing, F.lower("skill"), "skill", 15)


def agg09_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.jobs(spark, sf_dir).groupBy(F.coalesce("company", F.lit("UNKNOWN")).alias("company"), F.coalesce("remote", F.lit("UNKNOWN")).alias("remote")).agg(F.count("*").alias("n"))


def agg10_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.effectiveness(b.messages(spark, sf_dir), F.coalesce("template_used", F.lit("no_template")), "template")


def agg10_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.effectiveness(b.messages(spark, sf_dir), F.coalesce("channel", F.lit("UNKNOWN")), "channel")


def _effect_sql(key: str, name: str) -> str:
    return f"WITH {b.MESSAGES}, c AS (SELECT {key} AS {name}, count(*) AS sent, count(*) FILTER (replied) AS replies, count(*) FILTER (replied AND message_type IN ('REFERRAL', 'RECRUITER')) AS signals FROM messages WHERE direction = 'OUT' GROUP BY 1) SELECT *, {_rate('replies', 'sent')} AS reply_rate, {_rate('signals', 'sent')} AS signal_rate FROM c"


def agg11_source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_quality(b.companies(spark, sf_dir))


def agg13_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hiring_velocity(b.companies(spark, sf_dir), b.jobs(spark, sf_dir), F.lit("2024-03-01").cast("date"))


def agg18_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.jobs(spark, sf_dir).where(search.visible() & F.col("company").isNotNull()).select("company").distinct().orderBy("company")


def prj01_top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five required skills of a posting, from parts on orders."""
    return search.top_skills(_skills(spark, sf_dir))


def prj03_tech_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.skills_by_category(_skills(spark, sf_dir), ["A", "N", "R"])


def _skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("s"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("skill_name"), F.col("l_returnflag").alias("category"), (F.col("l_linestatus") == "O").alias("is_required"))


_SKILLS = "skills AS (SELECT l_orderkey AS job_id, 's' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS skill_name, l_returnflag AS category, l_linestatus = 'O' AS is_required FROM lineitem)"


def join02_without_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs that no label scores (anti), and how many are scored (semi), by source."""
    j, labels = b.jobs(spark, sf_dir).where("is_active"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    none = j.join(labels, "id", "left_anti").groupBy("source").agg(F.count("*").alias("unscored"))
    some = j.join(labels, "id", "left_semi").groupBy("source").agg(F.count("*").alias("scored"))
    return none.join(some, "source", "full_outer").select("source", F.coalesce("unscored", F.lit(0).cast("long")).alias("unscored"), F.coalesce("scored", F.lit(0).cast("long")).alias("scored"))


def join15_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without an order and orders without a customer."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    lines = li.join(o, li.l_orderkey == o.o_orderkey, "left_anti").agg(F.count("*").alias("lines"))
    orders = o.join(c, o.o_custkey == c.c_custkey, "left_anti").agg(F.count("*").alias("orders"))
    return lines.crossJoin(orders)  # one row each


def win05_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error streaks of users' events as crawls."""
    kind = F.when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type").isin("error", "view"), "ERROR").otherwise("RATE_LIMITED")
    crawls = table(spark, sf_dir, "events").select(F.col("event_id").alias("crawl_id"), F.col("user_id").alias("endpoint_id"), F.col("ts").alias("crawled_at"), kind.alias("status"))
    return state.error_streaks(crawls).select("crawl_id", "streak", "deactivated")


STREAKS = """WITH c AS (SELECT event_id, user_id, ts, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, count(*) FILTER (event_type IN ('error', 'view')) OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS streak FROM c) SELECT event_id AS crawl_id, streak, streak >= 10 AS deactivated FROM s"""


def win07_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.replay(b.relationship_events(table(spark, sf_dir, "events")))


_MAP = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in state.TRANSITIONS.items())
REPLAY = f"""replayed AS (SELECT relationship_id, coalesce(arg_max(CASE event_type {_MAP} END, (occurred_at, event_id)) FILTER (CASE event_type {_MAP} END IS NOT NULL), 'DISCOVERED') AS status,
  max(occurred_at) FILTER (event_type = 'MESSAGE_SENT') AS last_contact_at, max(occurred_at) FILTER (event_type = 'REPLIED') AS last_reply_at, count(*) AS events FROM relationship_events GROUP BY 1)"""


def stm04_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.ghosts(win07_replay(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).select("relationship_id", "last_contact_at")


def stm08_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("scheduled_date"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("SENT").alias("status"))
    return state.overdue(o, F.lit("1997-01-01").cast("date")).groupBy("status").agg(F.count("*").alias("n"))


def stm03_stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each relationship from a stream of its events, run to the end of what is there."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = relationships.run_available(relationships.latest_status(b.relationship_events(events)), f"{base}/out", f"{base}/log", "complete")
    query.awaitTermination()
    return snapshots.read(spark, f"{base}/out")


def stm02_stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and kind of event once a stream's day of delay, by the first event: counted by kind."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumns({"day": F.to_date("ts"), "ts": F.col("ts").cast("timestamp")})
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    once = relationships.once_per_key(events, ["user_id", "event_type", "day"], "ts", "1 day")
    relationships.run_available(once.select("user_id", "event_type", "day"), f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def stm03_stream_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of relationships from a stream of their events, with the ghosts that its timers emit, run to the end of what is
    there."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = machine.settled(b.machine_events(events), "0 seconds")
    relationships.run_available(log, f"{base}/out", f"{base}/log").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{base}/out").withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


def stm04_ghosted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in one batch."""
    events = b.machine_events(table(spark, sf_dir, "events"))
    end = events.where(state.transition(F.col("event_type"), F.col("override")).isNotNull()).agg(F.max("occurred_at").alias("t")).first()["t"]
    out = state.ghosted_log(events, F.date_trunc("millisecond", F.lit(end).cast("timestamp")))
    return out.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))


_LED = "CASE event_type WHEN 'MESSAGE_SENT' THEN 'CONTACTED' WHEN 'REPLIED' THEN 'REPLIED' WHEN 'STATUS_OVERRIDE' THEN override END"
GHOSTED = f"""WITH {b.SQL_MACHINE_EVENTS}, led AS (SELECT *, {_LED} AS status FROM machine_events WHERE {_LED} IS NOT NULL),
seen AS (SELECT *, max(occurred_at) FILTER (event_type = 'MESSAGE_SENT') OVER o AS m, max(occurred_at) FILTER (event_type = 'REPLIED') OVER o AS r,
    lead(occurred_at) OVER (PARTITION BY relationship_id ORDER BY occurred_at, event_id) AS after FROM led
  WINDOW o AS (PARTITION BY relationship_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT *, greatest(occurred_at, m + INTERVAL 14 DAY) AS silent_until FROM seen)
SELECT relationship_id, event_id, event_type, occurred_at, status FROM led
UNION ALL SELECT relationship_id, NULL, 'GHOSTED_AUTO', silent_until, 'GHOSTED' FROM ends
WHERE status = 'CONTACTED' AND m IS NOT NULL AND (r IS NULL OR r < m) AND (after IS NULL OR silent_until < after)
  AND date_trunc('milliseconds', silent_until) <= (SELECT date_trunc('milliseconds', max(occurred_at)) FROM led)"""


def stm01_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the events as they come, one at a time: the second finds nothing new and publishes nothing. Statuses with
    the number of the version that readers see."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for _ in range(2):
        with snapshots.single_flight(spark, f"{base}/out"):
            events = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
            snapshots.run(relationships.latest_status(b.relationship_events(events)), f"{base}/out", f"{base}/log").awaitTermination()
    seen = snapshots.current(spark, f"{base}/out")
    return snapshots.read(spark, f"{base}/out").groupBy("status").agg(F.count("*").alias("n"), F.sum("events").alias("events")).withColumn("version", F.lit(seen))


def snk02_run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two runs over all postings by the name of their source: the second knows the active ones only, and one
    source not at all; repeated, it changes nothing."""
    base = f"{shared_dir(spark)}/stats-{uuid.uuid4().hex}"
    stats = lambda rows: rows.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("rows"), F.sum(F.length("description")).alias("chars"))
    j = b.jobs(spark, sf_dir)
    second = stats(j.where("is_active AND source <> 'src1'")).withColumn("chars", F.when(F.col("name") != "src2", F.col("chars")))
    for batch, rows in ((1, stats(j)), (2, second), (2, stats(j))):
        snapshots.record_run(rows, base, batch)
    return snapshots.read(spark, base)


QUERIES = {f.__name__: f for f in (stm01_incremental, snk02_run_stats, stm02_stream_once, stm03_stream_machine, stm04_ghosted_log, stm03_stream_status, agg01_funnel, agg02_gaps, agg03_funnel_by_source, agg04_status_funnel, agg05_scores, agg06_blockers, agg07_skill_gaps, agg09_counts, agg10_templates, agg10_channels, agg11_source_quality, agg13_velocity, agg18_company_names, prj01_top_skills, prj03_tech_stack, join02_without_score, join15_orphans, win05_streaks, win07_replay, stm04_ghosts, stm08_overdue)}


def sql() -> dict[str, str]:
    from millrace.plans.decisions import MATCHES

    return {
        "agg01_funnel": _funnel_sql(where="WHERE applied_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'"),
        "agg03_funnel_by_source": _funnel_sql("coalesce(interview_source, 'APPLICATION') AS interview_source,"),
        "agg02_gaps": GAPS,
        "agg04_status_funnel": _STATUS,
        "agg05_scores": SCORES,
        "agg06_blockers": f"WITH {b.APPLICATIONS} SELECT lower('Reason ' || l_linestatus || l_returnflag) AS reason, count(*) AS n FROM lineitem JOIN applications ON application_id = l_orderkey WHERE status = 'REJECTED' AND l_linenumber % 4 = 2 AND l_returnflag <> 'A' GROUP BY 1",
        "agg07_skill_gaps": f"WITH {b.JOBS}, {MATCHES} SELECT lower(s) AS skill, count(*) AS n FROM (SELECT unnest(missing) AS s FROM matches) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
        "agg09_counts": f"WITH {b.JOBS} SELECT coalesce(company, 'UNKNOWN') AS company, coalesce(remote, 'UNKNOWN') AS remote, count(*) AS n FROM jobs GROUP BY 1, 2",
        "agg10_templates": _effect_sql("coalesce(template_used, 'no_template')", "template"),
        "agg10_channels": _effect_sql("coalesce(channel, 'UNKNOWN')", "channel"),
        "agg11_source_quality": f"WITH {b.SQL_COMPANIES}, c AS (SELECT discovered_via, CAST(sum(total_applications) AS BIGINT) AS applications, CAST(sum(total_interviews) AS BIGINT) AS interviews FROM companies GROUP BY 1) SELECT *, {_rate('interviews', 'applications')} AS quality FROM c",
        "agg13_velocity": f"WITH {b.JOBS}, {b.SQL_COMPANIES} SELECT c.company_id, count(j.id) AS velocity FROM companies c LEFT JOIN jobs j ON j.company_id = c.company_id AND j.is_active AND j.discovered_date >= DATE '2024-03-01' - 30 WHERE c.is_active GROUP BY 1",
        "agg18_company_names": f"WITH {b.JOBS} SELECT DISTINCT company FROM jobs WHERE is_active AND NOT applied AND NOT hidden AND decision = 'KEEP' AND company IS NOT NULL",
        "prj01_top_skills": f"WITH {_SKILLS}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY skill_name) AS r FROM skills WHERE is_required) SELECT job_id, string_agg(skill_name, ',' ORDER BY skill_name) AS top_skills FROM r WHERE r <= 5 GROUP BY 1",
        "prj03_tech_stack": f"WITH {_SKILLS} SELECT job_id, {', '.join(f"coalesce(array_to_string(list_sort(list(DISTINCT skill_name) FILTER (category = '{c}')), ','), '') AS {c.lower()}" for c in 'ANR')} FROM skills GROUP BY 1",
        "join02_without_score": f"WITH {b.JOBS} SELECT source, count(*) FILTER (id NOT IN (SELECT doc_id FROM labels)) AS unscored, count(*) FILTER (id IN (SELECT doc_id FROM labels)) AS scored FROM jobs WHERE is_active GROUP BY 1",
        "join15_orphans": "SELECT (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS lines, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS orders",
        "stm02_stream_once": "SELECT event_type, count(DISTINCT (user_id, CAST(ts AS DATE))) AS n FROM events GROUP BY 1",
        "stm03_stream_status": f"WITH {b.RELATIONSHIP_EVENTS}, {REPLAY} SELECT relationship_id, status, events FROM replayed",
        "stm01_incremental": f"WITH {b.RELATIONSHIP_EVENTS}, {REPLAY} SELECT status, count(*) AS n, CAST(sum(events) AS BIGINT) AS events, 0 AS version FROM replayed GROUP BY 1",
        "snk02_run_stats": f"WITH {b.JOBS}, o AS (SELECT source AS name, count(*) AS rows, sum(length(description)) AS chars FROM jobs GROUP BY 1), n AS (SELECT source AS name, count(*) AS rows, sum(length(description)) AS chars FROM jobs WHERE is_active AND source <> 'src1' GROUP BY 1) SELECT o.name, CAST(coalesce(n.rows, o.rows) AS BIGINT) AS rows, CAST(CASE WHEN o.name = 'src2' OR n.chars IS NULL THEN o.chars ELSE n.chars END AS BIGINT) AS chars FROM o LEFT JOIN n ON n.name = o.name",
        "stm03_stream_machine": GHOSTED,
        "stm04_ghosted_log": GHOSTED,
        "win05_streaks": STREAKS,
        "win07_replay": f"WITH {b.RELATIONSHIP_EVENTS}, {REPLAY} SELECT * FROM replayed",
        "stm04_ghosts": f"WITH {b.RELATIONSHIP_EVENTS}, {REPLAY} SELECT relationship_id, last_contact_at FROM replayed WHERE status = 'CONTACTED' AND last_contact_at < TIMESTAMP '2024-01-25' - INTERVAL 14 DAY AND (last_reply_at IS NULL OR last_reply_at < last_contact_at)",
        "stm08_overdue": "SELECT CASE WHEN o_orderstatus <> 'O' THEN 'SENT' WHEN CAST(o_orderdate AS DATE) < DATE '1997-01-01' THEN 'OVERDUE' ELSE 'PENDING' END AS status, count(*) AS n FROM orders GROUP BY 1",
    }
