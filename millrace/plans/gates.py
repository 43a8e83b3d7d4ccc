"""Queries of daily allotments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import allotment
from millrace.plans import bindings as b
from millrace.session import table


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as wishes to connect with a user, by kind and day; the larger value comes first."""
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), "event_type", "user_id", (-F.col("value")).alias("worst"))


def sco17_allotment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five connections a day of each kind, no user twice within a week."""
    return allotment.allot(_requests(spark, sf_dir), "event_type", "user_id", ["worst", "event_id"]).select("event_id", "outcome")


def flt08_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's first postings are asked about; the first word of a whole text stands for the model's reply."""
    k = F.col("id")
    reply = F.when(k % 5 == 0, " Yes\n").when(k % 5 == 1, "NO").when(k % 5 == 2, " ").when(k % 5 == 3, F.concat(F.lit("maybe "), F.length("description")))
    rows = b.jobs(spark, sf_dir).select("id", F.col("discovered_date").alias("day"), F.length("description").alias("n"), reply.alias("reply"))
    return allotment.ask_by_day(rows, ["n", "id"], "reply", limit=4).select("id", "visa", "confidence", "reason")


QUERIES = {f.__name__: f for f in (sco17_allotment, flt08_questions)}
SQL = {
    "sco17_allotment": """WITH RECURSIVE c AS (SELECT event_type, CAST(ts AS DATE) AS day, user_id, min(ROW(-value, event_id)) AS first FROM events GROUP BY ALL),
days AS (SELECT event_type, day, list(user_id ORDER BY first) AS users, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM c GROUP BY event_type, day),
s AS (
  SELECT event_type, n, day, list_slice(users, 1, 5) AS picks, list_transform(list_slice(users, 1, 5), lambda u: {'u': u, 'd': day}) AS closed FROM days WHERE n = 1
  UNION ALL SELECT event_type, n, day, picks, list_concat(still, list_transform(picks, lambda u: {'u': u, 'd': day})) FROM (
    SELECT *, list_slice(list_filter(users, lambda u: NOT list_contains(list_transform(still, lambda x: x.u), u)), 1, 5) AS picks FROM (
      SELECT days.event_type, days.n, days.day, days.users, list_filter(s.closed, lambda x: days.day - x.d < 7) AS still FROM s JOIN days ON days.event_type = s.event_type AND days.n = s.n + 1) a) b),
p AS (SELECT event_type, day, unnest(picks) AS user_id FROM s),
e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, user_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), user_id ORDER BY -value, event_id) AS nth FROM events)
SELECT e.event_id, CASE WHEN max(p.day) IS NULL THEN 'limit' WHEN max(p.day) = e.day AND e.nth = 1 THEN 'passed' ELSE 'closed' END AS outcome
FROM e LEFT JOIN p ON p.event_type = e.event_type AND p.user_id = e.user_id AND p.day <= e.day AND e.day - p.day < 7 GROUP BY e.event_id, e.day, e.nth""",
    "flt08_questions": f"""WITH {b.JOBS}, r AS (SELECT id, id % 5 AS k, length(description) AS n, row_number() OVER (PARTITION BY discovered_date ORDER BY length(description), id) AS nth FROM jobs)
SELECT id, CASE WHEN nth <= 4 AND k = 0 THEN 'CONFIRMED' WHEN nth <= 4 AND k = 1 THEN 'REJECTED' ELSE 'UNKNOWN' END AS visa, CASE WHEN nth <= 4 AND k < 2 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence,
  CASE WHEN nth > 4 THEN 'daily limit reached' WHEN k = 0 THEN 'the model found sponsorship' WHEN k = 1 THEN 'the model found none' WHEN k = 3 THEN 'unclear reply: maybe ' || n ELSE 'no reply' END AS reason FROM r""",
}
