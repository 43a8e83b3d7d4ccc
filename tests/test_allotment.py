"""Daily allotments against a plain scan of days."""

import datetime
import random

import pytest

from millrace.operators import allotment
from pyspark.sql import functions as F

SCHEMA = "id int, gate string, day date, contact int, rank int"


def drawn(seed, n, days=30, hot=True):
    draw = random.Random(seed)
    first = datetime.date(2024, 1, 1)
    return [(k, draw.choice(["a", "b", None]), None if k % 97 == 0 else first + datetime.timedelta(days=draw.randrange(days)), None if k % 41 == 0 else 7 if hot and k % 3 == 0 else draw.randrange(40), draw.randrange(5)) for k in range(n)]


def scanned(rows, limit, cooldown):
    out = {}
    for gate in {r[1] for r in rows}:
        last = {}
        for day in sorted({r[2] for r in rows if r[1] == gate and r[2]}):
            left = limit
            for k, _, _, contact, _ in sorted((r for r in rows if r[1] == gate and r[2] == day), key=lambda r: (r[4], r[0])):
                who = ("own", k) if contact is None else contact
                if who in last and ((day - last[who]).days < cooldown or day == last[who]):
                    out[k] = "closed"
                elif left:
                    left -= 1
                    last[who], out[k] = day, "passed"
                else:
                    out[k] = "limit"
    return out


@pytest.mark.parametrize(("limit", "cooldown"), [(2, 7), (5, 1), (1, 30), (3, 0)])
def test_equals_a_scan_of_days(spark, limit, cooldown):
    rows = drawn(limit * 31 + cooldown, 900)
    found = allotment.allot(spark.createDataFrame(rows, SCHEMA), "gate", "contact", ["rank", "id"], limit, cooldown).collect()
    assert len(found) == len(rows)
    assert {r["id"]: r["outcome"] for r in found if r["outcome"]} == scanned(rows, limit, cooldown)
    assert {r["id"] for r in found if r["outcome"] is None} == {r[0] for r in rows if r[2] is None}


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = allotment.allot(df, "gate", "contact", ["rank", "id"])
    assert out.columns == [*df.columns, "outcome"] and out.count() == 0


def test_replies(spark):
    said = ["yes", " YES \n", "no", "No.", "", None, "unclear"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string")
    found = [tuple(r["v"])[:2] for r in rows.orderBy("k").select(allotment.question_verdict(F.col("s")).alias("v")).collect()]
    assert found == [("CONFIRMED", 0.7)] * 2 + [("REJECTED", 0.7)] + [("UNKNOWN", 0.0)] * 4
    asked = spark.createDataFrame([(k, datetime.date(2024, 1, k % 2 + 1), "yes") for k in range(10)], "id int, day date, reply string")
    assert {r["id"] for r in allotment.ask_by_day(asked, ["id"], "reply", limit=2).where("visa = 'CONFIRMED'").collect()} == {0, 1, 2, 3}
    assert allotment.ask_by_day(asked, ["id"], "reply", enabled=False).where("reason = 'not asked'").count() == 10
