"""Every query with SQL equals that SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if value is None or isinstance(value, (int, bool)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=str)
    assert got == want


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "title", "match_score", "opportunity_score"]
    assert entry.entry(spark).count() > 0


def test_scans_are_pruned_and_filtered(spark):
    plan = registry.queries()["stm08_overdue"](spark, SF)._jdf.queryExecution().toString()
    assert "o_totalprice" not in plan.split("Physical Plan")[1]
    plan = registry.queries()["snk05_delete_purge"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "LeftAnti" in plan
