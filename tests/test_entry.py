"""Every registered query runs, has a stable schema and, where it has SQL, equals it (smallest tables)."""

import os
import re
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.sql("SET timezone = 'UTC'")
    for name in os.listdir(DATA):
        connection.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return connection


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(result.columns)
    order = sorted(df.columns)
    got = Counter(tuple(plain(row[c]) for c in order) for row in df.collect())
    at = [result.columns.index(c) for c in order]
    want = Counter(tuple(plain(row[k]) for k in at) for row in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not re.match(r"p\d+_", n)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]
