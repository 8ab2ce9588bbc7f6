"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the driver's tables aren't here")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(TABLES))
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    expected = [tuple(plain(r[i]) for i in at) for r in want.fetchall()]
    key = lambda row: [(v is None, str(v)) for v in row]
    assert sorted(rows, key=key) == sorted(expected, key=key)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
