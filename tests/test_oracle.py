"""Queries against their SQL in DuckDB, on the smallest tables."""

import datetime
from decimal import Decimal
from pathlib import Path

import pytest

from tidemark.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, Decimal)) or isinstance(v, int) and abs(v) < 2**50:
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(registry.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    expected = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(1).count() == 1
