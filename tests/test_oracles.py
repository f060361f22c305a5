"""Every query that has SQL gives the same rows in DuckDB on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from ledgerlark import registry
from ledgerlark.sources.fixtures import BASE

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = registry.queries()[name](spark, DATA)
    theirs = duck.sql(registry.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = sorted(tuple(map(value, r)) for r in ours.select(*(f"`{c}`" for c in columns)).collect())
    assert rows == sorted(tuple(map(value, r)) for r in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
