"""The numbered queries that have SQL give the same rows in DuckDB on the smallest tables."""

import os

import pytest

from ledgerlark.llm import queries
from tests.test_oracles import DATA, duck, value  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):  # noqa: F811
    ours, theirs = queries.queries()[name](spark, DATA), duck.sql(queries.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = sorted(tuple(map(value, r)) for r in ours.select(*columns).collect())
    assert rows == sorted(tuple(map(value, r)) for r in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
