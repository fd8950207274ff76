"""The registered text queries with SQL against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from synthscope.llm import queries

from ..test_queries import DATA, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rounded(data):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in data]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, rounded(got.collect())) == rows(names, rounded(want.fetchall()))
