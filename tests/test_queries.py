"""Every registered table query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from synthscope.plans import queries, queries_columns, queries_fits, queries_reports  # noqa: F401  they register theirs too

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_is_known():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_sequences_keep_every_line(spark, duck, monkeypatch):
    lengths, vectorise = [], queries.utility.vectorise
    monkeypatch.setattr(queries.utility, "vectorise", lambda seqs, n, width: lengths.append(n) or vectorise(seqs, n, width))
    assert queries.QUERIES["sequence_utility"](spark, DATA).count() == 2
    assert set(lengths) == {duck.execute("SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)").fetchone()[0]}


def test_joint_rollout_takes_the_default_steps(spark, duck):
    got = queries.QUERIES["joint_rollout"](spark, DATA).groupBy("id").count().collect()
    assert len(got) == duck.execute("SELECT count(*) FROM customer").fetchone()[0]
    assert {r["count"] for r in got} == {48}
