import os
import random

import pytest
from pyspark.sql import functions as F

from synthscope.llm import mixing

from .conftest import documents


def slow_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in names if s not in fixed)
        target = {s: rest * weight[s] / w for s in names if s not in fixed}
        over = [s for s in target if target[s] > most * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 70}, {"x": 7}, {"a": 0, "b": 9}, {f"s{i:02}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")).collect()}
    assert got == pytest.approx(slow_targets(sizes))


def test_plan(docs):
    rows = documents()
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    totals = {}
    for r in rows:
        totals[r[3]] = totals.get(r[3], 0) + size(r[1])
    target = slow_targets(totals)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == totals[r["source"]]
        rate = target[r["source"]] / totals[r["source"]]
        assert r["copies"] in (int(rate), int(rate) + 1) and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_plan(docs.repartition(3)).collect()))


def test_mix_follows_plan(docs, no_docs):
    plan = {}
    for r in mixing.mix_plan(docs).collect():
        plan[r["doc_id"]] = plan.get(r["doc_id"], 0) + r["copies"]
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {d: n for d, n in plan.items() if n}
    assert mixing.mix_plan(no_docs).collect() == [] and mixing.mix_sources(no_docs).collect() == []


def missed(plan):
    """By source: words taken, target, size of the largest document."""
    return [(r["taken"], r["target"], r["most"]) for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()]


def test_targets_are_met(spark):
    """Within the largest document of each source, and within a thousandth in large ones."""
    rng = random.Random(3)
    few = [(i, "w " * int(1 + rng.paretovariate(0.8)), f"few{i % 40}") for i in range(400)]
    many = [(1000 + i, "w " * (1 + i % 50), f"many{i % 2}") for i in range(30000)]
    got = missed(mixing.mix_plan(spark.createDataFrame(few + many, "doc_id long, text string, source string")))
    assert len(got) == 42
    for taken, target, most in got:
        assert abs(taken - target) <= max(most, 0.001 * target)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_targets_are_met_in_the_given_table(spark):
    for taken, target, most in missed(mixing.mix_plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))):
        assert abs(taken - target) <= most


def test_clashing_names(docs):
    frame = docs.withColumn("copy", F.lit(9)).withColumn("rate", F.lit(1)).withColumn("__rate", F.lit(1)).withColumn("coin", F.lit(1))
    mixed = mixing.mix_sources(frame)
    assert mixed.columns == [*[c for c in frame.columns if c != "copy"], "copy"]
    assert mixed.count() == mixing.mix_sources(docs).count()


def test_rows_without_an_id_toss_their_own_coins(spark):
    rows = [(None, f"text number {i}", "a") for i in range(400)] + [(i, "one two three", "b") for i in range(100)]
    copies = {r["copies"] for r in mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 1.0)).where("source = 'a'").collect()}
    assert len(copies) == 2


def test_long_text(spark):
    frame = spark.createDataFrame([(1, "word " * 1_000_000, "a"), (2, "word", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mixing.mix_plan(frame).collect()} == {1: 1_000_000, 2: 1}
