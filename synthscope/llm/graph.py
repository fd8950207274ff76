"""Connected components over an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that one task contracts by itself.
TASK_EDGES = 250_000


def _forest(batches):
    """Edges of a task as stars: each of its nodes with the least node that it reaches within the task."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in root if (r := find(x)) != x]
    for at in range(0, len(pairs), 50_000):
        part = pairs[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], kind) for k in (0, 1)], names=["a", "b"])


def _minimum_star(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v): each u with the least of itself and its v."""
    return pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    stars = both.join(_minimum_star(both), "u").where("v > u")
    return stars.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = _minimum_star(down)
    stars = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return stars.union(low.select("u", "m")).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of one ordered type -> (node, root): every node that has an edge, with
    the least node that it reaches.

    Tasks first contract blocks of edges to spanning stars, so dense groups become sparse
    before anything is joined. After that groups are only ever reduced by ``min`` (combined
    before the shuffle) and joined back, so a hub is split like any skewed join key; the
    state after each round is a stored table. Rounds grow with the logarithm of the largest
    component. Nulls and self-loops are no edges; no edges give no rows.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select("a", "b"))
    blocks = -(-now.count() // TASK_EDGES)
    now = stored(now.coalesce(max(1, blocks)).mapInArrow(_forest, now.schema))
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = stored(_small_star(_large_star(now)))
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(now.select("b", "b").distinct())
