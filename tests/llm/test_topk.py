import math
import random

import numpy as np
import pytest

from synthscope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, dim int, `a.b` int"


def rows_of(seed, n, dim, copies=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(5)]
    out = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)]) for i in range(n)]
    out += [(10_000 + i, out[3][1]) for i in range(copies)]
    return out


def brute(rows, k, scale=64.0):
    """All products, of rows counted once."""
    rows = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and not any(x is None or not math.isfinite(np.float32(x)) for x in v)}
    whole = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows]
    out = []
    for q, a in whole:
        if q % 20 == 0:
            scored = sorted((-max(min(sum(x * y for x, y in zip(a, b)), 2**63 - 1), -(2**63)), i) for i, b in whole if i != q and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k=20, parts=3, **args):
    frame = spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in topk.top_k(frame.where("vec_id % 20 = 0"), frame, k, **args).collect())


def test_clusters_and_copies(spark):
    rows = rows_of(1, 700, 20, copies=300)
    assert found(spark, rows, sample=100) == brute(rows, 20)


def test_groups_and_blocks(spark):
    rows = rows_of(2, 600, 33)
    assert found(spark, rows, k=7, sample=60, chunk_rows=8, block_rows=100) == brute(rows, 7)


def test_awkward_rows(spark):
    rows = [*rows_of(3, 60, 5), (20, [0.1] * 4), (40, [float("nan")] * 5), (60, None), (80, [None, 1.0, 1.0, 1.0, 1.0]), (100, []), (101, []), (None, [0.5] * 5), (61, [float("inf")] * 5), (0, [0.1] * 5), (20, [0.1] * 4), (7, [0.25] * 5), (7, [0.25] * 5), (200, [1.0, 2.0]), (201, [2.0, 1.0])]
    assert found(spark, rows, k=20) == brute(rows, 20)


def test_large_numbers(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(0, 60) for _ in range(6)]) for i in range(60)] + [(i, [rng.random() * 5000 for _ in range(6)]) for i in range(60, 100)]
    assert found(spark, rows, k=20) == brute(rows, 20)


def test_few_rows(spark):
    assert found(spark, [], parts=1) == []
    assert found(spark, [(20, [1.0, 2.0])], parts=1) == []
    assert found(spark, [(20, [1.0, 2.0]), (3, [0.5, 0.5])], parts=1) == [(20, 1, 3, 64 * 32 + 128 * 32)]


@pytest.mark.parametrize("segments", topk.LEVELS)
def test_statistics_bound_products(segments):
    x = np.random.default_rng(1).normal(size=(60, 24)) * 50
    assert (topk.statistics(x, segments) @ topk.statistics(x, segments).T >= x @ x.T - 1e-6).all()
    finer = topk.statistics(x, 2 * segments)
    assert (finer @ finer.T <= topk.statistics(x, segments) @ topk.statistics(x, segments).T + 1e-6).all()


def test_bounds_leave_out_what_is_far(spark, monkeypatch):
    """Groups of queries get the candidates that their bounds allow, not all of them."""
    rng = np.random.default_rng(3)
    centres = np.kron(np.eye(8), np.ones(8))
    x = np.concatenate([c + rng.normal(size=(200, 64)) * 0.02 for c in centres])
    best = topk._Best([__import__("pyarrow").record_batch({"id": np.arange(0, 1600, 20), "no": np.arange(80), "tau": np.full(80, 64.0 * 64 * 7), "v": [np.floor(64 * v).astype("<i2").tobytes() for v in x[::20]]})], 64, 20)
    looked = []
    monkeypatch.setattr(best, "merge", lambda at, ids, x, able, exact: looked.append(able.sum()))
    best.add(np.arange(1600), __import__("pyarrow").array([np.floor(64 * v).astype("<i2").tobytes() for v in x]))
    assert 0 < sum(looked) < 0.2 * 80 * 1600
