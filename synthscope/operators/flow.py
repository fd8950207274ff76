"""Flow-matching generators of rows: fitted by Spark ML trees, drawn by the fitted models' own transforms.

Between noise z (time 0) and a row x (time 1) a point moves as (1 - t) z + t x with the
velocity x - z. Regressors learn the velocity at nt times; sampling starts from noise and
follows them upwards. Noise comes from hashes of row, copy and dimension, so a fit is the
same at any partitioning.

Trees look at a feature's bin only, so training rows are first counted by their bins: what is fitted
are cells (bins, mean velocity, number of rows as weight), whose number is bounded however many rows there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_normal, hash_unit
from ..sources.io import kept

#: Bins of a feature: as many as Spark's trees tell apart.
BINS = 32


def expand_pairs(rows: DataFrame, n_noise: int, nt: int, dims: int, seed: int = 0) -> DataFrame:
    """(id, noise, level, t, x_t, y, x_cond) for each row (id, x_target, x_cond), noise copy and time (level + 1) / nt."""
    copies = rows.select("id", "x_target", "x_cond", F.explode(F.sequence(F.lit(0), F.lit(n_noise - 1))).alias("noise"))
    z = F.array(*[hash_normal(seed, F.col("id"), F.col("noise"), F.lit(d)) for d in range(dims)])
    levels = copies.select("id", "noise", "x_target", "x_cond", z.alias("z"), F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("level")).withColumn("t", (F.col("level") + 1) / nt)
    at = F.zip_with("z", "x_target", lambda a, b: (1.0 - F.col("t")) * a + F.col("t") * b)
    return levels.select("id", "noise", "level", "t", at.alias("x_t"), F.zip_with("x_target", "z", lambda b, a: b - a).alias("y"), "x_cond")


def _noisy(rows: DataFrame, n_noise: int, dims: int, seed: int) -> DataFrame:
    """(x_target, x_cond, z): each row once a noise copy."""
    copies = rows.select("id", "x_target", "x_cond", F.explode(F.sequence(F.lit(0), F.lit(n_noise - 1))).alias("noise"))
    return copies.select("x_target", "x_cond", F.array(*[hash_normal(seed, F.col("id"), F.col("noise"), F.lit(d)) for d in range(dims)]).alias("z"))


def _between(d: int, level: int, nt: int) -> Column:
    t = (level + 1) / nt
    return (1.0 - t) * F.get("z", d) + t * F.get("x_target", d)


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _bin_batches(batches, starts: list[np.ndarray], designs: list[list[int]]):
    """Rows (f, y) once a design, with the bins of its columns as one key."""
    for b in batches:
        if not b.num_rows:
            continue
        f = _matrix(b.column(0), b.num_rows)
        bins = np.stack([np.searchsorted(s[1:], f[:, j], side="right").astype(np.uint8) for j, s in enumerate(starts)], axis=1)
        for k, own in enumerate(designs):
            key = np.ascontiguousarray(bins[:, own])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, k, np.int32)), pa.array(key.view(f"V{len(own)}").ravel().tolist(), pa.binary()), b.column(1)], ["design", "key", "y"])


def _rep_batches(batches, reps: list[np.ndarray], designs: list[list[int]]):
    """Cells (design, key, ...) with the values that stand for their bins."""
    for b in batches:
        x = [[float(reps[j][i]) for j, i in zip(designs[k], key, strict=True)] for k, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64())), b.column(2), b.column(3)], ["design", "x", "w", "y"])


def cells(rows: DataFrame, columns: Sequence[Column], labels: Sequence[Column], designs: list[list[int]]) -> DataFrame:
    """(design, x, w, y): rows counted by the bins of each design's columns, with their number and mean labels, stored.

    A column has up to ``BINS`` bins of about as many rows each (a bin a value, if it has no more values than that), and the
    middle of a bin stands for it. A squared loss knows of the rows of a bin only their number and mean, so trees lose nothing.
    """
    wide = rows.select(F.array(*columns).alias("f"), F.array(*labels).alias("y"))
    places = [i / (2 * BINS) for i in range(2 * BINS + 1)]
    ends = wide.agg(*[F.percentile_approx(F.get("f", j), places, 10_000).alias(f"q{j}") for j in range(len(columns))]).first()  # one row
    ends = [np.array(q or [0.0]) for q in ends]
    starts = [np.unique(q[:-1:2] if len(np.unique(q)) > BINS else q) for q in ends]
    inside = lambda q, s, i: q[(q >= s[i]) & (q < s[i + 1] if i + 1 < len(s) else True)]
    reps = [np.array([np.sort(own)[len(own) // 2] for own in (np.unique(inside(q, s, i)) for i in range(len(s)))]) for q, s in zip(ends, starts, strict=True)]
    binned = wide.mapInArrow(partial(_bin_batches, starts=starts, designs=designs), "design int, key binary, y array<double>")
    counted = binned.groupBy("design", "key").agg(F.count("*").cast("double").alias("w"), F.array(*[F.avg(F.get("y", d)) for d in range(len(labels))]).alias("y"))
    return kept(counted.mapInArrow(partial(_rep_batches, reps=reps, designs=designs), "design int, x array<double>, w double, y array<double>"))


def _fit_trees(cells: DataFrame, label: int, settings: dict) -> GBTRegressionModel:
    return GBTRegressor(weightCol="w", maxBins=BINS, **settings).fit(cells.select(array_to_vector("x").alias("features"), F.get("y", label).alias("label"), "w"))


def _predicted(rows: DataFrame, models: Sequence[GBTRegressionModel], features: Column, names: Sequence[str]) -> DataFrame:
    """``rows`` with a model's prediction a name, all from the same features."""
    rows = rows.withColumn("__features", array_to_vector(features))
    for model, name in zip(models, names, strict=True):
        rows = model.copy().setFeaturesCol("__features").setPredictionCol(name).transform(rows)
    return rows.drop("__features")


def _together(jobs: list, threads: int = 4) -> list:
    """Independent fits, a few at a time, each a Spark job of its own."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


SETTINGS = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.1, "seed": 0}


@dataclass
class JointFlow:
    """One regressor a time and dimension, on all dimensions and the condition."""

    nt: int = 3
    n_noise: int = 3
    seed: int = 0
    settings: dict = field(default_factory=lambda: dict(SETTINGS))
    models: list = field(default_factory=list)
    dims: int = 0

    def fit(self, rows: DataFrame) -> JointFlow:
        """From rows (id, x_target, x_cond)."""
        first = rows.select(F.size("x_target"), F.size("x_cond")).first()
        self.dims, n_cond = first
        rows = _noisy(kept(rows.select("id", "x_target", "x_cond")), self.n_noise, self.dims, self.seed)
        columns = [_between(d, k, self.nt) for k in range(self.nt) for d in range(self.dims)] + [F.get("x_cond", j) for j in range(n_cond)]
        velocity = [F.get("x_target", d) - F.get("z", d) for d in range(self.dims)]
        own = lambda k: [*range(k * self.dims, (k + 1) * self.dims), *range(self.nt * self.dims, len(columns))]
        data = cells(rows, columns, velocity, [own(k) for k in range(self.nt)])
        flat = _together([lambda k=k, d=d: _fit_trees(data.where(F.col("design") == k), d, self.settings) for k in range(self.nt) for d in range(self.dims)])
        self.models = [flat[k * self.dims : (k + 1) * self.dims] for k in range(self.nt)]
        return self

    def draw(self, rows: DataFrame) -> DataFrame:
        """``rows`` (z: noise, cond, ...) with ``x``, drawn by Euler steps of 1 / nt; the fitted models transform the rows where they are."""
        rows = rows.withColumn("x", F.col("z"))
        names = [f"__v{d}" for d in range(self.dims)]
        for level in self.models:
            rows = _predicted(rows, level, F.concat("x", "cond"), names)
            rows = rows.withColumn("x", F.array(*[F.get("x", d) + F.col(n) / self.nt for d, n in enumerate(names)])).drop(*names)
        return rows


@dataclass
class SequentialFlow:
    """A dimension at a time: each sees itself, the condition and the dimensions before it.

    Categorical dimensions (whole-number codes) are drawn from a multinomial logistic model
    of the condition and the dimensions before; one class only is a constant.
    """

    categorical: tuple[int, ...] = ()
    nt: int = 3
    n_noise: int = 3
    seed: int = 0
    solver: str = "rk4"
    settings: dict = field(default_factory=lambda: dict(SETTINGS))
    models: list = field(default_factory=list)
    dims: int = 0

    def fit(self, rows: DataFrame) -> SequentialFlow:
        self.dims, n_cond = rows.select(F.size("x_target"), F.size("x_cond")).first()
        base = kept(rows.select("id", "x_target", "x_cond"))
        follows = [(d, k) for d in range(self.dims) if d not in self.categorical for k in range(self.nt)]
        columns = [*[_between(d, k, self.nt) for d, k in follows], *[F.get("x_cond", j) for j in range(n_cond)], *[F.get("x_target", d) for d in range(self.dims)]]
        cond = list(range(len(follows), len(follows) + n_cond))
        before = lambda d: [len(follows) + n_cond + e for e in range(d)]
        jobs = []
        if follows:
            velocity = [F.get("x_target", d) - F.get("z", d) for d in range(self.dims)]
            data = cells(_noisy(base, self.n_noise, self.dims, self.seed), columns, velocity, [[i, *cond, *before(d)] for i, (d, _) in enumerate(follows)])
        for d in range(self.dims):
            if d in self.categorical:
                jobs.append(lambda d=d: self._classes(base, d))
            else:
                jobs += [lambda i=follows.index((d, k)), d=d: _fit_trees(data.where(F.col("design") == i), d, self.settings) for k in range(self.nt)]
        flat = iter(_together(jobs))
        self.models = [next(flat) if d in self.categorical else [next(flat) for _ in range(self.nt)] for d in range(self.dims)]
        return self

    def _classes(self, base: DataFrame, d: int):
        codes = sorted(r[0] for r in base.select(F.get("x_target", d)).distinct().collect())  # one row a class
        if len(codes) == 1:
            return codes, None
        local = F.array_position(F.array(*[F.lit(c) for c in codes]), F.get("x_target", d)) - 1
        features = F.concat("x_cond", F.slice("x_target", 1, d) if d else F.array().cast("array<double>"))
        counted = kept(base.groupBy(features.alias("x"), local.cast("double").alias("label")).agg(F.count("*").cast("double").alias("w")))  # equal rows are one, with their number as weight
        return codes, LogisticRegression(family="multinomial", regParam=0.01, maxIter=50, weightCol="w").fit(counted.select(array_to_vector("x").alias("features"), "label", "w"))

    def draw(self, rows: DataFrame) -> DataFrame:
        """``rows`` (z: noise, u: uniform draws, cond, ...) with ``x``, a dimension after the other."""
        rows = rows.withColumn("x", F.array().cast("array<double>"))
        for d, model in enumerate(self.models):
            rows = self._drawn_code(rows, d, *model) if d in self.categorical else self._followed(rows, d, model)
            rows = rows.withColumn("x", F.concat("x", F.array("__new"))).drop("__new")
        return rows

    def _drawn_code(self, rows: DataFrame, d: int, codes: list, model) -> DataFrame:
        if model is None:
            return rows.withColumn("__new", F.lit(float(codes[0])))
        rows = rows.withColumn("__features", array_to_vector(F.concat("cond", "x")))
        rows = model.copy().setFeaturesCol("__features").setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__said").transform(rows).withColumn("__q", vector_to_array("__p"))
        upto = lambda k: sum((F.get("__q", i) for i in range(k + 1)), F.lit(0.0))
        place = sum((F.when(upto(k) < F.get("u", d), 1).otherwise(0) for k in range(len(codes) - 1)), F.lit(0))
        return rows.withColumn("__new", F.get(F.array(*[F.lit(float(c)) for c in codes]), place)).drop("__features", "__p", "__q", "__raw", "__said")

    def _followed(self, rows: DataFrame, d: int, levels: list) -> DataFrame:
        """The flow of one dimension from its noise, by Runge-Kutta (or Euler) steps."""
        h, rows = 1.0 / self.nt, rows.withColumn("__new", F.get("z", d))

        def velocity(rows: DataFrame, k: int, at: Column, name: str) -> DataFrame:
            return _predicted(rows, [levels[min(k, self.nt - 1)]], F.concat(F.array(at), "cond", "x"), [name])

        for k in range(self.nt):
            rows = velocity(rows, k, F.col("__new"), "__a")
            if self.solver == "euler":
                rows = rows.withColumn("__new", F.col("__new") + h * F.col("__a")).drop("__a")
                continue
            rows = velocity(rows, k, F.col("__new") + h / 2 * F.col("__a"), "__b")
            rows = velocity(rows, k, F.col("__new") + h / 2 * F.col("__b"), "__c")
            rows = velocity(rows, k + 1, F.col("__new") + h * F.col("__c"), "__d")
            rows = rows.withColumn("__new", F.col("__new") + h / 6 * (F.col("__a") + 2 * F.col("__b") + 2 * F.col("__c") + F.col("__d"))).drop("__a", "__b", "__c", "__d")
        return rows


def flow_feature_types(kinds: Sequence[str], n_target: int) -> list[str]:
    """Kinds of target, then condition columns for a fit: targets carry noise, so they are numbers (``q``); conditions keep theirs."""
    if not 0 <= n_target <= len(kinds):
        raise ValueError(f"{len(kinds)} kinds for {n_target} targets")
    return ["q"] * n_target + list(kinds[n_target:])


def draw_labels(rows: DataFrame, counts: DataFrame, label: str, id_col: str, seed: int = 0) -> DataFrame:
    """``rows`` with a label each, drawn by a hash of the id in proportion to ``counts`` (label, count): one row a label. Without counts labels are null."""
    known = sorted((r[0], r[1]) for r in counts.select(label, "count").collect())
    if not known:
        return rows.withColumn(label, F.lit(None).cast(counts.schema[label].dataType))
    total, pick = sum(n for _, n in known), F.lit(known[-1][0])
    u = hash_unit(seed, F.col(id_col), F.lit("label"))
    for value, n in reversed(known[:-1]):
        upto = sum(m for v, m in known if v <= value)
        pick = F.when(u < upto / total, F.lit(value)).otherwise(pick)
    return rows.withColumn(label, pick)


GENERATORS = {"joint": JointFlow, "sequential": SequentialFlow}


def fit_label_conditional(rows: DataFrame, label: str, make=JointFlow) -> dict:
    """A generator a label value and the values' shares, from rows (id, x_target, x_cond, label)."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row a label
    total = sum(counts.values())
    return {v: (make().fit(rows.where(F.col(label) == v)), n / total) for v, n in sorted(counts.items())}
