"""Drawing synthetic rows and trajectories from fitted generators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_normal, hash_unit, round_clip
from ..sources.io import scratch_folder

START = -1.0


def _with_noise(rows: DataFrame, dims: int, seed: int, step: int) -> DataFrame:
    """Normal and uniform draws by row, step and dimension, from hashes."""
    draws = lambda f: F.array(*[f(seed, F.col("id"), F.lit(step), F.lit(d)) for d in range(dims)])
    return rows.withColumn("z", draws(hash_normal)).withColumn("u", draws(hash_unit))


def sample(model, conditions: DataFrame, seed: int = 0) -> DataFrame:
    """(id, x): a drawn row for each row (id, x_cond)."""
    rows = conditions.select(F.col("id").cast("long").alias("id"), F.col("x_cond").alias("cond"))
    return model.draw(_with_noise(rows, model.dims, seed, 0)).select("id", "x")


def rollout(model, subjects: DataFrame, steps: int = 48, seed: int = 0, stop: int | None = None, threshold: float = 0.5, feedback: Sequence[int] | None = None) -> DataFrame:
    """(id, step, x, x_cond) of trajectories for subjects (id, x_static[, start][, first]).

    The condition of a step is the static part and the fed-back dimensions of the step before
    (-1, or ``start`` where given, at step 0). Where ``first`` is given, it is the state of step 0 itself,
    which is drawn otherwise. With ``stop``, a trajectory ends after the step where that dimension passes the
    threshold, so each step works on the subjects that are still there. A step is a stored table that
    the next one starts from, so the plan does not grow with the number of steps and a lost executor costs one step.
    """
    spark = subjects.sparkSession
    back = list(range(model.dims)) if feedback is None else list(feedback)
    begin = F.array(*[F.lit(START)] * len(back))
    lag = F.coalesce("start", begin) if "start" in subjects.columns else begin
    first = F.col("first") if "first" in subjects.columns else F.lit(None)
    state = subjects.select(F.col("id").cast("long").alias("id"), "x_static", lag.alias("lag"), first.cast("array<double>").alias("first"))
    state = state.repartition(spark.sparkContext.defaultParallelism, "id")  # a small table is one task's read, but its steps are work for all
    folder, paths = scratch_folder(spark), []
    for t in range(steps):
        if stop is not None and state.isEmpty():
            break
        given = ["first"] if t == 0 else []
        rows = _with_noise(state.select("id", "x_static", F.concat("x_static", "lag").alias("cond"), *given), model.dims, seed, t)
        paths.append(f"{folder}/step-{t}")
        drawn = model.draw(rows)
        x = F.coalesce("first", "x") if given else F.col("x")
        drawn.select("id", F.lit(t).alias("step"), x.alias("x"), F.col("cond").alias("x_cond"), "x_static").write.parquet(paths[-1])
        now = spark.read.parquet(paths[-1])
        live = now if stop is None else now.where(~(F.get("x", stop) > threshold))
        state = live.select("id", "x_static", F.array(*[F.get("x", d) for d in back]).alias("lag"))
    return spark.read.schema("id long, step int, x array<double>, x_cond array<double>").parquet(*paths)


def sample_trajectories(model, subjects: DataFrame, steps: int = 48, start: str = "random", seed: int = 0, stop: int | None = None, threshold: float = 0.5) -> DataFrame:
    """(id, step, x, last) of trajectories of varying lengths for subjects (id, x_static[, first]).

    The state of step 0 is drawn (``random``), all zeros (``zero``), or the subject's own ``first``
    (``given``; drawn where that is null). ``last`` marks a trajectory's end: ``stop`` passed the threshold, or all steps were taken.
    """
    if start not in ("random", "zero", "given"):
        raise ValueError(f"unknown start {start!r}")
    first = F.col("first") if start == "given" else F.array(*[F.lit(0.0)] * model.dims) if start == "zero" else F.lit(None)
    rows = rollout(model, subjects.select("id", "x_static", first.alias("first")), steps, seed, stop, threshold)
    ended = F.lit(False) if stop is None else F.coalesce(F.get("x", stop) > threshold, F.lit(False))
    return rows.select("id", "step", "x", (ended | (F.col("step") == steps - 1)).alias("last"))


def unconditional_to_trajectories(rows: DataFrame, n_subjects: int, names: Sequence[str]) -> DataFrame:
    """Rows (id 0..n-1, names) as trajectories: subject = id mod n, hour = id div n, lags from the hour before (-1 at first)."""
    w = W.partitionBy("subject_id").orderBy("hours_in")
    placed = rows.select((F.col("id") % n_subjects).alias("subject_id"), F.floor(F.col("id") / n_subjects).cast("int").alias("hours_in"), *names)
    return placed.select("*", *[F.coalesce(F.lag(c).over(w).cast("double"), F.lit(START)).alias(f"{c}_lag1") for c in names])


def marginal_rows(df: DataFrame, n: int, names: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows of independent draws from each column's values, at hashed quantiles."""
    table = df.agg(*[F.percentile_approx(F.col(c).cast("double"), F.lit([i / 256 for i in range(257)]), 10000).alias(f"q_{c}") for c in names])
    pick = lambda c: F.get(F.col(f"q_{c}"), F.floor(hash_unit(seed, F.col("id"), F.lit(c)) * 257).cast("int")).alias(c)
    return df.sparkSession.range(n).crossJoin(F.broadcast(table)).select("id", *[pick(c) for c in names])  # one row of quantiles


def create_flat_dataframe(spark: SparkSession, rows: DataFrame, encoder, target: Sequence[str], condition: Sequence[str], keep: Sequence[str] = ("id", "step")) -> DataFrame:
    """Decoded table of (x, x_cond) arrays: values placed by name, texts and whole numbers restored, binaries 0 or 1."""
    wide = rows.select(*keep, *[F.get("x", i).alias(c) for i, c in enumerate(target)], *[F.get("x_cond", i).alias(c) for i, c in enumerate(condition)])
    out = encoder.inverse_transform(wide, keep)
    return out.select(*[round_clip(F.col(f"`{c}`")).alias(c) if c in encoder.binary else F.col(f"`{c}`") for c in out.columns])


def hour0_to_conditions(df: DataFrame, targets: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """First states as conditions: statics stay, a target's value becomes its ``_lag1``, what is absent is -1."""
    def column(c: str):
        base = c.removesuffix("_lag1")
        source = c if c in df.columns else base if base in targets and base in df.columns else None
        return (F.coalesce(F.col(f"`{source}`").cast("double"), F.lit(START)) if source else F.lit(START)).alias(c)

    return df.select("id", *[column(c) for c in conditions])
