"""Result tables of experiments: seed statistics, grids, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clean, log_fit, round_if_finite

# 97.5 % quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272]
Z_975 = 1.96

# Control columns, then metrics as (name of the evaluator, column, digits, with seed statistics).
CONTROL = ["nt", "n_noise", "hour0_train_time_sec", "autoregressive_train_time_sec", "total_train_time_sec"]
METRICS = [
    ("synth_accuracy", "mortality_synth_accuracy", 4, True), ("synth_balanced_accuracy", "mortality_synth_balanced_accuracy", 4, True), ("synth_f1", "mortality_synth_f1", 4, True), ("synth_roc_auc", "mortality_synth_roc_auc", 4, True),
    ("real_accuracy", "mortality_real_accuracy", 4, False), ("real_balanced_accuracy", "mortality_real_balanced_accuracy", 4, False), ("real_f1", "mortality_real_f1", 4, False), ("real_roc_auc", "mortality_real_roc_auc", 4, False),
    ("los_synth_accuracy", "los_synth_accuracy", 4, True), ("los_synth_macro_f1", "los_synth_macro_f1", 4, True), ("los_synth_roc_auc", "los_synth_roc_auc", 4, False),
    ("los_real_accuracy", "los_real_accuracy", 4, False), ("los_real_macro_f1", "los_real_macro_f1", 4, False), ("los_real_roc_auc", "los_real_roc_auc", 4, False),
    ("avg_ks_stat", "avg_ks_stat", 4, True), ("corr_frobenius", "corr_frobenius", 4, True), ("range_violation_pct", "range_violation_pct", 2, True),
    ("autocorr_distance", "autocorr_distance", 4, True), ("stay_length_ks", "stay_length_ks", 4, True), ("transition_mse_ratio", "transition_mse_ratio", 4, True), ("temporal_corr_drift", "temporal_corr_drift", 4, True),
    ("dcr_median", "dcr_median", 6, True), ("dcr_p05", "dcr_p05", 6, False), ("dcr_exact_match_rate", "dcr_exact_match_rate", 6, False), ("dcr_baseline_protection", "dcr_baseline_protection", 6, True),
    ("dcr_overfitting_protection", "dcr_overfitting_protection", 6, False), ("dcr_closer_to_training_pct", "dcr_closer_to_training_pct", 6, False),
    ("mia_roc_auc", "mia_roc_auc", 6, True), ("mia_average_precision", "mia_average_precision", 6, False), ("mia_attacker_advantage", "mia_attacker_advantage", 6, False),
]

RESULT_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c in ("nt", "n_noise") else T.DoubleType()) for c in CONTROL]
    + [T.StructField(c, T.DoubleType()) for _, c, _, _ in METRICS]
    + [T.StructField("trajectory_seed_count", T.IntegerType())]
    + [T.StructField(f"{c}_{s}", T.DoubleType()) for _, c, _, u in METRICS if u for s in ("std", "ci95")]
    + [T.StructField("degenerate_flag", T.BooleanType()), T.StructField("timestamp", T.StringType()), T.StructField("error", T.StringType())]
)


def _t_quantile(n: Column) -> Column:
    """The table's value, beyond it the expansion in powers of one over the degrees of freedom (five digits right from 31 on)."""
    table = F.array(*[F.lit(t) for t in T_975])
    z, d = 1.959963984540054, (n - 1).cast("double")
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return F.when(n < len(T_975) + 2, F.get(table, (n - 2).cast("int"))).otherwise(F.lit(z) + sum((t / F.pow(d, k) for k, t in enumerate(terms, 1)), F.lit(0.0)))


def seed_statistics(rows: DataFrame, keys: Sequence[str], value: str, normal: bool = False) -> DataFrame:
    """keys, n, mean, std (0 for one value) and half width of the 95 % interval (null for one value), over finite values."""
    v = clean(F.col(value))
    s = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("s"))
    q = F.lit(Z_975) if normal else _t_quantile(F.col("n"))
    return s.select(*keys, "n", "mean", F.when(F.col("n") == 1, 0.0).otherwise(F.col("s")).alias("std"), F.when(F.col("n") > 1, q * F.col("s") / F.sqrt(F.col("n").cast("double"))).alias("ci95"))


# Numbers of times and of noise copies by profile of each data set.
PROFILES = {
    "mimic": {"full": ([1, 2, 3, 5, 8, 13, 21, 34], [1, 2, 3, 5, 8, 13, 21, 34]), "smoke": ([1, 3], [1, 3])},
    "challenge2012": {"full": ([1, 2, 3, 5, 8, 13, 21], [1, 2, 3, 5, 8, 13, 21]), "smoke": ([1, 3], [1, 3])},
}


def profile_grid(spark, dataset: str, profile: str = "full") -> DataFrame:
    """The cells of a profile."""
    return grid(spark, *PROFILES[dataset][profile])


def grid(spark, nt: Sequence[int], n_noise: Sequence[int]) -> DataFrame:
    """All pairs of two settings."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, nt))).alias("nt")).select("nt", F.explode(F.array(*map(F.lit, n_noise))).alias("n_noise"))


def remaining(cells: DataFrame, results: DataFrame, keys: Sequence[str] = ("nt", "n_noise")) -> DataFrame:
    """Cells without an error-free result."""
    return cells.join(results.where("error is null or error = ''"), list(keys), "left_anti")


def degenerate_flag(auc: Column, f1: Column) -> Column:
    return F.coalesce((clean(auc) <= 0.55) & (clean(f1) <= 0.15), F.lit(False))


def average_metrics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value): means over seeds of finite values, from rows (keys, metric, value)."""
    return rows.groupBy(*keys, "metric").agg(F.avg(clean(F.col("value"))).alias("value"))


def build_result_rows(rows: DataFrame, keys: Sequence[str] = ("nt", "n_noise")) -> DataFrame:
    """Wide result rows from (keys, seed, metric, value): rounded means, seed statistics and the flag."""
    rounded = lambda c: F.coalesce(*[F.when(F.col("metric") == m, round_if_finite(F.col(c), d)) for m, _, d, _ in METRICS])
    stats = seed_statistics(rows, [*keys, "metric"], "value")
    means = stats.select(*keys, F.col("metric").alias("m"), F.col("metric"), "mean", "std", "ci95")
    cell = lambda m, c: F.max(F.when(F.col("metric") == m, rounded(c)))
    cols = [cell(m, "mean").alias(c) for m, c, _, _ in METRICS] + [cell(m, s).alias(f"{c}_{s}") for m, c, _, u in METRICS if u for s in ("std", "ci95")]
    raw = lambda m: F.max(F.when(F.col("metric") == m, F.col("mean")))
    wide = means.groupBy(*keys).agg(*cols, degenerate_flag(raw("synth_roc_auc"), raw("los_synth_macro_f1")).alias("degenerate_flag"))
    seeds = rows.groupBy(*keys).agg(F.count_distinct("seed").cast("int").alias("trajectory_seed_count"))
    return wide.join(seeds, list(keys))


def error_rows(cells: DataFrame, message: str) -> DataFrame:
    """A result row of nulls with a message for each cell."""
    return cells.select(*[F.col(f.name).cast(f.dataType) if f.name in cells.columns else (F.lit(message) if f.name == "error" else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA])


def compare_models(a: DataFrame, b: DataFrame, key: str = "metric") -> DataFrame:
    """Difference b - a of rows (metric, mean, ci95), joint interval, whether it is significant, and who is larger."""
    x, y = (d.select(key, F.col("mean").alias(f"mean_{n}"), F.col("ci95").alias(f"ci_{n}")) for d, n in ((a, "a"), (b, "b")))
    delta = F.col("mean_b") - F.col("mean_a")
    joint = F.sqrt(F.pow("ci_a", 2) + F.pow("ci_b", 2))
    sure = F.coalesce(F.abs(delta) > joint, F.lit(False))
    return x.join(y, key).select(key, "mean_a", "mean_b", delta.alias("delta"), joint.alias("joint_ci95"), sure.alias("significant"), F.when(~sure, "unclear").when(delta > 0, "b").otherwise("a").alias("larger"))


def best_models(rows: DataFrame, higher: Mapping[str, bool]) -> DataFrame:
    """(metric, best): the model with the best finite value, by each metric's direction; ``unclear`` without any."""
    known = F.create_map(*[F.lit(x) for kv in higher.items() for x in kv])
    v = F.when(known[F.col("metric")], clean(F.col("value"))).otherwise(-clean(F.col("value")))
    return rows.groupBy("metric").agg(F.coalesce(F.max_by("model", F.when(v.isNotNull(), F.struct(v.alias("v"), F.col("model")))), F.lit("unclear")).alias("best"))


def load_results(df: DataFrame, required: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """Rows with their key metrics; a missing column is taken from its older name."""
    for new, old in aliases.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old) if new in df.columns else F.col(old)).drop(old)
    return df.dropna(subset=list(required))


def pivot_grid(df: DataFrame, row: str, column: str, values: Sequence, metric: Column) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(metric))


def marginal_means(df: DataFrame, by: str, metric: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(clean(F.col(metric))).alias(metric))


def best_row(df: DataFrame, metric: str, lowest: bool = False) -> DataFrame:
    """The row with the greatest (or least) finite metric, ties by the other columns."""
    v = clean(F.col(metric))
    pick = F.min_by if lowest else F.max_by
    return df.where(v.isNotNull()).agg(pick(F.struct("*"), F.struct(v.alias("v"), *[c for c in df.columns if c != metric])).alias("r")).select("r.*")


def latest_row(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")


def ci_overlaps(df: DataFrame, metric: str, ci: str) -> DataFrame:
    """One row: number of other rows whose interval overlaps that of the best row."""
    best = best_row(df, metric).select(F.struct("*").alias("best"))
    low, high = F.col(metric) - F.col(ci), F.col(metric) + F.col(ci)
    blow, bhigh = F.col(f"best.{metric}") - F.col(f"best.{ci}"), F.col(f"best.{metric}") + F.col(f"best.{ci}")
    same = F.lit(True)
    for c in df.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    return df.crossJoin(F.broadcast(best)).where(~same).agg(F.count_if((low <= bhigh) & (high >= blow)).alias("n_overlapping"))  # one row


def log_trend(df: DataFrame, x: str, y: str, at: Sequence[float] = ()) -> DataFrame:
    """One row: slope, intercept of y over ln x, and the values it gives at some points."""
    slope, intercept = log_fit(F.col(y), F.col(x))
    fit = df.agg(slope.alias("slope"), intercept.alias("intercept"))
    return fit.select("*", *[(F.col("slope") * F.ln(F.lit(float(p))) + F.col("intercept")).alias(f"at_{p}") for p in at])


def ranked_diagnostics(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Error-free rows in the order of some metrics, and the others."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    return df.where(ok).orderBy(*by), df.where(~ok)


def group_mean_std(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n")).orderBy(F.col("mean").desc())


