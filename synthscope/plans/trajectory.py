"""Temporal structure of a synthetic longitudinal table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_present
from ..functions.dist import grouped_quantiles, ks_statistics
from ..functions.scalars import clean, guarded_corr
from ..sources.io import kept

# Names of vital signs, and pairs of them that move together.
VITALS = {
    "heart_rate": ("Heart_Rate_mean", "HR"),
    "systolic_bp": ("Systolic_blood_pressure_mean", "SysABP", "NISysABP"),
    "diastolic_bp": ("Diastolic_blood_pressure_mean", "DiasABP", "NIDiasABP"),
    "mean_bp": ("Mean_blood_pressure_mean", "MAP", "NIMAP"),
    "resp_rate": ("Respiratory_rate_mean", "RespRate"),
    "oxygen_sat": ("Oxygen_saturation_mean", "SaO2"),
    "temperature": ("Temperature_mean", "Temp"),
}
PAIRS = [("heart_rate", "mean_bp"), ("systolic_bp", "diastolic_bp"), ("oxygen_sat", "resp_rate")]
LEAST_ROWS = 4


def resolve_vitals(real: DataFrame, synth: DataFrame, candidates: Mapping = VITALS) -> dict[str, str]:
    """Vital -> the first of its names that both tables have."""
    both = set(real.columns) & set(synth.columns)
    found = {v: first_present(both, names) for v, names in candidates.items()}
    return {v: c for v, c in found.items() if c}


def _with_before(df: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """(id, x0, b0, x1, b1, ...): a row a row, each value and the last one before it that is there; one sort for all features."""
    values = df.select(F.col(id_col).alias("id"), F.col(time_col).alias("t"), *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(names)])
    w = W.partitionBy("id").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    return values.select("id", *[c for i in range(len(names)) for c in (F.col(f"x{i}"), F.when(F.col(f"x{i}").isNotNull(), F.last(f"x{i}", True).over(w)).alias(f"b{i}"))])


def autocorrelations(df: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """(id, feature, r): lag-1 autocorrelation of the values that are there (gaps close up), of
    entities with four rows and features with four values."""
    per = [F.when(F.count(f"x{i}") >= LEAST_ROWS, guarded_corr(F.col(f"b{i}"), F.col(f"x{i}"))).alias(f"r{i}") for i in range(len(names))]
    rows = _with_before(df, id_col, time_col, names).groupBy("id").agg(F.count("*").alias("n"), *per).where(F.col("n") >= LEAST_ROWS)
    return rows.select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(names)])).alias("c")).select("id", "c.feature", "c.r").where("r is not null")


def _median_distance(real: DataFrame, synth: DataFrame, key: str, name: str) -> DataFrame:
    a, b = (grouped_quantiles(x, key, "r", [0.5]).select(key, F.col("q0").alias(n)) for x, n in ((real, "a"), (synth, "b")))
    return a.join(b, key).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias(name))


def autocorr_distance(real: DataFrame, synth: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """One row: mean over features of the distance between median autocorrelations."""
    return _median_distance(autocorrelations(real, id_col, time_col, names), autocorrelations(synth, id_col, time_col, names), "feature", "autocorr_distance")


def stay_length_ks(real: DataFrame, synth: DataFrame, id_col: str) -> DataFrame:
    """One row: KS statistic of the numbers of rows an entity; null with fewer than two entities on a side."""
    return _length_ks(*(df.groupBy(id_col).agg(F.count("*").alias("length")) for df in (real, synth)))


def _length_ks(a: DataFrame, b: DataFrame) -> DataFrame:
    n = a.agg(F.count("*").alias("n")).crossJoin(b.agg(F.count("*").alias("m")))  # one row
    return n.crossJoin(ks_statistics(a, b, ["length"]).agg(F.max("ks").alias("ks"))).select(F.when((F.col("n") >= 2) & (F.col("m") >= 2), F.col("ks")).alias("stay_length_ks"))


def mean_steps(df: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """(feature, step): mean absolute difference of consecutive values, over all entities."""
    row = _with_before(df, id_col, time_col, names).agg(*[F.avg(F.abs(F.col(f"x{i}") - F.col(f"b{i}"))).alias(f"s{i}") for i in range(len(names))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("step")) for i, c in enumerate(names)])).alias("c")).select("c.*")


def transition_mse_ratio(real: DataFrame, synth: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """One row: mean over features of the mean absolute step, synthetic over real (features that stand still left out)."""
    return _step_ratio(mean_steps(real, id_col, time_col, names), mean_steps(synth, id_col, time_col, names))


def _step_ratio(r: DataFrame, s: DataFrame) -> DataFrame:
    both = r.withColumnRenamed("step", "a").join(s.withColumnRenamed("step", "b"), "feature")
    return both.where("a > 1e-9 and b is not null").agg(F.avg(F.col("b") / F.col("a")).alias("transition_mse_ratio"))


def within_subject_corr(df: DataFrame, id_col: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, pair, r): correlation of each pair of columns within each entity with four complete rows."""
    cells = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), clean(F.col(f"`{a}`")).alias("x"), clean(F.col(f"`{b}`")).alias("y")) for a, b in pairs])
    long = df.select(F.col(id_col).alias("id"), F.explode(cells).alias("c")).select("id", "c.*").where("x is not null and y is not null")
    return long.groupBy("id", "pair").agg(F.count("*").alias("n"), guarded_corr(F.col("x"), F.col("y")).alias("r")).where((F.col("n") >= LEAST_ROWS) & F.col("r").isNotNull()).select("id", "pair", "r")


def temporal_corr_drift(real: DataFrame, synth: DataFrame, id_col: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row: mean over pairs of the distance between median correlations."""
    return _median_distance(within_subject_corr(real, id_col, pairs), within_subject_corr(synth, id_col, pairs), "pair", "temporal_corr_drift")


@dataclass
class Entities:
    """A table's sums by entity, from one sort of its rows: number of rows, lag-1 autocorrelations and steps of each
    feature, and correlations of pairs of features, as the functions above define them."""

    table: DataFrame
    names: list[str]
    pairs: list[tuple[str, str]]

    @classmethod
    def of(cls, df: DataFrame, id_col: str, time_col: str, names: Sequence[str], pairs: Sequence[tuple[str, str]]) -> Entities:
        names, per = list(names), [F.count("*").alias("length")]
        for i in range(len(names)):
            x, b = F.col(f"x{i}"), F.col(f"b{i}")
            step = F.abs(x - b)
            per += [F.when(F.count(x) >= LEAST_ROWS, guarded_corr(b, x)).alias(f"r{i}"), F.sum(step).alias(f"sum{i}"), F.count(step).alias(f"steps{i}")]
        for j, pair in enumerate(pairs):
            x, y = (F.col(f"x{names.index(c)}") for c in pair)
            per.append(F.when(F.count(clean(x) + clean(y)) >= LEAST_ROWS, guarded_corr(x, y)).alias(f"p{j}"))
        return cls(kept(_with_before(df, id_col, time_col, names).groupBy("id").agg(*per)), names, list(pairs))

    def autocorrelations(self) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(self.names)])
        return self.table.where(F.col("length") >= LEAST_ROWS).select("id", F.explode(cells).alias("c")).select("id", "c.feature", "c.r").where("r is not null")

    def pair_correlations(self) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(f"p{j}").alias("r")) for j, (a, b) in enumerate(self.pairs)])
        return self.table.select("id", F.explode(cells).alias("c")).select("id", "c.pair", "c.r").where("r is not null")

    def mean_steps(self) -> DataFrame:
        row = self.table.agg(*[(F.sum(f"sum{i}") / F.sum(f"steps{i}")).alias(f"s{i}") for i in range(len(self.names))])
        return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("step")) for i, c in enumerate(self.names)])).alias("c")).select("c.*")


def trajectory_metrics(real: DataFrame, synth: DataFrame, id_col: str = "subject_id", time_col: str = "hours_in", vitals: Mapping = VITALS) -> DataFrame:
    """One row with the four. Each table's rows are sorted once; the metrics are of the sums by entity."""
    found = resolve_vitals(real, synth, vitals)
    names = list(found.values())
    pairs = [(found[a], found[b]) for a, b in PAIRS if a in found and b in found]
    null = lambda n: real.sparkSession.range(1).select(F.lit(None).cast("double").alias(n))
    r, s = (Entities.of(d, id_col, time_col, names, pairs) for d in (real, synth))
    parts = [
        _median_distance(r.autocorrelations(), s.autocorrelations(), "feature", "autocorr_distance") if names else null("autocorr_distance"), _length_ks(r.table, s.table),
        _step_ratio(r.mean_steps(), s.mean_steps()) if names else null("transition_mse_ratio"), _median_distance(r.pair_correlations(), s.pair_correlations(), "pair", "temporal_corr_drift") if pairs else null("temporal_corr_drift"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out
