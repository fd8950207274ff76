"""Fidelity of a synthetic table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_present, valid_common_numeric_columns
from ..functions.dist import ks_statistics
from ..functions.scalars import guarded_corr

# Plausible ranges of measurements, by the names that tables give them.
CLINICAL_RANGES = {
    ("Heart_Rate_mean", "HR"): (0, 300),
    ("Systolic_blood_pressure_mean", "SysABP", "NISysABP"): (50, 250),
    ("Diastolic_blood_pressure_mean", "DiasABP", "NIDiasABP"): (20, 180),
    ("Mean_blood_pressure_mean", "MAP", "NIMAP"): (30, 200),
    ("Respiratory_rate_mean", "RespRate"): (0, 80),
    ("Temperature_mean", "Temp"): (25, 45),
    ("Oxygen_saturation_mean", "SaO2"): (0, 100),
    ("Glucose_mean", "Glucose"): (0, 1500),
    ("Bicarbonate_mean", "HCO3"): (0, 60),
    ("Creatinine_mean", "Creatinine"): (0, 25),
    ("Chloride_mean", "Chloride"): (50, 150),
    ("Hematocrit_mean", "HCT"): (10, 70),
    ("Hemoglobin_mean", "Hgb"): (3, 25),
    ("Platelets_mean", "Platelets"): (0, 2000),
    ("Potassium_mean", "K"): (1.5, 10),
    ("Sodium_mean", "Na"): (100, 180),
    ("Blood_urea_nitrogen_mean", "BUN"): (0, 200),
    ("White_blood_cell_count_mean", "WBC"): (0, 100),
}


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, pairwise complete; one aggregate for all."""
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), guarded_corr(F.col(f"`{a}`"), F.col(f"`{b}`"), 1e-300).alias("r")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.a", "c.b", "c.r")


def corr_frobenius(real: DataFrame, synth: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row: Frobenius norm of the difference of the correlation matrices, columns with any
    undefined correlation left out; null with fewer than two left."""
    names = valid_common_numeric_columns(real, synth) if names is None else list(names)
    both = correlations(real, names).withColumnRenamed("r", "x").join(correlations(synth, names).withColumnRenamed("r", "y"), ["a", "b"])
    gone = both.where("x is null or y is null").select(F.explode(F.array("a", "b")).alias("g")).distinct()
    kept = both.join(gone, F.col("a") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left_anti")
    return kept.agg(F.sqrt(2.0 * F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("corr_frobenius"))


def range_violation_pct(df: DataFrame, ranges: Mapping = CLINICAL_RANGES) -> DataFrame:
    """One row: share (in %) of values outside the plausible range of their column."""
    tested = [(c, *bounds) for aliases, bounds in ranges.items() if (c := first_present(df.columns, (aliases,) if isinstance(aliases, str) else aliases))]
    if not tested:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("range_violation_pct"))
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))
    out = sum((F.count_if((value(c) < lo) | (value(c) > hi)) for c, lo, hi in tested), F.lit(0))
    return df.agg(F.try_divide(100.0 * out, sum((F.count(value(c)) for c, _, _ in tested), F.lit(0))).alias("range_violation_pct"))


def quality_metrics(real: DataFrame, synth: DataFrame, ranges: Mapping = CLINICAL_RANGES) -> DataFrame:
    """One row: mean KS statistic, Frobenius distance and range violations."""
    names = valid_common_numeric_columns(real, synth)
    ks = ks_statistics(real, synth, names).agg(F.avg("ks").alias("avg_ks_stat"))
    return ks.crossJoin(corr_frobenius(real, synth, names)).crossJoin(range_violation_pct(synth, ranges))  # single rows
