"""Comparing the distributions of columns of a real and a synthetic table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.io import kept
from .columns import valid_common_numeric_columns

def running_sums(counts: DataFrame, key: str, value: str, sums: Sequence[str]) -> DataFrame:
    """``counts`` (one row a key and value) with ``cum_<s>`` of each sum up to and with the value, in the order of values
    within the key, ``all_<s>`` of the whole key, and ``next``, the value that follows.

    A key with very many values is not one task's work: rows are range-partitioned by key and value and stored,
    once; each range is summed by itself, and the few totals (a row a key and range) say what lies before it.
    """
    placed = kept(counts.repartitionByRange(F.col(key), F.col(value)).withColumn("__range", F.spark_partition_id()))
    by_key = W.partitionBy(key).orderBy("__range")
    before = by_key.rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy(key, "__range").agg(F.min(value).alias("__first"), *[F.sum(s).alias(f"__{s}") for s in sums])
    sides = [x for s in sums for x in (F.coalesce(F.sum(f"__{s}").over(before), F.lit(0)).alias(f"__before_{s}"), F.sum(f"__{s}").over(W.partitionBy(key)).alias(f"all_{s}"))]
    offsets = totals.select(key, "__range", F.lead("__first").over(by_key).alias("__after"), *sides)
    inside = W.partitionBy(key, "__range").orderBy(value)
    joined = placed.join(offsets, [key, "__range"])
    cum = [(F.sum(s).over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"__before_{s}")).alias(f"cum_{s}") for s in sums]
    return joined.select(*counts.columns, F.coalesce(F.lead(value).over(inside), F.col("__after")).alias("next"), *cum, *[f"all_{s}" for s in sums])


def _long(df: DataFrame, names: Sequence[str], side: int) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias("value")) for c in names])
    rows = df.select(F.explode(cells).alias("c")).select("c.column", "c.value").where("value is not null")
    return rows.select("column", "value", F.lit(1 - side).alias("r"), F.lit(side).alias("s"))


def paired_counts(real: DataFrame, synth: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, r, s): how often each value occurs on either side. Both tables are read once for all columns."""
    return _long(real, names, 0).union(_long(synth, names, 1)).groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def _distributions(real: DataFrame, synth: DataFrame, names: Sequence[str]) -> DataFrame:
    cum = running_sums(paired_counts(real, synth, names), "column", "value", ["r", "s"]).where("all_r > 0 and all_s > 0")
    return cum.withColumn("gap", F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_s") / F.col("all_s")))


def ks_statistics(real: DataFrame, synth: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, ks): greatest gap between the two distribution functions."""
    names = valid_common_numeric_columns(real, synth) if names is None else names
    return _distributions(real, synth, names).groupBy("column").agg(F.max("gap").alias("ks"))


def wasserstein(real: DataFrame, synth: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, wasserstein, scaled): area between the distribution functions, and as a share of the real population deviation."""
    area = _distributions(real, synth, names).groupBy("column").agg(F.coalesce(F.sum(F.col("gap") * (F.col("next") - F.col("value"))), F.lit(0.0)).alias("wasserstein"))
    std = _long(real, names, 0).groupBy("column").agg(F.stddev_pop("value").alias("std"))
    return area.join(std, "column", "left").select("column", "wasserstein", F.when(F.col("std") > 1e-8, F.col("wasserstein") / F.col("std")).alias("scaled"))


def category_shares(real: DataFrame, synth: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, value, p, q): shares of each value on either side, 0 where absent; null is a value of its own."""
    def side(df: DataFrame, share: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("__NAN__")).alias("value")) for c in names])
        counts = df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))
        return counts.select("column", "value", (F.col("n") / F.sum("n").over(W.partitionBy("column"))).alias(share))

    return side(real, "p").join(side(synth, "q"), ["column", "value"], "full_outer").select("column", "value", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def total_variation(real: DataFrame, synth: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, tv)"""
    return category_shares(real, synth, names).groupBy("column").agg((0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tv"))


def js_distance(real: DataFrame, synth: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, js): root of the Jensen-Shannon divergence to base 2."""
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return category_shares(real, synth, names).groupBy("column").agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(part(F.col("p"))) + 0.5 * F.sum(part(F.col("q"))))).alias("js"))


def order_statistics(counts: DataFrame, key: str, value: str, n: str, fractions: Sequence[float]) -> DataFrame:
    """(key, n, q0, q1, ...): exact percentiles, interpolated between neighbours, from rows (key, value, n) of distinct values.

    Ranks come from running sums over ranges of values, so no task holds a column's values.
    """
    cum = running_sums(counts.select(key, F.col(value).cast("double").alias("__v"), F.col(n).alias("__n")), key, "__v", ["__n"])
    cum = cum.withColumnRenamed("all___n", "__total")
    place = [F.lit(float(f)) * (F.col("__total") - 1) for f in fractions]
    at = lambda k: F.min(F.when(F.col("cum___n") > k, F.col("__v")))
    ends = cum.groupBy(key, "__total").agg(*[x for i, p in enumerate(place) for x in (at(F.floor(p)).alias(f"__a{i}"), at(F.ceil(p)).alias(f"__b{i}"))])
    between = lambda i, p: (F.col(f"__a{i}") + (p - F.floor(p)) * F.when(F.col(f"__b{i}") != F.col(f"__a{i}"), F.col(f"__b{i}") - F.col(f"__a{i}")).otherwise(0.0)).alias(f"q{i}")
    return ends.select(key, F.col("__total").alias("n"), *[between(i, p) for i, p in enumerate(place)])


def quantiles(df: DataFrame, names: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(column, n, q0, q1, ...) of the values that are there, all columns in one pass; no row for a column without values."""
    counts = _long(df, names, 0).groupBy("column", "value").agg(F.sum("r").alias("n"))
    return order_statistics(counts, "column", "value", "n", fractions)


def grouped_quantiles(df: DataFrame, key: str, value: str, fractions: Sequence[float]) -> DataFrame:
    """(key, n, q0, q1, ...) of a value by group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return order_statistics(counts, key, value, "n", fractions)


def summarise(values: DataFrame, name: str) -> DataFrame:
    """One row: mean, median, 95th percentile and number of a column's values."""
    ends = quantiles(values.select(F.col(name).cast("double").alias("v")), ["v"], [0.5, 0.95])
    whole = values.agg(F.avg(name).alias("mean"), F.count(name).alias("n"))
    return whole.join(ends.select(F.col("q0").alias("median"), F.col("q1").alias("p95")), F.lit(True), "left").select("mean", "median", "p95", "n")  # single rows
