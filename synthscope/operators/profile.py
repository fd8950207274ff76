"""Coverage profiles of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def non_missing_counts(df: DataFrame) -> DataFrame:
    """(column, n): values that are neither null nor an empty text, all columns in one pass."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(f"`{c}`").cast("string") != "")).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "n")


def all_missing_columns(df: DataFrame) -> list[str]:
    return [r["column"] for r in non_missing_counts(df).where("n = 0").collect()]  # a row a column


def drop_all_missing(df: DataFrame) -> DataFrame:
    return df.drop(*all_missing_columns(df))


def column_role(name, targets: Sequence[str], conditions: Sequence[str]):
    t, c = name.isin(*targets), name.isin(*conditions)
    return F.when(t & c, "both").when(t, "target").when(c, "condition").otherwise("other")


def coverage_profile(df: DataFrame, targets: Sequence[str] = (), conditions: Sequence[str] = (), sentinel: float = -1.0) -> DataFrame:
    """A row a column: rows, values and their share, role; for numbers the share of the sentinel, mean, population
    deviation, least and greatest; for text the values that are not blank and their share. One aggregate over the table."""
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        v = F.nanvl(c.cast("double"), F.lit(None).cast("double")) if number else c
        known = v if number else c
        none = F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"), F.count("*").alias("n_rows"), F.count(known).alias("n_known"),
                (F.avg(F.when(v == sentinel, 1.0).when(v.isNotNull(), 0.0)) * 100 if number else none).alias("pct_sentinel"),
                (F.avg(v) if number else none).alias("mean"), (F.stddev_pop(v) if number else none).alias("std"),
                (F.min(v) if number else none).alias("low"), (F.max(v) if number else none).alias("high"),
                (F.lit(None).cast("long") if number else F.count_if(F.trim(c.cast("string")) != "")).alias("n_text"),
            )
        )
    rows = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    pct = F.when(F.col("n_rows") > 0, 100.0 * F.col("n_known") / F.col("n_rows")).otherwise(0.0)
    text = F.when(F.col("n_rows") > 0, 100.0 * F.col("n_text") / F.col("n_rows"))
    return rows.select("*", pct.alias("pct_known"), text.alias("pct_text"), column_role(F.col("column"), targets, conditions).alias("role")).orderBy("pct_known", "column")


def removal_recommendations(profile: DataFrame) -> DataFrame:
    """Columns known in under 1 %, 5 % and 15 % of rows, with the coverage of their lag, worst first."""
    rec = F.when(F.col("pct_known") < 1, "REMOVE").when(F.col("pct_known") < 5, "REMOVE_IF_PANEL").when(F.col("pct_known") < 15, "REVIEW")
    lag = profile.select(F.col("column").alias("lag_column"), F.col("pct_known").alias("lag_pct_known"))
    tiers = profile.where(~F.col("column").endswith("_lag1")).select("column", "pct_known", rec.alias("recommendation")).where("recommendation is not null")
    return tiers.join(lag, F.concat("column", F.lit("_lag1")) == F.col("lag_column"), "left").drop("lag_column").orderBy("recommendation", "pct_known", "column")


def value_shares(df: DataFrame, name: str) -> DataFrame:
    """(value, n, share) of a column's values."""
    counts = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("all")).alias("share"))


def bucket_rare(df: DataFrame, name: str, min_count: int = 50, other: str = "OTHER") -> DataFrame:
    """``df`` with the values of a column that fewer than ``min_count`` rows have as ``other``; null is a value.

    Values are counted within tasks first; the frequent ones, at most one in ``min_count`` rows, are then joined to all rows.
    """
    value = F.col(f"`{name}`")
    often = df.groupBy(value.alias("__often")).agg(F.count("*").alias("__n")).where(F.col("__n") >= min_count)
    joined = df.join(often, value.eqNullSafe(F.col("__often")), "left")
    return joined.select(*[F.when(F.col("__n").isNull(), F.lit(other)).otherwise(value).alias(name) if c == name else F.col(f"`{c}`") for c in df.columns])
