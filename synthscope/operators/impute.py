"""Filling gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dist import quantiles
from ..functions.scalars import clean


def _replaced(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def forward_fill(df: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """The last known value of the same entity."""
    w = W.partitionBy(id_col).orderBy(time_col).rowsBetween(W.unboundedPreceding, 0)
    return _replaced(df, {c: F.last(F.col(f"`{c}`"), ignorenulls=True).over(w) for c in names})


def backward_fill(df: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """The next known value of the same entity (never of another one)."""
    w = W.partitionBy(id_col).orderBy(F.col(time_col).desc()).rowsBetween(W.unboundedPreceding, 0)
    return _replaced(df, {c: F.last(F.col(f"`{c}`"), ignorenulls=True).over(w) for c in names})


def fill_both_ways(df: DataFrame, id_col: str, time_col: str, names: Sequence[str]) -> DataFrame:
    """Forward, then backward fill: one shuffle, the entity sorted both ways, so that either frame only ever grows."""
    back = W.partitionBy(id_col).orderBy(time_col).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(id_col).orderBy(F.col(time_col).desc()).rowsBetween(W.unboundedPreceding, 0)
    return _replaced(df, {c: F.coalesce(F.last(F.col(f"`{c}`"), True).over(back), F.last(F.col(f"`{c}`"), True).over(ahead)) for c in names})


def column_medians(df: DataFrame, names: Sequence[str]) -> dict:
    """Median of each column, NaN left out; a row a column to the driver."""
    found = {r["column"]: r["q0"] for r in quantiles(df.select(*[clean(F.col(f"`{c}`")).alias(c) for c in names]), names, [0.5]).collect()} if names else {}
    return {c: found.get(c) for c in names}


def column_modes(df: DataFrame, names: Sequence[str], unknown: str = "Unknown") -> dict:
    """Most frequent value of each column, the least on ties, ``unknown`` where all are null. Values are counted first, so no task holds a column's."""
    found = {}
    for c in names:
        top = df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).where("v is not null").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"]).first()
        found[c] = unknown if top[0] is None else top[0]
    return found


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """Nulls replaced by a value a column; columns without a value stay."""
    kinds = dict(df.dtypes)
    return _replaced(df, {c: F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(kinds[c])) for c, v in values.items() if v is not None})


def fill_median_mode(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Numbers take their column's median, text its mode."""
    floats = [c for c, k in df.dtypes if c in numeric and k in ("double", "float")]
    df = _replaced(df, {c: clean(F.col(f"`{c}`")) for c in floats})
    return fill_values(df, column_medians(df, numeric) | column_modes(df, categorical))
