"""Lagged columns of trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ID_COLUMNS, columns_to_drop_default_feature_pruning


def prepare_autoregressive_data(
    df: DataFrame, id_col: str, time_col: str, static: Sequence[str] = (), lag: int = 1, fill_strategy: str = "special", fill_value: float = -1.0, prune: bool = False
) -> tuple[DataFrame, list[str], list[str]]:
    """(table, target columns, condition columns).

    Each dynamic column gets a column with its value ``lag`` rows earlier in the same entity.
    Every missing lag is filled - first rows and gaps alike - with ``fill_value`` (as text in
    text columns), the mean of the lagged column (``mean``), or 0 (``zero``). All windows
    share one sort of one shuffle.
    """
    for c in (id_col, time_col):
        if c not in df.columns:
            raise ValueError(f"no column {c}")
    if fill_strategy not in ("special", "mean", "zero"):
        raise ValueError(f"unknown fill strategy {fill_strategy}")
    if prune:
        df = df.drop(*columns_to_drop_default_feature_pruning(df.columns))
    ids = {*ID_COLUMNS, id_col, time_col}
    static = [c for c in static if c in df.columns and c not in ids]
    targets = [c for c in df.columns if c not in ids and c not in static]
    kinds = {f.name: f.dataType for f in df.schema}
    w = W.partitionBy(id_col).orderBy(time_col)
    lagged = {c: F.lag(F.col(f"`{c}`"), lag).over(w).alias(f"{c}_lag{lag}") for c in targets}
    out = df.select(*[F.col(f"`{c}`") for c in [x for x in df.columns if x in ids]], *[F.col(f"`{c}`") for c in [*targets, *static]], *lagged.values())
    text = [c for c in targets if isinstance(kinds[c], T.StringType)]
    if fill_strategy == "mean":
        if text:
            raise ValueError(f"text columns have no mean: {text}")
        means = out.agg(*[F.avg(F.nanvl(F.col(f"`{c}_lag{lag}`").cast("double"), F.lit(None))).alias(str(i)) for i, c in enumerate(targets)]).first() if targets else []
        fills = {c: F.lit(m) for c, m in zip(targets, means, strict=True)}
    else:
        value = fill_value if fill_strategy == "special" else 0.0
        fills = {c: F.lit(str(value)) if c in text else F.lit(value) for c in targets}
    names = {f"{c}_lag{lag}": c for c in targets}
    filled = out.select(*[F.coalesce(F.col(f"`{n}`") if names[n] in text else F.col(f"`{n}`").cast("double"), fills[names[n]]).alias(n) if n in names else F.col(f"`{n}`") for n in out.columns])
    return filled, targets, [*static, *names]


def absolute_steps(df: DataFrame, id_col: str, time_col: str, value: str) -> DataFrame:
    """(id, step): absolute differences of consecutive values that are not null."""
    w = W.partitionBy(id_col).orderBy(time_col)
    known = df.where(F.col(value).isNotNull())
    return known.select(id_col, F.abs(F.col(value) - F.lag(value).over(w)).alias("step")).where("step is not null")
