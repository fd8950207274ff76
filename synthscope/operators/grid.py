"""From entity-attribute-value rows to a dense grid of entities and steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_rows(eav: DataFrame, n_steps: int, drop_parameters: Sequence[str] = (), step: str = "step") -> DataFrame:
    """Rows within the first ``n_steps`` steps, without some parameters."""
    return eav.where((F.col(step) >= 0) & (F.col(step) < n_steps) & ~F.col("parameter").isin(*drop_parameters))


def median_wide(eav: DataFrame, id_col: str, step: str, parameters: Sequence[str]) -> DataFrame:
    """One row an entity and step, a column a parameter: the median of its values.

    One shuffle on (entity, step): medians of conditional values instead of a pivot's two
    aggregations. The parameters are given, so no job looks for them.
    """
    return eav.groupBy(id_col, step).agg(*[F.median(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in parameters])


def dense_grid(ids: DataFrame, wide: DataFrame, id_col: str, step: str, n_steps: int) -> DataFrame:
    """Every entity at every step 0..n_steps-1, with what ``wide`` has there.

    The grid is made row by row by a sequence, so entities without any measurement have theirs too.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias(step)
    return ids.select(id_col).distinct().select(id_col, steps).join(wide, [id_col, step], "left")


def static_attributes(eav: DataFrame, id_col: str, names: Sequence[str], order: str, missing: Sequence[str] = (), sentinel: float = -1.0) -> DataFrame:
    """The first value of each parameter by entity; the sentinel is null for those listed in ``missing``."""
    def first(p: str) -> Column:
        value = F.nullif(F.col("value"), F.lit(sentinel)) if p in missing else F.col("value")
        return F.min_by(F.when(F.col("parameter") == p, F.struct(value.alias("v"))), F.when(F.col("parameter") == p, F.col(order)))["v"].alias(p)

    return eav.groupBy(id_col).agg(*[first(p) for p in names])


def first_rows(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """One row an entity: the first value that is not null of each column, by time."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(*[F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(time_col))).alias(c) for c in rest]).select(*df.columns)


def hour0_rows(df: DataFrame, id_col: str, time_col: str) -> DataFrame:
    """Rows at time 0, or the first rows where there are none at all."""
    zero = df.where(F.col(time_col) == 0)
    return first_rows(df, id_col, time_col) if zero.isEmpty() else zero


def stack_trajectories(df: DataFrame, array_col: str, id_col: str = "trajectory_id") -> DataFrame:
    """Rows of an array of structs, one a step, tagged with their trajectory."""
    return df.select(id_col, F.posexplode(array_col).alias("timestep", "row")).select(id_col, "timestep", "row.*")


def any_label(df: DataFrame, id_col: str, c: Column, name: str = "label") -> DataFrame:
    """1 for entities whose rounded and clipped column is ever 1."""
    return df.groupBy(id_col).agg(F.coalesce(F.max(F.least(F.greatest(F.bround(c.cast("double")), F.lit(0.0)), F.lit(1.0))), F.lit(0.0)).cast("int").alias(name))
