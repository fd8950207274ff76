"""Attaching what is known of entities to their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _free(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``side`` with its keys and the columns that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    return side.select(*keys, *[F.col(f"`{c}`") for c in side.columns if c not in keys and c.lower() not in taken])


def join_known(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys the other table has, with its further columns."""
    return rows.join(_free(rows, side, keys), list(keys))


def attach_static(rows: DataFrame, static: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows, with the static columns of their entity where they are known; one static row an entity."""
    return rows.join(_free(rows, static, keys), list(keys), "left")


def attach_labels(table: DataFrame, labels: DataFrame, id_col: str, label: str = "label", unknown: float | None = None) -> DataFrame:
    """A lagged table with each entity's label, which joins after lagging so that it gets no lag of
    its own; entities without one take ``unknown``."""
    out = attach_static(table, labels.select(id_col, label), [id_col])
    return out if unknown is None else out.withColumn(label, F.coalesce(label, F.lit(unknown)))
