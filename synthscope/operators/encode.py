"""Mixed-type encoder: numbers as they are, texts as codes of their sorted distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import round_clip

#: Stands for null among the values; always code 0 where a column has nulls.
NULL = "__NAN__"


def label_state(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Mergeable fit state (col, value): distinct values of each column, null as the marker."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)).alias("value")) for c in categorical])
    return df.select(F.explode(pairs).alias("p")).select("p.col", "p.value").distinct()


def merge_states(*states: DataFrame) -> DataFrame:
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.distinct()


def codes_of(state: DataFrame) -> DataFrame:
    """(col, value, code): 0, 1, ... in the order of values, the null marker first.

    Values are numbered within those that begin alike, and what comes before these is a sum
    over their counts, so a column of very many values is not one task's work.
    """
    placed = state.select("col", "value", F.when(F.col("value") == NULL, "").otherwise(F.concat(F.lit("+"), F.substring("value", 1, 3))).alias("__begin"))
    counts = placed.groupBy("col", "__begin").agg(F.count("*").alias("__c"))
    before = W.partitionBy("col").orderBy("__begin").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("col", "__begin", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("col", "__begin").orderBy("value"))
    return placed.withColumn("__i", inside).join(offsets, ["col", "__begin"]).select("col", "value", (F.col("__before") + F.col("__i") - 1).cast("int").alias("code"))


@dataclass
class TabularEncoder:
    """Fitted encoder: column lists by type, and the code table."""

    numeric: list[str]
    binary: list[str]
    categorical: list[str]
    codes: DataFrame
    integer: tuple[str, ...] = ()

    @classmethod
    def fit(cls, df: DataFrame, numeric: Sequence[str], binary: Sequence[str] = (), categorical: Sequence[str] = (), integer: Sequence[str] = ()) -> TabularEncoder:
        if df.isEmpty():
            raise ValueError("an encoder needs rows")
        state = label_state(df, categorical) if categorical else df.sparkSession.createDataFrame([], "col string, value string")
        return cls(list(numeric), list(binary), list(categorical), codes_of(state), tuple(integer))

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.binary, *self.categorical]

    @property
    def feature_types(self) -> list[str]:
        """``q`` for numbers, ``c`` for codes."""
        return ["q"] * (len(self.numeric) + len(self.binary)) + ["c"] * len(self.categorical)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Codes by column, numeric, binary, categorical; null numbers 0, unknown values code 0.

        A join a text column with its few codes; those stored small are broadcast by the planner.
        """
        for c in self.categorical:
            own = self.codes.where(F.col("col") == c).select(F.col("value").alias("__v"), F.col("code").alias(f"__code_{c}"))
            df = df.join(own, F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) == F.col("__v"), "left").drop("__v")
        plain = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(0.0)).alias(c) for c in (*self.numeric, *self.binary)]
        return df.select(*keep, *plain, *[F.coalesce(F.col(f"__code_{c}"), F.lit(0)).cast("double").alias(c) for c in self.categorical])

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Values back: whole numbers rounded half to even, binaries rounded and clipped, codes as
        values (unknown ones as code 0's, the null marker as null)."""
        for c in self.categorical:
            own = self.codes.where(F.col("col") == c)
            value = own.select(F.col("code").alias("__c"), F.col("value").alias(f"__value_{c}"))
            zero = own.where("code = 0").select(F.col("value").alias(f"__zero_{c}"))  # one row
            df = df.join(value, F.bround(F.col(f"`{c}`")).cast("int") == F.col("__c"), "left").drop("__c").crossJoin(F.broadcast(zero))
        numbers = [(F.bround(F.col(f"`{c}`")).cast("long") if c in self.integer else F.col(f"`{c}`")).alias(c) for c in self.numeric]
        texts = [F.nullif(F.coalesce(F.col(f"__value_{c}"), F.col(f"__zero_{c}")), F.lit(NULL)).alias(c) for c in self.categorical]
        return df.select(*keep, *numbers, *[round_clip(F.col(f"`{c}`")).alias(c) for c in self.binary], *texts)

    def split_indices(self, target: Sequence[str], condition: Sequence[str]) -> tuple[list[int], list[int]]:
        """Places of target and condition columns; they must be known, disjoint and cover all."""
        known, wanted = set(self.columns), [*target, *condition]
        if missing := [c for c in wanted if c not in known]:
            raise ValueError(f"unknown columns: {missing}")
        if both := set(target) & set(condition):
            raise ValueError(f"target and condition overlap: {sorted(both)}")
        if left := known - set(wanted):
            raise ValueError(f"neither target nor condition: {sorted(left)}")
        place = {c: i for i, c in enumerate(self.columns)}
        return [place[c] for c in target], [place[c] for c in condition]

    def vectors(self, df: DataFrame, target: Sequence[str], condition: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """Arrays ``x_target`` and ``x_cond`` of encoded columns."""
        self.split_indices(target, condition)
        rows = self.transform(df, keep)
        return rows.select(*keep, F.array(*[F.col(f"`{c}`") for c in target]).alias("x_target"), F.array(*[F.col(f"`{c}`") for c in condition]).alias("x_cond"))
