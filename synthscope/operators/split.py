"""Samples and splits in the order of a hash of the seed and the ids: the same at any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_rank


def _order(seed: int, keys: Sequence[str]) -> list:
    return [hash_rank(seed, *[F.col(k) for k in keys]), *keys]


def smallest_hashes(df: DataFrame, n: int, keys: Sequence[str], seed: int) -> DataFrame:
    """The ``n`` rows with the least hashes; Spark takes them by a top-n, without a full sort."""
    return df.orderBy(*_order(seed, keys)).limit(n)


#: Ranges that hashes are cut into for ranking: the upper bits of 52.
RANGE_BITS = 12


def hash_ranked(df: DataFrame, keys: Sequence[str], seed: int, by: str | None = None) -> DataFrame:
    """``df`` with ``__r``, the rank (1, 2, ...) by hash and keys within each value of ``by`` (of all rows without it), and ``__n``, how many there are.

    Hashes are cut into ranges; rows are ranked within theirs, and what comes before a range
    is a sum over the counts of ranges. A value that most rows have is as many tasks' work as there are ranges.
    """
    group = F.lit(0) if by is None else F.col(by)
    placed = df.withColumn("__h", hash_rank(seed, *[F.col(k) for k in keys])).withColumn("__range", F.shiftright("__h", 52 - RANGE_BITS)).withColumn("__g", group)
    counts = placed.groupBy("__g", "__range").agg(F.count("*").alias("__c"))
    w = W.partitionBy("__g")  # over the counts: as many rows as ranges
    before = F.coalesce(F.sum("__c").over(w.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__g").alias("__og"), F.col("__range").alias("__orange"), before.alias("__before"), F.sum("__c").over(w).alias("__n"))
    inside = F.row_number().over(W.partitionBy("__g", "__range").orderBy("__h", *keys))
    ranked = placed.withColumn("__i", inside).join(offsets, (F.col("__range") == F.col("__orange")) & F.col("__g").eqNullSafe(F.col("__og")))
    return ranked.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__i")).alias("__r"), "__n")


def subject_split(df: DataFrame, id_col: str, test: float = 0.1, holdout: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, part) of every entity: test, holdout (each at least one) and train.

    An entity's part follows from its rank by hash, which is counted range by range, so
    entities are never gathered in one task.
    """
    ids = df.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    ranked = hash_ranked(ids, [id_col], seed)
    n_test, n_hold = (F.greatest(F.floor(F.col("__n") * F.lit(float(x))), F.lit(1)) for x in (test, holdout))
    return ranked.select(id_col, F.when(F.col("__r") <= n_test, "test").when(F.col("__r") <= n_test + n_hold, "holdout").otherwise("train").alias("part"))


def take_part(df: DataFrame, parts: DataFrame, id_col: str, part: str) -> DataFrame:
    """Rows of the entities of a part."""
    return df.join(parts.where(F.col("part") == part), id_col, "left_semi")


def capped(df: DataFrame, cap: int | None, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``cap`` rows, all of them without a cap."""
    return df if cap is None else smallest_hashes(df, cap, keys, seed)


def cap_subjects(df: DataFrame, id_col: str, cap: int | None, seed: int = 0) -> DataFrame:
    """All rows of at most ``cap`` entities."""
    return df if cap is None else df.join(smallest_hashes(df.select(id_col).distinct(), cap, [id_col], seed), id_col, "left_semi")


def train_test_split(df: DataFrame, frac: float, keys: Sequence[str], y: str | None = None, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test``: a share of each class of ``y`` (of all rows without it), rounded up."""
    ranked = hash_ranked(df, keys, seed, y)
    return ranked.withColumn("is_test", F.col("__r") <= F.ceil(F.col("__n") * F.lit(float(frac)))).drop("__r", "__n")


def member_candidates(train: DataFrame, holdout: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows with ``member``: from the lower half of train by hash, and as many from holdout. They are as many as half a table, so they are ranked range by range."""
    n = min(max(1, train.count() // 2), holdout.count())
    lower = lambda d, member: hash_ranked(d, keys, seed).where(F.col("__r") <= n).drop("__r", "__n").withColumn("member", F.lit(member))
    return lower(train, 1).unionByName(lower(holdout, 0))


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], replace: bool | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows with ``draw`` (0..n-1); with replacement where the pool is too small or where asked."""
    total = df.count()
    replace = n > total if replace is None else replace
    if not replace:
        return hash_ranked(df, keys, seed).where(F.col("__r") <= n).withColumn("draw", (F.col("__r") - 1).cast("long")).drop("__r", "__n")
    return bootstrap(df, n, keys, seed)


def bootstrap(df: DataFrame, n: int, keys: Sequence[str], seed: int = 0, draw: str = "draw") -> DataFrame:
    """``n`` draws with replacement: draw i is the row whose rank (by hash and keys) is a hash of i."""
    pool = hash_ranked(df, keys, seed).withColumn("__k", (F.col("__r") - 1).cast("long")).drop("__r", "__n")
    total = df.count()
    picks = df.sparkSession.range(n).select(F.col("id").alias(draw), F.pmod(hash_rank(seed, F.col("id")), F.lit(max(total, 1))).alias("__k"))
    return picks.join(pool, "__k").drop("__k")


def random_rows(df: DataFrame, n: int, numeric: Sequence[str], categorical: Sequence[str], seed: int = 0) -> DataFrame:
    """``n`` rows of independent uniform draws: numbers within each column's range, texts among its values.

    A category is drawn by its rank among the column's values. Ranks are counted over ranges of values and joined, so
    a column may have any number of them; a column without values stays null.
    """
    from ..functions.dist import running_sums
    from ..functions.scalars import hash_unit

    u = lambda c: hash_unit(seed, F.col("__id"), F.lit(c))
    out = df.sparkSession.range(n).withColumnRenamed("id", "__id")  # a column of the rows may be named so
    if numeric:
        ends = df.agg(*[x for c in numeric for x in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
        out = out.select("__id", *[(F.lit(ends[f"lo_{c}"]) + u(c) * (F.lit(ends[f"hi_{c}"]) - F.lit(ends[f"lo_{c}"]))).alias(c) for c in numeric])
    for c in categorical:
        values = df.select(F.lit(0).alias("column"), F.col(c).alias("value")).where("value is not null").distinct().withColumn("one", F.lit(1))
        ranked = running_sums(values, "column", "value", ["one"]).select((F.col("cum_one") - 1).alias("__rank"), F.col("value").alias(c))
        rank = F.floor(u(c) * F.lit(ranked.count()))
        out = out.withColumn("__rank", rank).join(ranked, "__rank", "left").drop("__rank")
    return out.select(F.col("__id").alias("id"), *numeric, *categorical)
