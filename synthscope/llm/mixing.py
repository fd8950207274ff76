"""Mixing sources to target weights by repetition rates.

A source whose target is ``rate`` times its size gives each document floor(rate) times, and
once more where the document's coin - a hash of seed and id - falls below a threshold. The
threshold is where the coins' order reaches the fraction of the source's *words*, so a source
of few or unequal documents meets its target as nearly as whole documents allow; in a large
one it is the fraction itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, n_words, stored

#: Weights that sources take in turn, in code-point order, null last.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated this often at most.
MOST = 3.0
#: Steps in which the threshold of a coin is set: what a source's coins are summed by before they are ordered.
STEPS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Targets share the total of all sizes by weight; one that would pass ``most`` times its
    source's size stops there and the excess goes to the others by weight. The water level
    has a closed form: sources stop in the order of size over weight, so one pass of running
    sums over the (small, one row per source) table of totals finds how many do.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    fullest = weighed.withColumn("reach", F.col("source_size") / F.col("weight")).withColumn("place", F.row_number().over(W.orderBy("reach", F.col("source").asc_nulls_last())))
    before = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    running = fullest.select(
        "*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("stopped"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("gone"), F.sum("source_size").over(W.partitionBy()).alias("total"), F.sum("weight").over(W.partitionBy()).alias("all_weight")
    ).withColumn("level", (F.col("total") - most * F.col("stopped")) / (F.col("all_weight") - F.col("gone")))
    # the level of the first source that the water does not fill; null if all are empty
    final = F.min(F.when(F.col("level") <= most * F.col("reach"), F.struct("place", "level"))).over(W.partitionBy())
    # windows over one row a source: the table of sources is what meets in one task
    return running.select("*", final.alias("f")).select("source", "source_size", F.when(F.col("place") < F.coalesce(F.col("f.place"), F.lit(2**31 - 1)), most * F.col("source_size")).otherwise(F.col("f.level") * F.col("weight")).alias("target"))


def coin(seed: int, doc_id: Column, text: Column) -> Column:
    """A whole number below ``STEPS`` that only the seed and the id decide (the text, where there is no id), on any engine with MD5."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit("null"))
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10).cast("long") % STEPS).cast("int")


def source_rates(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, threshold) from rows (source, size, coin).

    ``whole`` copies go to every document, one more to those with a coin below ``threshold``.
    Sizes are summed by source and coin first (within tasks, so a source of very many
    documents is not one task's work); at most ``STEPS`` sums a source are then ordered. A coin is in if the
    middle of its words lies below the words that are wanted.
    """
    sums = stored(sizes.groupBy("source", "coin").agg(F.sum("size").alias("size")))
    targets = source_targets(sums.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = stored(targets.withColumn("whole", F.floor(rate)).withColumn("wanted", (rate - F.col("whole")) * F.col("source_size")))
    before = W.partitionBy("source").orderBy("coin").rowsBetween(W.unboundedPreceding, -1)
    middles = sums.select(F.col("source").alias("of"), "coin", (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.col("size") / 2.0).alias("middle"))
    last = F.max(F.when(F.col("middle") < F.col("wanted"), F.col("coin") + 1))
    ends = middles.join(rates, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(F.coalesce(last, F.lit(0)).alias("threshold"))
    return stored(rates.join(ends, F.col("source").eqNullSafe(F.col("of"))).select("source", "source_size", "target", "whole", "threshold"))


def mix_plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, copies, taken.

    A null or blank text has size 0; a null source is a source of its own, last; rows of one
    id toss the same coin, rows without an id one by text; sources without words take nothing; texts of any length
    are only counted; other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), coin(seed, F.col("doc_id").cast("long"), text).alias("coin")))
    rates = source_rates(sized, weights, most).withColumnRenamed("source", "of")
    # one row per source, joined to all rows: the planner broadcasts it if its stored size allows
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("whole") + (F.col("coin") < F.col("threshold")).cast("long")
    return joined.select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 42) -> DataFrame:
    """The mix itself: rows of ``docs``, each as many times as the plan says, with ``copy`` (1, 2, ...), which takes
    the place of a column of that name.

    Rows are dealt by the rates of their source and their own coin, so no text is shuffled.
    Nulls, repeats and empty tables as in ``mix_plan``.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    toss = coin(seed, F.col("doc_id").cast("long"), text)
    rates = source_rates(docs.select(source.alias("source"), n_words(text).alias("size"), toss.alias("coin")), weights, most)
    name = fresh("rate", docs.columns)
    rates = rates.select(F.struct("source", "whole", "threshold").alias(name))
    joined = docs.join(rates, source.eqNullSafe(F.col(f"{name}.source")))
    copies = (F.col(f"{name}.whole") + (toss < F.col(f"{name}.threshold")).cast("long")).cast("int")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"]
    return joined.where(copies > 0).select(*kept, F.explode(F.sequence(F.lit(1), copies)).alias("copy"))
