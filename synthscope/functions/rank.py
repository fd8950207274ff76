"""Scores against labels: rank statistics with ties, and confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import running_sums


def rank_metrics(rows: DataFrame, y: str, score: str, by: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, roc_auc, average_precision) of a 0/1 label and a score, for each value of ``by``.

    Rows are first counted by score, so what is ranked is distinct scores; the ranking is a
    running sum. AUC counts ties half; average precision steps from score to score. Both are
    null with one class only.
    """
    key = F.lit("all") if by is None else F.col(by).cast("string")
    counts = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(key.alias("by"), F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) > 0, 0).otherwise(1)).alias("neg"))
    cum = running_sums(counts, "by", "score", ["pos", "neg"]).withColumnsRenamed({"all_pos": "n_pos", "all_neg": "n_neg"})
    p, n = F.col("n_pos"), F.col("n_neg")
    above_pos, above_neg = p - F.col("cum_pos") + F.col("pos"), n - F.col("cum_neg") + F.col("neg")  # at this score or higher
    wins = F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)
    steps = F.when(F.col("pos") > 0, F.col("pos") * above_pos / (above_pos + above_neg)).otherwise(F.lit(0.0))
    sums = cum.groupBy("by", "n_pos", "n_neg").agg(F.sum(wins).alias("wins"), F.sum(steps).alias("steps"))
    both = (p > 0) & (n > 0)
    return sums.select("by", "n_pos", "n_neg", F.when(both, F.col("wins") / (p * n)).alias("roc_auc"), F.when(both, F.col("steps") / p).alias("average_precision"))


def roc_auc(rows: DataFrame, y: str, score: str) -> DataFrame:
    return rank_metrics(rows, y, score).select("roc_auc")


def macro_roc_auc(rows: DataFrame, y: str, scores: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """One row: mean one-versus-rest AUC over classes (all must occur, each with its score column); null where one is missing."""
    cells = F.array(*[F.struct(F.lit(k).alias("class"), (F.col(y) == k).cast("int").alias("is"), F.col(s).alias("score")) for k, s in zip(classes, scores, strict=True)])
    long = rows.where(F.col(y).isNotNull()).select(F.explode(cells).alias("c")).select("c.class", "c.is", "c.score")
    per = rank_metrics(long, "is", "score", "class")
    return per.agg(F.when(F.count("roc_auc") == len(classes), F.avg("roc_auc")).alias("roc_auc"))


def class_roc_auc(rows: DataFrame, y: str, scores: Sequence[str]) -> DataFrame:
    """One row: AUC of class scores (column k for class k) against the classes that occur.

    Two classes: the score of the greater one against it (the second of two columns, else the
    column of its number, else the last). More: the mean of one against the rest, by order where there
    are as many columns as classes, else by number. One class, or a class without a column: null.
    """
    classes = sorted(r[0] for r in rows.where(F.col(y).isNotNull()).select(F.col(y).cast("int")).distinct().collect())  # a row a class
    none = rows.sparkSession.range(1).select(F.lit(None).cast("double").alias("roc_auc"))
    if len(classes) < 2 or not scores:
        return none
    if len(classes) == 2:
        at = 1 if len(scores) == 2 else classes[1] if 0 <= classes[1] < len(scores) else len(scores) - 1
        return roc_auc(rows.where(F.col(y).isNotNull()).select((F.col(y) == classes[1]).cast("int").alias("is"), F.col(scores[at]).alias("score")), "is", "score")
    if len(scores) == len(classes):
        return macro_roc_auc(rows, y, scores, classes)
    if all(0 <= k < len(scores) for k in classes):
        return macro_roc_auc(rows, y, [scores[k] for k in classes], classes)
    return none


def classification_metrics(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """One row: accuracy, balanced accuracy, F1 of class 1, macro and weighted F1; 0 where a ratio has no base."""
    counts = rows.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).agg(F.count("*").alias("n"))
    flows = counts.select(F.explode(F.array(F.struct(F.col("y").alias("k"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")))).alias("f")).select("f.*")
    per = flows.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said"))
    f1 = F.when(F.col("real") + F.col("said") > 0, 2.0 * F.col("tp") / (F.col("real") + F.col("said"))).otherwise(F.lit(0.0))
    return per.withColumn("f1", f1).agg(
        (F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg(F.when(F.col("real") > 0, F.col("tp") / F.col("real"))).alias("balanced_accuracy"),
        F.coalesce(F.max(F.when(F.col("k") == 1, F.col("f1"))), F.lit(0.0)).alias("f1"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("real")) / F.sum("real")).alias("weighted_f1"),
    )
