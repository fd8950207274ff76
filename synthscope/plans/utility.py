"""Utility of a synthetic table: train on it, test on real rows."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.rank import class_roc_auc, classification_metrics
from ..functions.scalars import bin_by_edges, clean, one_hot, padded, presence, round_clip, standardise
from ..operators.grid import any_label, first_rows
from ..operators.impute import column_medians, column_modes
from ..operators.split import smallest_hashes, train_test_split
from ..sources.io import kept

# Columns that give an outcome away, and marks of aggregate columns in unflattened names.
LEAKY = """subject_id hadm_id icustay_id trajectory_id timestep hours_in charttime admittime intime dischtime outtime deathtime hospital_expire_flag
mort_icu mort_hosp dnr_first_charttime timecmo_chart discharge_location hospstay_seq readmission_30 los_icu los_hospital""".split()
LEAKY_MARKS = ("count)", "mean)", "std)", "min)", "max)", "median)", "sum)")


def drop_leaky_columns(df: DataFrame, extra: Sequence[str] = (), suffixes: bool = False) -> DataFrame:
    """Without ids, times, outcomes and aggregate columns; ``suffixes`` also takes flattened names (``_mean``)."""
    marks = [*LEAKY_MARKS, *([f"_{m[:-1]}" for m in LEAKY_MARKS] if suffixes else [])]
    return df.drop(*LEAKY, *extra, *[c for c in df.columns if any(m in c.lower() for m in marks)])


@dataclass
class FeaturePlan:
    """Filling, levels and scaling learnt from one table, applied to others."""

    numeric: list[str]
    categorical: dict[str, list[str]]
    fills: dict
    scale: dict

    @classmethod
    def fit(cls, df: DataFrame, others: Sequence[DataFrame] = (), exclude: Sequence[str] = ()) -> FeaturePlan:
        """Numbers take the median, texts the mode; levels come from all tables, the first is dropped."""
        feats = drop_leaky_columns(df, exclude)
        numeric = [c for c in feats.columns if c in numeric_columns(feats)]
        texts = [c for c in feats.columns if c not in numeric]
        fills = column_medians(df, numeric) | column_modes(df, texts)
        every = [t.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in texts]) for t in (df, *others)] if texts else []
        union = every[0] if every else None
        for t in every[1:]:
            union = union.unionByName(t)
        row = union.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in texts]).first() if texts else {}
        levels = {c: sorted({*row[c], str(fills[c])}) for c in texts}
        filled = {c: F.coalesce(clean(F.col(f"`{c}`")), F.lit(fills[c] if fills[c] is not None else 0.0).cast("double")) for c in numeric}
        stats = df.agg(*[x for i, c in enumerate(numeric) for x in (F.avg(filled[c]).alias(f"m{i}"), F.stddev_pop(filled[c]).alias(f"s{i}"))]).first() if numeric else {}
        return cls(numeric, levels, fills, {c: (stats[f"m{i}"] or 0.0, stats[f"s{i}"] or 0.0) for i, c in enumerate(numeric)})

    def columns(self) -> list[Column]:
        fill = lambda c: F.coalesce(clean(F.col(f"`{c}`")), F.lit(self.fills[c] if self.fills[c] is not None else 0.0).cast("double"))
        out = [standardise(fill(c), *map(F.lit, self.scale[c])).alias(c) for c in self.numeric]
        for c, levels in self.categorical.items():
            out += one_hot(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(str(self.fills[c]))), levels, c, drop_first=True)
        return out

    def features(self, df: DataFrame, *keep) -> DataFrame:
        return df.select(*keep, F.array(*[c.cast("double") for c in self.columns()]).alias("x"))


def mortality_label(rows: DataFrame, id_col: str, time_col: str, flag: str = "hospital_expire_flag") -> DataFrame:
    """(id, label): the first known flag, rounded and clipped; subjects without one are left out."""
    known = F.col(flag).isNotNull()
    return rows.groupBy(id_col).agg(F.min_by(round_clip(F.col(flag)), F.when(known, F.col(time_col))).alias("label")).where("label is not null")


def vasopressor_label(rows: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    """(id, label): whether any of the columns is ever on."""
    return any_label(rows, id_col, F.greatest(*[F.col(c).cast("double") for c in names], F.lit(0.0)))


def los_label(rows: DataFrame, id_col: str, time_col: str, los: str | None = "los_icu") -> DataFrame:
    """(id, label): under 2, under 7, or more days; the first known stay, else the last hour."""
    hours = F.greatest(F.max(time_col), F.lit(0)) / 24.0
    days = F.coalesce(F.min_by(F.col(los).cast("double"), F.when(F.col(los).isNotNull(), F.col(time_col))), hours) if los and los in rows.columns else hours
    return rows.groupBy(id_col).agg(bin_by_edges(days).alias("label"))


def extract_sequences(rows: DataFrame, plan: FeaturePlan, labels: DataFrame, id_col: str, time_col: str, cap: int | None = None, seed: int = 0) -> DataFrame:
    """(id, label, steps): each labelled subject's feature arrays in the order of time (unknown times as 0)."""
    if cap is not None:
        labels = smallest_hashes(labels, cap, [id_col], seed)
    steps = plan.features(rows.where(F.col(id_col).isNotNull()), id_col, F.coalesce(F.col(time_col), F.lit(0)).alias("__t"))
    seqs = steps.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("__t", "x"))), lambda s: s["x"]).alias("steps"))
    return seqs.join(labels, id_col).select(F.col(id_col).alias("id"), "label", "steps")


def vectorise(seqs: DataFrame, max_len: int, width: int) -> DataFrame:
    """(id, label, x): steps cut or padded to one length, then which places are filled, then the share of the length."""
    flat = padded(F.flatten(F.slice("steps", 1, max_len)), max_len * width)
    share = F.least(F.size("steps"), F.lit(max_len)) / F.lit(float(max_len))
    return seqs.select("id", "label", F.concat(flat, presence(F.col("steps"), max_len), F.array(share)).alias("x"))


def balanced(rows: DataFrame) -> tuple[DataFrame, int]:
    """Distinct rows (x, label) with the weight ``w`` that makes all classes weigh the same in all, and the number of rows.

    Equal rows are one, with their weights' sum: a loss tells no more of them, and an iteration's work grows with what differs. The rows are read once.
    """
    counted = kept(rows.where("label is not null").groupBy("x", "label").agg(F.count("*").alias("n")))
    counts = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # a row a class
    n = sum(counts.values())
    weights = F.create_map(*[F.lit(v) for label, m in sorted(counts.items()) for v in (label, n / (len(counts) * m))]) if counts else None
    return counted.select("x", "label", ((weights[F.col("label")] if counts else F.lit(1.0)) * F.col("n")).alias("w")), n


def fit_classifier(rows: DataFrame, c: float = 1.0, l1: bool = False, max_iter: int = 500, tol: float = 1e-6):
    """Balanced logistic regression on (x, label): each class weighs the same in all."""
    data, n = balanced(rows)
    data = data.select(array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "w")
    return LogisticRegression(weightCol="w", regParam=1.0 / (c * max(n, 1)), elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=max_iter, tol=tol).fit(data)


def optimality(model, rows: DataFrame, c: float = 1.0, l1: bool = False, tol: float = 1e-3) -> DataFrame:
    """(feature, weight, gradient, excess, optimal) of a fitted two-class model on the rows (x, label) it was fitted on; feature -1 is the intercept.

    ``gradient`` is the weighted loss's, per unit of weight; with the penalty it has to vanish. ``excess`` is how far it is
    from that: with L1, a weight of 0 allows any gradient up to the penalty, another weight needs a gradient
    of the penalty's size against its sign; with L2, the gradient is minus the weight times the penalty.
    """
    data, n = balanced(rows)
    weights, penalty = [float(w) for w in model.coefficients.toArray()], 1.0 / (c * max(n, 1))
    z = F.lit(float(model.intercept)) + F.aggregate(F.zip_with("x", F.lit(weights), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    miss = F.col("w") * (1 / (1 + F.exp(-z)) - F.col("label"))
    cells = data.select(miss.alias("miss"), F.posexplode(F.concat("x", F.array(F.lit(1.0))))).groupBy("pos").agg((F.sum(F.col("miss") * F.col("col")) / n).alias("gradient"))
    feature = F.when(F.col("pos") == len(weights), -1).otherwise(F.col("pos")).cast("int")
    weight = F.get(F.lit([*weights, float(model.intercept)]), F.col("pos"))
    g, sign = F.col("gradient"), F.signum("weight")
    pull = F.when(F.col("weight") != 0, F.abs(g + sign * penalty)).otherwise(F.greatest(F.abs(g) - penalty, F.lit(0.0))) if l1 else F.abs(g + F.col("weight") * penalty)
    out = cells.select(feature.alias("feature"), weight.alias("weight"), "gradient").withColumn("excess", F.when(F.col("feature") == -1, F.abs(g)).otherwise(pull))
    return out.withColumn("optimal", F.col("excess") <= tol)


def scored(model, rows: DataFrame) -> DataFrame:
    """(label, prediction, p0, p1, ...)"""
    out = model.transform(rows.select(array_to_vector("x").alias("features"), "label"))
    p = vector_to_array("probability")
    return out.select("label", F.col("prediction").cast("int").alias("prediction"), *[F.get(p, k).alias(f"p{k}") for k in range(model.numClasses)])


EMPTY = "accuracy double, balanced_accuracy double, f1 double, macro_f1 double, weighted_f1 double, roc_auc double"


def empty_metrics(spark) -> DataFrame:
    return spark.createDataFrame([(None,) * 6], EMPTY)


def evaluate_scores(rows: DataFrame, classes: Sequence[int]) -> DataFrame:
    """One row: classification metrics and AUC (one class against the rest, averaged, beyond two), computed here and now."""
    rows = kept(rows)
    have = [c for c in rows.columns if c.startswith("p") and c[1:].isdigit()]
    out = classification_metrics(rows, "label", "prediction").crossJoin(class_roc_auc(rows, "label", have))  # single rows
    return rows.sparkSession.createDataFrame(out.collect(), out.schema)


class Task(ABC):
    """A prediction task; subclasses say what the label is and what must not be seen."""

    classes: Sequence[int] = (0, 1)

    def __init__(self, name: str, seed: int = 0):
        self.name, self.seed = name, seed

    @abstractmethod
    def prepare_target(self) -> Column:
        """Label of a row."""

    def get_exclude_cols(self) -> list[str]:
        return []

    def get_model(self, rows: DataFrame):
        return fit_classifier(rows)

    def evaluate(self, synth: DataFrame, real: DataFrame, id_cols: Sequence[str], test_size: float = 0.3) -> DataFrame:
        """(task, side, metrics): a model of synthetic rows and one of real training rows, on the real test rows."""
        drop = [*self.get_exclude_cols(), *id_cols]
        label = self.prepare_target()
        synth, real = (d.withColumn("__label", label).where("__label is not null") for d in (synth, real))
        plan = FeaturePlan.fit(synth.drop("__label"), [real.drop("__label")], drop)
        keep = F.col("__label").alias("label")
        parts = kept(plan.features(train_test_split(real, test_size, id_cols, "__label", self.seed), keep, "is_test"))
        sides = {"synth": kept(plan.features(synth, keep)), "real": parts.where("not is_test").drop("is_test")}
        test = parts.where("is_test").drop("is_test")
        out = None
        for side, train in sides.items():
            ok = train.select("label").distinct().count() >= 2 and test.select("label").distinct().count() >= 2
            got = evaluate_scores(scored(self.get_model(train), test), self.classes) if ok else empty_metrics(real.sparkSession)
            got = got.select(F.lit(self.name).alias("task"), F.lit(side).alias("side"), "*")
            out = got if out is None else out.unionByName(got)
        return out


class ColumnTask(Task):
    """A task whose label is an expression over a row's columns."""

    def __init__(self, name: str, label: Column, exclude: Sequence[str] = (), classes: Sequence[int] = (0, 1), seed: int = 0):
        super().__init__(name, seed)
        self.label, self.exclude, self.classes = label, list(exclude), classes

    def prepare_target(self) -> Column:
        return self.label

    def get_exclude_cols(self) -> list[str]:
        return self.exclude


def together(jobs: list[Callable], threads: int = 4) -> list:
    """Independent jobs, a few at a time."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def _stacked(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def evaluate_multi_task(synth: DataFrame, real: DataFrame, tasks: Sequence[Task], id_cols: Sequence[str], test_size: float = 0.3) -> DataFrame:
    """(task, side, metrics) of several tasks. Both tables are read once and kept, and the tasks run side by side."""
    synth, real = kept(synth), kept(real)
    return _stacked(together([lambda t=t: t.evaluate(synth, real, id_cols, test_size) for t in tasks]))


def evaluate_sequence_task(name: str, synth: DataFrame, real: DataFrame, label: Callable[[DataFrame], DataFrame], id_col: str, time_col: str, exclude: Sequence[str] = (), classes: Sequence[int] = (0, 1), test_size: float = 0.3, max_len: int | None = None, cap: int | None = None, seed: int = 0) -> DataFrame:
    """As ``Task.evaluate``, a subject at a time: its steps padded to one length are the features."""
    plan = FeaturePlan.fit(synth, [real], [id_col, time_col, *exclude])
    width = len(plan.columns())
    seqs = {side: extract_sequences(d, plan, label(d), id_col, time_col, cap, seed).persist() for side, d in (("synth", synth), ("real", real))}
    length = max_len or max(s.agg(F.max(F.size("steps"))).first()[0] or 1 for s in seqs.values())
    vectors = {side: vectorise(s, length, width) for side, s in seqs.items()}
    parts = train_test_split(vectors["real"], test_size, ["id"], "label", seed).persist()
    test = parts.where("is_test")

    def fitted(side: str, train: DataFrame) -> DataFrame:
        ok = train.select("label").distinct().count() >= 2 and test.select("label").distinct().count() >= 2
        got = evaluate_scores(scored(fit_classifier(train), test), classes) if ok else empty_metrics(real.sparkSession)
        return got.select(F.lit(name).alias("task"), F.lit(side).alias("side"), "*")

    out = _stacked(together([lambda: fitted("synth", vectors["synth"]), lambda: fitted("real", parts.where("not is_test"))]))
    for frame in (parts, *seqs.values()):
        frame.unpersist()
    return out


def first_row_features(rows: DataFrame, label: Column, id_col: str, time_col: str, exclude: Sequence[str] = ()) -> tuple[list[str], DataFrame]:
    """Names of the numeric features, and (x, label) of each subject's first values."""
    first = first_rows(rows, id_col, time_col).withColumn("__label", label).where("__label is not null")
    plan = FeaturePlan.fit(first.drop("__label"), (), [id_col, time_col, *exclude])
    plan.categorical = {}
    return plan.numeric, plan.features(first, F.col("__label").alias("label"))


def rank_topk_features(rows: DataFrame, label: Column, id_col: str, time_col: str, k: int, exclude: Sequence[str] = ()) -> list[str]:
    """Features with the greatest absolute weights of an L1 model on each subject's first values."""
    names, data = first_row_features(rows, label, id_col, time_col, exclude)
    weights = fit_classifier(data, c=0.5, l1=True).coefficients.toArray()
    order = sorted(range(len(weights)), key=lambda i: (-abs(weights[i]), names[i]))
    return [names[i] for i in order[:k]]


def feature_ablation(synth: DataFrame, real: DataFrame, task: Task, ranked: Sequence[str], ks: Sequence[int], id_cols: Sequence[str], seeds: Sequence[int] = (0,), test_size: float = 0.3) -> DataFrame:
    """(features, seed, metrics) of the task with all features and with the first k ranked ones.

    Each table is read once: its features are computed and kept, and every fit takes its share of the array. Features
    are filled and scaled column by column, so a share is what a fit on these columns alone would see. There is one split a seed; fits run side by side.
    """
    label, drop = task.prepare_target(), [*task.get_exclude_cols(), *id_cols]
    synth, real = (d.withColumn("__label", label).where("__label is not null") for d in (synth, real))
    plan = FeaturePlan.fit(synth.drop("__label"), [real.drop("__label")], drop)
    places: dict[str, list[int]] = {c: [i] for i, c in enumerate(plan.numeric)}
    at = len(places)
    for c, levels in plan.categorical.items():
        places[c] = list(range(at, at + len(levels) - 1))
        at += len(levels) - 1
    train = kept(plan.features(synth, F.col("__label").alias("label")))
    tests = {seed: kept(train_test_split(plan.features(real, *id_cols, F.col("__label").alias("label")), test_size, id_cols, "label", seed).where("is_test")) for seed in seeds}
    sets = [("all", list(range(at))), *[(f"top{k}", [i for c in ranked[:k] for i in places.get(c, [])]) for k in ks]]

    def fitted(name: str, own: list[int], seed: int) -> DataFrame:
        share = lambda d: d.select("label", F.array(*[F.get("x", i) for i in own]).cast("array<double>").alias("x"))
        fit, test = share(train), share(tests[seed])
        ok = own and all(d.select("label").distinct().count() >= 2 for d in (fit, test))
        got = evaluate_scores(scored(task.get_model(fit), test), task.classes) if ok else empty_metrics(real.sparkSession)
        return got.select(F.lit(name).alias("features"), F.lit(seed).alias("seed"), "accuracy", "f1", "roc_auc")

    return _stacked(together([lambda n=name, o=own, s=seed: fitted(n, o, s) for name, own in sets for seed in seeds]))
