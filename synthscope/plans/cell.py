"""All metrics of one synthetic table, and diagnostics of several."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import drop_id_columns, numeric_columns
from ..sources.io import kept
from . import privacy, quality, trajectory, utility
from .results import degenerate_flag, seed_statistics

LOG = logging.getLogger(__name__)

# Metrics of the bundle that come from the privacy report, and their names there.
PRIVACY = {
    "dcr_median": "dcr_median", "dcr_p05": "dcr_p05", "dcr_exact_match_rate": "exact_match_rate", "dcr_baseline_protection": "dcr_baseline_protection", "dcr_overfitting_protection": "dcr_overfitting_protection",
    "dcr_closer_to_training_pct": "dcr_closer_to_training", "mia_roc_auc": "mia_roc_auc", "mia_average_precision": "mia_average_precision", "mia_attacker_advantage": "mia_attacker_advantage",
}
TRAJECTORY = ("autocorr_distance", "stay_length_ks", "transition_mse_ratio", "temporal_corr_drift")
QUALITY = ("avg_ks_stat", "corr_frobenius", "range_violation_pct")
SCORES = ("accuracy", "balanced_accuracy", "f1", "macro_f1", "roc_auc")


def evaluate_cell(synth: DataFrame, real: DataFrame, tasks: Sequence[tuple[str, Callable, Sequence[int], Sequence[str]]], id_col: str, time_col: str, row_id: str, holdout: DataFrame | None = None, vitals=trajectory.VITALS, ranges=quality.CLINICAL_RANGES, cap: int | None = None, subject_cap: int | None = None, seed: int = 42) -> DataFrame:
    """One row with every metric of a synthetic table: utility of each task on both sides (columns
    ``<task>_<side>_<score>``), trajectories, quality, privacy and the flag of degenerate results.

    A task is (name, function of rows that gives (id, label), classes, columns not to be seen).
    ``row_id`` is a column of both tables that tells rows apart. A part that fails leaves its metrics
    null, and its error is logged. Both tables are stored once, and the parts run side by side. ``cap`` and ``subject_cap`` bound the rows of the privacy metrics and the subjects of the
    tasks, by hash; without them all take part. What comes to the driver are the single rows of the parts.
    """
    synth, real = kept(synth), kept(real)
    found: dict[str, float | None] = {}
    parts: list[Callable[[], None]] = []

    def part(names: Sequence[str], run: Callable[[], dict]) -> None:
        found.update(dict.fromkeys(names))
        parts.append(lambda: attempt(names, run))

    def attempt(names: Sequence[str], run: Callable[[], dict]) -> None:
        try:
            found.update({k: v for k, v in run().items() if k in found})
        except (PySparkException, ValueError, ArithmeticError):
            LOG.warning("no values for %s", ", ".join(names), exc_info=True)

    for name, label, classes, exclude in tasks:
        def utilities(name=name, label=label, classes=classes, exclude=exclude) -> dict:
            rows = utility.evaluate_sequence_task(name, synth.drop(row_id), real.drop(row_id), label, id_col, time_col, exclude, classes, cap=subject_cap, seed=seed).collect()
            return {f"{name}_{r['side']}_{s}": r[s] for r in rows for s in SCORES}

        part([f"{name}_{side}_{s}" for side in ("synth", "real") for s in SCORES], utilities)
    part(TRAJECTORY, lambda: trajectory.trajectory_metrics(real, synth, id_col, time_col, vitals).first().asDict())
    plain = [drop_id_columns(d.drop(row_id, id_col, time_col)) for d in (real, synth)]
    part(QUALITY, lambda: quality.quality_metrics(*plain, ranges).first().asDict())

    def leaks() -> dict:
        bare = lambda d: drop_id_columns(d).drop(id_col, time_col)
        row = privacy.privacy_metrics(bare(real), bare(synth), row_id, None if holdout is None else bare(holdout), cap=cap, seed=seed).first().asDict()
        return {k: row.get(n) for k, n in PRIVACY.items()}

    part(tuple(PRIVACY), leaks)
    utility.together(parts[-1:] + parts[:-1], len(parts))  # the longest first
    value = lambda k: F.lit(found[k]).cast("double").alias(k)
    names = [t[0] for t in tasks]
    auc, f1 = (F.lit(found.get(f"{n}_synth_{s}")).cast("double") for n, s in ((names[0] if names else "", "roc_auc"), (names[-1] if names else "", "macro_f1")))
    return real.sparkSession.range(1).select(*map(value, found), degenerate_flag(auc, f1).alias("degenerate_flag"))


def hour0_diagnostics(real: DataFrame, samples: DataFrame, model: str, seed: str, categorical: Sequence[str] = (), ranges=quality.CLINICAL_RANGES) -> DataFrame:
    """(model, metric, n, mean, std, ci95) over seeds of the quality of first-state samples.

    ``samples`` holds the samples of all models and seeds, told apart by two columns. For each: mean KS statistic, correlation
    distance, range violations, mean Wasserstein distance (plain and scaled), mean total
    variation and mean Jensen-Shannon distance of the categorical columns. Pairs of model
    and seed are few; each is a set of jobs over its own rows. Both tables are computed and stored once, however costly they are to make.
    """
    real, samples = kept(real), kept(samples)
    numbers = [c for c in numeric_columns(real) if c in samples.columns and c not in (model, seed, *categorical)]
    rows = None
    for pair in samples.select(model, seed).distinct().orderBy(model, seed).collect():  # a row a model and seed
        own = samples.where((F.col(model) == pair[0]) & (F.col(seed) == pair[1])).drop(model, seed)
        parts = [quality.quality_metrics(real, own, ranges), dist.wasserstein(real, own, numbers).agg(F.avg("wasserstein").alias("wasserstein_mean"), F.avg("scaled").alias("wasserstein_scaled_mean"))]
        if categorical:
            parts += [dist.total_variation(real, own, categorical).agg(F.avg("tv").alias("tv_mean")), dist.js_distance(real, own, categorical).agg(F.avg("js").alias("js_mean"))]
        one = parts[0]
        for p in parts[1:]:
            one = one.crossJoin(p)  # single rows
        long = one.select(F.lit(pair[0]).alias(model), F.lit(pair[1]).alias(seed), *[F.col(c).cast("double") for c in one.columns]).unpivot([model, seed], one.columns, "metric", "value")
        rows = long if rows is None else rows.unionByName(long)
    if rows is None:
        raise ValueError("no samples")
    return seed_statistics(rows, [model, "metric"], "value", normal=True)
