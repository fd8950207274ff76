"""Privacy of a synthetic table: distances to the nearest real records, and membership attacks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.dist import quantiles
from ..functions.rank import rank_metrics
from ..functions.scalars import clean, min_max
from ..operators.knn import Search, nearest, reference
from ..operators.split import capped, member_candidates, random_rows, train_test_split
from ..sources.io import kept
from .utility import together

TINY = 1e-12
MISSING = "__MISSING__"


@dataclass
class DistanceEncoder:
    """Scales numbers by the train table's range (missing: its median) and marks missing categories."""

    numeric: list[str]
    categorical: list[str]
    stats: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, others: Sequence[DataFrame] = (), drop: Sequence[str] = ()) -> DistanceEncoder:
        common = sorted(set.intersection(set(train.columns), *[set(o.columns) for o in others]) - set(drop))
        numeric = [c for c in common if c in numeric_columns(train)]
        v = {c: clean(F.col(f"`{c}`")) for c in numeric}
        found = {r["column"]: (r["q0"], r["q2"], r["q1"]) for r in quantiles(train.select(*[v[c].alias(c) for c in numeric]), numeric, [0.0, 0.5, 1.0]).collect()} if numeric else {}
        stats = {c: found.get(c, (0.0, 0.0, 0.0)) for c in numeric}
        return cls(numeric, [c for c in common if c not in numeric], stats)

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        numbers = [min_max(clean(F.col(f"`{c}`")), *map(F.lit, self.stats[c])).alias(c) for c in self.numeric]
        return df.select(*keep, *numbers, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING)).alias(c) for c in self.categorical])

    def reference(self, ref: DataFrame, k: int, id_col: str) -> Search:
        return reference(self.encode(ref, [id_col]), self.numeric, self.categorical, k, id_col)

    def nearest(self, query: DataFrame, ref: DataFrame | Search, k: int, id_col: str) -> DataFrame:
        return nearest(self.encode(query, [id_col]), ref if isinstance(ref, Search) else self.encode(ref, [id_col]), self.numeric, self.categorical, k, id_col, id_col)


@dataclass
class Closest:
    """What several metrics ask of the training rows, made once: their encoder, the rows cut into cells, and each synthetic row's two nearest."""

    enc: DistanceEncoder
    train: Search
    synth: DataFrame

    @classmethod
    def of(cls, train: DataFrame, synth: DataFrame, id_col: str, drop: Sequence[str] = (), cap: int | None = None, seed: int = 0) -> Closest:
        enc = DistanceEncoder.fit(train, [synth], [id_col, *drop])
        search = enc.reference(capped(train, cap, [id_col], seed), 2, id_col)
        return cls(enc, search, enc.nearest(capped(synth, cap, [id_col], seed), search, 2, id_col))

    def covers(self, holdout: DataFrame) -> bool:
        """Whether a holdout has all columns, so that distances with regard to it are the same."""
        return {*self.enc.numeric, *self.enc.categorical} <= set(holdout.columns)


def _first(n: int = 0):
    return F.get(F.col("d"), n)


def distance_to_closest_record(train: DataFrame, synth: DataFrame, id_col: str, drop: Sequence[str] = (), cap: int | None = None, seed: int = 0, closest: Closest | None = None) -> DataFrame:
    """One row: mean, median and percentiles of the distance to the nearest real record, share of
    exact matches, and the median ratio of the nearest to the second nearest (null with one real record)."""
    d = (closest or Closest.of(train, synth, id_col, drop, cap, seed)).synth.select(_first().alias("d1"), F.when(F.size("d") > 1, _first() / F.greatest(_first(1), F.lit(TINY))).alias("ratio"))
    means = d.agg(F.avg("d1").alias("dcr_mean"), F.avg(F.when(F.col("d1") <= TINY, 1.0).otherwise(0.0)).alias("exact_match_rate"))
    q = quantiles(d, ["d1", "ratio"], [0.5, 0.05, 0.95])
    pick = lambda c, k: F.max(F.when(F.col("column") == c, F.col(k)))
    ends = q.agg(pick("d1", "q0").alias("dcr_median"), pick("d1", "q1").alias("dcr_p05"), pick("d1", "q2").alias("dcr_p95"), pick("ratio", "q0").alias("nndr_median"))
    return means.crossJoin(ends).select("dcr_mean", "dcr_median", "dcr_p05", "dcr_p95", "exact_match_rate", "nndr_median")  # single rows


def exact_match_rate(train: DataFrame, synth: DataFrame, id_col: str, drop: Sequence[str] = ()) -> DataFrame:
    """One row: share of synthetic rows equal to a real one, by an equi-join on all encoded columns."""
    enc = DistanceEncoder.fit(train, [synth], [id_col, *drop])
    names = [*enc.numeric, *enc.categorical]
    real = enc.encode(train).select(*names).distinct().withColumn("__hit", F.lit(1))
    return enc.encode(synth).join(real, names, "left").agg(F.avg(F.coalesce("__hit", F.lit(0))).alias("exact_match_rate"))


def dcr_baseline_protection(train: DataFrame, synth: DataFrame, id_col: str, drop: Sequence[str] = (), random: DataFrame | None = None, cap: int | None = None, seed: int = 0, closest: Closest | None = None) -> DataFrame:
    """One row: median distance of synthetic rows over that of random rows, at most 1; null if the latter is 0."""
    closest = closest or Closest.of(train, synth, id_col, drop, cap, seed)
    enc = closest.enc
    if random is None:
        n = capped(synth, cap, [id_col], seed).count()
        random = random_rows(train, n, enc.numeric, enc.categorical, seed).withColumnRenamed("id", id_col)
    median = lambda df, name: quantiles(df.select(_first().alias("d")), ["d"], [0.5]).agg(F.max("q0").alias(name))
    a = median(closest.synth, "synth_median")
    b = median(enc.nearest(random, closest.train, 1, id_col), "random_median")
    return a.crossJoin(b).withColumn("dcr_baseline_protection", F.when(F.col("random_median") > 0, F.least(F.lit(1.0), F.col("synth_median") / F.col("random_median"))))  # single rows


def dcr_overfitting_protection(train: DataFrame, holdout: DataFrame, synth: DataFrame, id_col: str, drop: Sequence[str] = (), cap: int | None = None, seed: int = 0, closest: Closest | None = None) -> DataFrame:
    """One row: how far synthetic rows are from leaning towards training rather than holdout rows."""
    closest = closest if closest and closest.covers(holdout) else None
    enc = closest.enc if closest else DistanceEncoder.fit(train, [holdout, synth], [id_col, *drop])
    s = capped(synth, cap, [id_col], seed)
    t = (closest.synth if closest else enc.nearest(s, capped(train, cap, [id_col], seed), 1, id_col)).select("id", _first().alias("t"))
    h = enc.nearest(s, capped(holdout, cap, [id_col], seed), 1, id_col).select("id", _first().alias("h"))
    both = t.join(h, "id")
    share = both.agg(F.avg(F.when(F.col("t") < F.col("h"), 1.0).otherwise(0.0)).alias("share"))
    q = quantiles(both, ["t", "h"], [0.5])
    medians = q.agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(n) for c, n in (("t", "median_train"), ("h", "median_holdout"))])
    sums = share.crossJoin(medians)  # single rows
    return sums.select(F.least(F.greatest((1 - F.col("share")) * 2, F.lit(0.0)), F.lit(1.0)).alias("dcr_overfitting_protection"), F.col("share").alias("dcr_closer_to_training"), "median_train", "median_holdout")


def membership_scores(candidates: DataFrame, reference: DataFrame, synth: DataFrame, enc: DistanceEncoder, id_col: str) -> DataFrame:
    """(id, member, score): log ratio of the distances to a reference table and to the synthetic one."""
    ref = enc.nearest(candidates, reference, 1, id_col).select("id", _first().alias("r"))
    syn = enc.nearest(candidates, synth, 1, id_col).select("id", _first().alias("s"))
    return candidates.select(F.col(id_col).cast("long").alias("id"), "member").join(ref, "id").join(syn, "id").select("id", "member", F.ln((F.col("r") + TINY) / (F.col("s") + TINY)).alias("score"))


def attack_metrics(scores: DataFrame) -> DataFrame:
    """One row: AUC, average precision, advantage at threshold 0 and mean scores of a membership attack."""
    ranks = rank_metrics(scores, "member", "score").select(F.col("roc_auc").alias("mia_roc_auc"), F.col("average_precision").alias("mia_average_precision"))
    hit = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    rate = lambda m: F.avg(F.when(F.col("member") == m, hit))
    rest = scores.agg((rate(1) - rate(0)).alias("mia_attacker_advantage"), F.avg(F.when(F.col("member") == 1, F.col("score"))).alias("member_mean"), F.avg(F.when(F.col("member") == 0, F.col("score"))).alias("nonmember_mean"))
    return ranks.crossJoin(rest)  # single rows


def membership_inference(train: DataFrame, holdout: DataFrame, synth: DataFrame, id_col: str, drop: Sequence[str] = (), cap: int | None = None, seed: int = 0, closest: Closest | None = None) -> DataFrame:
    """One row of attack metrics; nulls when the holdout or either candidate side has fewer than four rows.

    Half of the holdout is the reference, the other half are the non-members.
    """
    enc = closest.enc if closest and closest.covers(holdout) else DistanceEncoder.fit(train, [holdout, synth], [id_col, *drop])
    halves = kept(train_test_split(capped(holdout, cap, [id_col], seed), 0.5, [id_col], seed=seed))
    outside, reference = halves.where("is_test").drop("is_test"), halves.where("not is_test").drop("is_test")
    both = kept(member_candidates(capped(train, cap, [id_col], seed), outside, [id_col], seed))
    n = both.groupBy().pivot("member", [0, 1]).count().first()
    if min(reference.count(), n["0"] or 0, n["1"] or 0) < 4:
        return train.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("mia_roc_auc", "mia_average_precision", "mia_attacker_advantage", "member_mean", "nonmember_mean")])
    return attack_metrics(membership_scores(both, reference, synth, enc, id_col))


def privacy_metrics(real: DataFrame, synth: DataFrame, id_col: str, holdout: DataFrame | None = None, frac: float = 0.3, drop: Sequence[str] = (), cap: int | None = None, seed: int = 0) -> DataFrame:
    """One row with all of them; without a holdout, ``frac`` of the real rows are held out by hash.

    Tables are computed and stored once, and each synthetic row is looked for among the training rows once for all metrics. The
    metrics' searches run side by side.
    """
    synth = kept(synth)
    if holdout is not None:
        train, holdout = kept(real), kept(holdout)
    else:
        parts = kept(train_test_split(real, frac, [id_col], seed=seed))
        train, holdout = parts.where("not is_test").drop("is_test"), parts.where("is_test").drop("is_test")
    args = dict(drop=drop, cap=cap, seed=seed, closest=Closest.of(train, synth, id_col, drop, cap, seed))
    jobs = [
        lambda: distance_to_closest_record(train, synth, id_col, **args), lambda: dcr_baseline_protection(train, synth, id_col, **args),
        lambda: dcr_overfitting_protection(train, holdout, synth, id_col, **args), lambda: membership_inference(train, holdout, synth, id_col, **args),
    ]
    counts = train.agg(F.count("*").alias("n_train")).crossJoin(holdout.agg(F.count("*").alias("n_holdout"))).crossJoin(synth.agg(F.count("*").alias("n_synth")))
    return reduce(DataFrame.crossJoin, [*together(jobs), counts])  # single rows
