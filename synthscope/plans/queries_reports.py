"""Registered queries of reports: result tables, labels and sequences, bundles of metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rank
from ..functions import scalars as S
from . import cell, privacy, results, trajectory, utility
from .queries import _HOLD, _KNOWN, _PR, _PS, _RANGES, _SEEDS, _TRAIN, ORACLES, REAL, SYNTH, _parts, _seeds, query, real_synth
from .queries import _pairs as _long_pairs

# --- result tables ----------------------------------------------------------------------------


@query(f"SELECT cell, metric, avg(value) AS value FROM {_SEEDS} GROUP BY cell, metric", "value", "cell metric", 4)
def averaged_metrics(t):
    return results.average_metrics(_seeds(t), ["cell"])


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN false ELSE p_size / 50.0 <= 0.55 AND p_retailprice / 10000 <= 0.15 END AS degenerate FROM part")
def degenerate_flags(t):
    auc = F.when(F.col("p_size") % 7 == 0, float("nan")).otherwise(F.col("p_size") / 50.0)
    return t("part").select("p_partkey", results.degenerate_flag(auc, F.col("p_retailprice") / 10000).alias("degenerate"))


_METRIC_OF = {"F": "synth_roc_auc", "O": "los_synth_macro_f1", "P": "avg_ks_stat"}
_LONG = "(SELECT (o_orderkey % 3 + 1)::INT AS nt, (o_orderkey % 2 + 1)::INT AS n_noise, (o_orderkey % 5)::INT AS seed, o_orderstatus AS metric, avg(o_totalprice) / 500000 AS value FROM orders GROUP BY ALL)"
_CELL = f"(SELECT nt, n_noise, metric, avg(value) AS mean, stddev_samp(value) AS s, count(*) AS n FROM {_LONG} GROUP BY nt, n_noise, metric)"
_pick = lambda x, m: f"max(CASE WHEN metric = '{m}' THEN round_even({x}, 4) END)"
_CI = "[12.706205, 4.302653, 3.182446, 2.776445][n - 1] * s / sqrt(n)"


@query(
    f"SELECT c.nt, c.n_noise, {_pick('mean', 'F')} AS auc, {_pick('s', 'F')} AS auc_std, {_pick(_CI, 'F')} AS auc_ci95, {_pick('mean', 'O')} AS f1, {_pick('mean', 'P')} AS ks, any_value(k.seeds)::INT AS trajectory_seed_count, "
    f"coalesce(max(CASE WHEN metric = 'F' THEN mean END) <= 0.55 AND max(CASE WHEN metric = 'O' THEN mean END) <= 0.15, false) AS degenerate_flag FROM {_CELL} c JOIN (SELECT nt, n_noise, count(DISTINCT seed) AS seeds FROM {_LONG} GROUP BY nt, n_noise) k ON c.nt = k.nt AND c.n_noise = k.n_noise GROUP BY c.nt, c.n_noise",
    "auc auc_std auc_ci95 f1 ks", "nt n_noise trajectory_seed_count degenerate_flag", 4,
)
def result_rows(t):
    o = t("orders")
    metric = F.create_map(*[F.lit(x) for kv in _METRIC_OF.items() for x in kv])[F.col("o_orderstatus")]
    long = o.groupBy((F.col("o_orderkey") % 3 + 1).cast("int").alias("nt"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("n_noise"), (F.col("o_orderkey") % 5).cast("int").alias("seed"), metric.alias("metric")).agg((F.avg("o_totalprice") / 500000).alias("value"))
    names = {"auc": "mortality_synth_roc_auc", "auc_std": "mortality_synth_roc_auc_std", "auc_ci95": "mortality_synth_roc_auc_ci95", "f1": "los_synth_macro_f1", "ks": "avg_ks_stat"}
    return results.build_result_rows(long).select("nt", "n_noise", "trajectory_seed_count", "degenerate_flag", *[F.col(c).alias(n) for n, c in names.items()])


@query("SELECT (o_orderkey % 8)::INT AS nt, (o_orderkey % 13)::INT AS n_noise, NULL::DOUBLE AS avg_ks_stat, NULL::BOOLEAN AS degenerate_flag, 'out of memory' AS error FROM orders")
def error_rows(t):
    cells = t("orders").select((F.col("o_orderkey") % 8).cast("int").alias("nt"), (F.col("o_orderkey") % 13).cast("int").alias("n_noise"))
    return results.error_rows(cells, "out of memory").select("nt", "n_noise", "avg_ks_stat", "degenerate_flag", "error")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END, o_totalprice * 2) AS score FROM orders WHERE o_orderstatus <> 'P'", "score", "o_orderkey", 4)
def loaded_results(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("score"), (F.col("o_totalprice") * 2).alias("old_score"))
    return results.load_results(o, ["status", "score"], {"score": "old_score"}).select("o_orderkey", "score")


@query("SELECT p_partkey, p_size, p_size % 5 <> 0 AS ok FROM part")
def split_diagnostics(t):
    rows = t("part").select("p_partkey", "p_size", F.when(F.col("p_size") % 5 == 0, "failed").alias("error"))
    good, bad = results.ranked_diagnostics(rows, ["p_size", "p_partkey"])
    return good.select("p_partkey", "p_size", F.lit(True).alias("ok")).unionByName(bad.select("p_partkey", "p_size", F.lit(False).alias("ok")))


@query("SELECT o_orderpriority, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, count(*) AS n FROM orders GROUP BY o_orderpriority", "mean std", "o_orderpriority n", 3)
def group_mean_std(t):
    return results.group_mean_std(t("orders"), ["o_orderpriority"], "o_totalprice")


# --- labels, sequences, scores -------------------------------------------------------------------


@query("SELECT user_id, max(CASE WHEN event_type IN ('purchase', 'error') AND value > 300 THEN 1 ELSE 0 END) AS label FROM events GROUP BY user_id")
def any_of_labels(t):
    on = lambda k: F.when((F.col("event_type") == k) & (F.col("value") > 300), 1.0)
    return utility.vasopressor_label(t("events").select("user_id", on("purchase").alias("a"), on("error").alias("b")), "user_id", ["a", "b"])


def _scaled(k: str) -> str:
    return f"({k} - (SELECT avg({k}) FROM {REAL})) / (SELECT stddev_pop({k}) FROM {REAL})"


_SEQS = f"(SELECT id, count(*) AS n, flatten(list([{_scaled('disc')}, {_scaled('qty')}] ORDER BY t)) AS v, (max(price) > 50000)::INT AS label FROM {REAL} GROUP BY id)"


@query(f"SELECT id, label, [round(x, 6) + 0.0::DOUBLE for x in list_concat(list_resize(v, longest * 2, 0.0::DOUBLE), [CASE WHEN i <= n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for i in range(1, longest + 1)], [n / longest::DOUBLE])] AS x FROM {_SEQS}, (SELECT max(n) AS longest FROM {_SEQS})")
def padded_sequences(t):
    """Each order's standardised lines in order, padded to the longest, with what is filled and its share."""
    real = real_synth(t)[0]
    plan = utility.FeaturePlan.fit(real.select("qty", "disc"))
    plan.numeric = sorted(plan.numeric)
    labels = real.groupBy("id").agg((F.max("price") > 50000).cast("int").alias("label"))
    seqs = utility.extract_sequences(real, plan, labels, "id", "t")
    longest = seqs.agg(F.max(F.size("steps"))).first()[0] or 1
    return utility.vectorise(seqs, longest, 2).select("id", "label", F.transform("x", lambda v: F.round(v, 6) + 0.0).alias("x"))


_CLASSED = "(SELECT CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 1 ELSE 2 END AS y, floor(ln(doc_id + 2) * 4) AS s FROM documents)"
_one_auc = lambda k, x: f"(SELECT sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) FROM (SELECT x, p, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {x} AS x, sum((y = {k})::INT) AS p, sum((y <> {k})::INT) AS n FROM {_CLASSED} GROUP BY 1)))"


@query(f"SELECT ({_one_auc(0, '-s')} + {_one_auc(1, '-(s - 28) * (s - 28)')} + {_one_auc(2, 's')}) / 3 AS roc_auc", "roc_auc")
def class_auc(t):
    s = F.floor(F.ln(F.col("doc_id") + 2) * 4)
    y = F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 3000, 1).otherwise(2)
    rows = t("documents").select(y.alias("y"), (-s).alias("p0"), (-(s - 28) * (s - 28)).alias("p1"), s.alias("p2"))
    return rank.class_roc_auc(rows, "y", ["p0", "p1", "p2"])


# --- bundles ------------------------------------------------------------------------------------


def _named(df: DataFrame) -> DataFrame:
    """Order lines under names that the reports know."""
    return df.select(F.col("id").alias("subject_id"), F.col("t").alias("hours_in"), F.col("qty").alias("HR"), F.col("price").alias("MAP"), F.col("disc").alias("SysABP"), F.col("tax").alias("DiasABP"))


def _inner(name: str, value: str) -> str:
    return f"(SELECT {value} FROM ({ORACLES[name]}))"


@query(
    f"SELECT {_inner('autocorr_distance', 'autocorr_distance')} AS autocorr_distance, {_inner('stay_length_ks', 'stay_length_ks')} AS stay_length_ks, {_inner('step_ratio', 'transition_mse_ratio')} AS transition_mse_ratio, {_inner('pair_corr_drift', 'temporal_corr_drift')} AS temporal_corr_drift",
    "autocorr_distance stay_length_ks transition_mse_ratio temporal_corr_drift", digits=7,
)
def trajectory_bundle(t):
    """The four at once, over vital signs found by their names."""
    real, synth = map(_named, real_synth(t))
    if trajectory.resolve_vitals(real, synth) != {"heart_rate": "HR", "systolic_bp": "SysABP", "diastolic_bp": "DiasABP", "mean_bp": "MAP"}:
        raise ValueError("vitals")
    return trajectory.trajectory_metrics(real, synth)


def _with_train(name: str) -> str:
    """A query's SQL with the training half in place of all real rows."""
    return f"({ORACLES[name].replace(_PS, '@synth').replace(_PR, '@real').replace('@synth', _PS).replace('@real', _TRAIN)})"


_PRIVACY_PARTS = [_with_train("closest_record"), _with_train("baseline_protection"), f"({ORACLES['overfitting_protection']})", f"({ORACLES['membership_attack'].replace(_KNOWN, _PS)})"]
_PRIVACY_PARTS.append(f"(SELECT (SELECT count(*) FROM {_TRAIN}) AS n_train, (SELECT count(*) FROM {_HOLD}) AS n_holdout, (SELECT count(*) FROM {_PS}) AS n_synth)")


@query(
    f"SELECT * FROM {', '.join(_PRIVACY_PARTS)}",
    "dcr_mean dcr_median dcr_p05 dcr_p95 exact_match_rate nndr_median synth_median random_median dcr_baseline_protection dcr_overfitting_protection dcr_closer_to_training median_train median_holdout "
    "mia_roc_auc mia_average_precision mia_attacker_advantage member_mean nonmember_mean", "n_train n_holdout n_synth", 5,
)
def privacy_report(t):
    """All privacy metrics at once, with half of the real parts as the training rows and half held out."""
    real, synth = _parts(t)
    half = S.hash_rank(9, F.col("id")) % 2
    return privacy.privacy_metrics(real.where(half == 0), synth, "id", real.where(half == 1))


_FIRSTS = ", ".join(f"arg_min({c}, t) AS {c}" for c in ("qty", "price", "disc", "flag"))
_FIRST_NUMBERS = ["qty", "price", "disc"]


def _first_quality(own: str) -> dict[str, str]:
    """SQL of each measure of the first lines ``own`` against those of ``real``."""
    key = '"column"'
    share = lambda side: f"sum(sum({side})) OVER w / sum(sum({side})) OVER (PARTITION BY {key})::DOUBLE"
    both = f"(SELECT {key}, v, {share('1 - s')} AS fr, {share('s')} AS fs, lead(v) OVER w AS nx FROM ({_long_pairs('real', own, _FIRST_NUMBERS)}) GROUP BY {key}, v WINDOW w AS (PARTITION BY {key} ORDER BY v))"
    area = f"(SELECT {key}, sum(abs(fr - fs) * (nx - v)) AS area FROM {both} GROUP BY {key})"
    spread = f"(SELECT unnest({_FIRST_NUMBERS}) AS {key}, unnest([{', '.join(f'stddev_pop({c})' for c in _FIRST_NUMBERS)}]) AS spread FROM real)"
    pairs = [(a, b) for i, a in enumerate(_FIRST_NUMBERS) for b in _FIRST_NUMBERS[i + 1 :]]
    gaps = " UNION ALL ".join(f"SELECT (SELECT corr({a}, {b}) FROM {own}) - (SELECT corr({a}, {b}) FROM real) AS d" for a, b in pairs)
    side = lambda table, name: f"(SELECT flag, count(*) / sum(count(*)) OVER ()::DOUBLE AS {name} FROM {table} GROUP BY flag)"
    shares = f"(SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM {side('real', 'p')} FULL JOIN {side(own, 'q')} USING (flag))"
    term = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"
    beyond = " + ".join(f"count(*) FILTER ({c} < {low} OR {c} > {high})" for c, (low, high) in _RANGES.items())
    return {
        "avg_ks_stat": f"SELECT avg(ks) FROM (SELECT max(abs(fr - fs)) AS ks FROM {both} GROUP BY {key})",
        "corr_frobenius": f"SELECT sqrt(2 * sum(d * d)) FROM ({gaps})",
        "range_violation_pct": f"SELECT 100.0 * ({beyond}) / ({' + '.join(f'count({c})' for c in _RANGES)}) FROM {own}",
        "wasserstein_mean": f"SELECT avg(area) FROM {area}",
        "wasserstein_scaled_mean": f"SELECT avg(area / spread) FROM {area} JOIN {spread} USING ({key})",
        "tv_mean": f"SELECT 0.5 * sum(abs(p - q)) FROM {shares}",
        "js_mean": f"SELECT sqrt(greatest(0, 0.5 * sum({term('p')}) + 0.5 * sum({term('q')}))) FROM {shares}",
    }


def _diagnostics_sql() -> str:
    groups = [(model, seed, f"(SELECT * FROM samples WHERE model = '{model}' AND seed = {seed})") for model in "ab" for seed in (0, 1)]
    values = " UNION ALL ".join(f"SELECT '{model}' AS model, {seed} AS seed, '{metric}' AS metric, ({sql})::DOUBLE AS value" for model, seed, own in groups for metric, sql in _first_quality(own).items())
    return f"""
WITH real AS (SELECT {_FIRSTS} FROM {REAL} GROUP BY id),
samples AS (SELECT CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS model, id % 2 AS seed, {_FIRSTS} FROM {SYNTH} GROUP BY id)
SELECT model, metric, count(value) AS n, avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS std, CASE WHEN count(value) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(value)) END AS ci95 FROM ({values}) GROUP BY model, metric
"""


@query(_diagnostics_sql(), "mean std ci95", "model metric n", 4)
def hour0_diagnostics(t):
    """First lines of orders against those of two models, two seeds each."""
    first = lambda d: d.groupBy("id").agg(*[F.min_by(c, "t").alias(c) for c in ("qty", "price", "disc", "flag")])
    real, synth = real_synth(t)
    samples = first(synth).withColumn("model", F.when(F.col("id") % 3 == 0, "a").otherwise("b")).withColumn("seed", (F.col("id") % 2).cast("int"))
    return cell.hour0_diagnostics(first(real).drop("id"), samples.drop("id"), "model", "seed", ["flag"], _RANGES)


@query(None)
def cell_metrics(t):
    """Every metric of one synthetic table, a row each."""
    real, synth = (_named(d).withColumn("row", F.xxhash64("subject_id", "hours_in")) for d in real_synth(t))
    label = lambda d: d.groupBy("subject_id").agg((F.max("MAP") > 50000).cast("int").alias("label"))
    days = lambda d: utility.los_label(d.withColumn("hour", F.floor(F.col("hours_in") / 10**12) * 12), "subject_id", "hour", None)
    out = cell.evaluate_cell(synth, real, [("mortality", label, (0, 1), ["MAP"]), ("los", days, (0, 1, 2), ["hours_in"])], "subject_id", "hours_in", "row")
    return out.unpivot([], [c for c in out.columns if c != "degenerate_flag"], "metric", "value")
