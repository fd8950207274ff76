"""Distributions, trajectories, privacy, utility, flows and result tables: properties on small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthscope.functions import dist, rank
from synthscope.operators import flow, knn, rollout
from synthscope.plans import privacy, quality, results, trajectory, utility


def table(spark, rng, n, shift=0.0, first=0):
    rows = [(first + i, float(50 + shift + 10 * x), float(80 + 5 * y), "MF"[int(y > 0)]) for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "id long, age double, hr double, sex string")


def test_distances_of_a_table_to_itself_are_zero(spark):
    df = table(spark, np.random.default_rng(0), 80)
    row = quality.quality_metrics(df, df, {("hr",): (0, 300)}).first()
    assert tuple(row) == (0.0, 0.0, 0.0)
    assert {r["wasserstein"] for r in dist.wasserstein(df, df, ["age", "hr"]).collect()} == {0.0}
    assert dist.total_variation(df, df, ["sex"]).first()["tv"] == 0.0 and dist.js_distance(df, df, ["sex"]).first()["js"] == 0.0
    far = dist.ks_statistics(df, table(spark, np.random.default_rng(1), 80, -20.0), ["age"]).first()["ks"]
    assert far > 0.5


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(5)
    values = [*np.unique(rng.normal(size=3000) ** 3).tolist(), float("inf"), float("-inf")]
    df = spark.createDataFrame([("k", v, 1) for v in values] + [("one", 4.0, 2)], "k string, v double, n int")
    got = {(r["k"], r["v"]): (r["cum_n"], r["next"]) for r in dist.running_sums(df, "k", "v", ["n"]).collect()}
    values.sort()
    assert all(got["k", v] == (i + 1, values[i + 1] if i + 1 < len(values) else None) for i, v in enumerate(values)) and got["one", 4.0] == (2, None)


def test_auc_and_precision_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (1, 0.4), (0, 0.1)]
    r = rank.rank_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    wins = sum((a > b) + 0.5 * (a == b) for y, a in rows if y for z, b in rows if not z) / 9
    assert r["roc_auc"] == pytest.approx(wins) and r["average_precision"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 3)
    assert rank.roc_auc(spark.createDataFrame(rows[:1], "y int, s double"), "y", "s").first()[0] is None
    multi = spark.createDataFrame([(0, 0.9, 0.1, 0.0), (1, 0.1, 0.8, 0.1), (2, 0.2, 0.2, 0.6)], "y int, a double, b double, c double")
    assert rank.macro_roc_auc(multi, "y", ["a", "b", "c"], [0, 1, 2]).first()[0] == 1.0
    assert rank.macro_roc_auc(multi.where("y < 2"), "y", ["a", "b", "c"], [0, 1, 2]).first()[0] is None


def walks(spark, rng, smooth, n=12):
    rows = []
    for s in range(n):
        hr = np.cumsum(rng.normal(size=30)) + 80 if smooth else rng.normal(80, 10, 30)
        rows += [(s, t, float(v), float(v * 0.8 + rng.normal())) for t, v in enumerate(hr)]
    return spark.createDataFrame(rows, "subject_id int, hours_in int, HR double, MAP double")


def test_trajectories(spark):
    real, same, noise = walks(spark, np.random.default_rng(1), True), walks(spark, np.random.default_rng(2), True), walks(spark, np.random.default_rng(3), False)
    near, far = (trajectory.trajectory_metrics(real, x).first() for x in (same, noise))
    assert near["autocorr_distance"] < far["autocorr_distance"] and far["transition_mse_ratio"] > 3 and near["stay_length_ks"] == 0.0 and near["temporal_corr_drift"] < 0.3
    flat = real.withColumn("HR", F.lit(1.0))
    assert trajectory.autocorr_distance(flat, flat, "subject_id", "hours_in", ["HR"]).first()[0] is None


def _mixed(spark, x, ids=None):
    return spark.createDataFrame([(int(i), *map(float, v), "ab"[i % 2]) for i, v in zip(range(len(x)) if ids is None else ids, x)], "id long, a double, b double, c double, k string").repartition(3)


def test_neighbours_in_cells(spark):
    rng = np.random.default_rng(7)
    q, r = rng.normal(size=(40, 3)), rng.normal(size=(90, 3))
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2) + 2.0 * (np.arange(40)[:, None] % 2 != np.arange(90)[None] % 2))
    for cell, chunk in ((1000, 1000), (13, 7), (1, 1000)):
        got = {x["id"]: (x["d"], x["near"]) for x in knn.nearest(_mixed(spark, q), _mixed(spark, r), ["a", "b", "c"], ["k"], 3, cell_rows=cell, chunk_rows=chunk).collect()}
        assert len(got) == 40 and all(got[i][0] == pytest.approx(np.sort(d[i])[:3].tolist()) and got[i][1] == np.argsort(d[i])[:3].tolist() for i in range(40))
    assert knn.nearest(_mixed(spark, q).limit(0), _mixed(spark, r), ["a"]).collect() == []
    with pytest.raises(ValueError):
        knn.nearest(_mixed(spark, q), _mixed(spark, r).limit(0), ["a"])


def test_neighbours_of_equal_rows(spark):
    """A third of the reference are copies of one row, and many queries too; ties go to the least ids, however few rows there are."""
    r = np.array([[0.0, 0.0, 0.0]] * 300 + [[i % 7, i % 5, i % 3] for i in range(600)], float)
    q = np.array([[0.0, 0.0, 0.0]] * 80 + [[i % 7, 1.0, 2.0] for i in range(40)])
    got = {x["id"]: (x["d"], x["near"]) for x in knn.nearest(_mixed(spark, q), _mixed(spark, r), ["a", "b", "c"], k=4, cell_rows=20, chunk_rows=16).collect()}
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2))
    assert all(got[i] == (pytest.approx(np.sort(d[i])[:4].tolist()), np.argsort(d[i], kind="stable")[:4].tolist()) for i in range(len(q)))
    assert [len(x["d"]) for x in knn.nearest(_mixed(spark, q[:3]), _mixed(spark, r[:2]), ["a"], k=5).collect()] == [2] * 3
    assert knn.nearest(_mixed(spark, q[:1]), _mixed(spark, r[:5]), [], [], k=2).first()["near"] == [0, 1]


def test_neighbours_meet_few_cells(spark):
    rng = np.random.default_rng(8)
    cols = lambda df: df.select("id", F.col("a").alias("n0"), F.col("b").alias("n1"), F.col("c").alias("n2"), F.xxhash64("k").alias("c0"))
    q, r = cols(_mixed(spark, rng.uniform(size=(300, 3)))), cols(_mixed(spark, rng.uniform(size=(6_000, 3))))
    search = knn.Search.over(r, 3, 1, 2, cell_rows=64)
    first = search.found(q, False).groupBy("id").agg(*knn._best(2))
    tau = q.join(first.select("id", F.get("d2", 1).alias("tau")), "id")
    pairs = sum(search.cells.rows[x["cell"]] for met in (search.visits(q, False), search.visits(tau, True)) for x in met.select("cell").collect())
    assert 300 * 2 <= pairs < 0.1 * 300 * 6_000


def test_privacy(spark):
    rng = np.random.default_rng(4)
    train, holdout = table(spark, rng, 120), table(spark, rng, 120, 5.0, 1000)
    clones = train.limit(60)
    assert privacy.distance_to_closest_record(train, clones, "id").first()["dcr_median"] == 0.0
    assert privacy.exact_match_rate(train, clones, "id").first()[0] == 1.0
    assert privacy.dcr_baseline_protection(train, clones, "id").first()["dcr_baseline_protection"] < 0.5
    assert privacy.dcr_overfitting_protection(train, holdout, clones, "id").first()["dcr_overfitting_protection"] < 0.5
    assert privacy.membership_inference(train, holdout, train, "id").first()["mia_roc_auc"] > 0.6
    assert privacy.membership_inference(train, holdout.limit(3), train, "id").first()["mia_roc_auc"] is None
    row = privacy.privacy_metrics(train, holdout, "id").first()
    assert row["n_train"] == 84 and row["n_holdout"] == 36 and row["n_synth"] == 120


def test_utility(spark):
    rng = np.random.default_rng(6)

    def rows(n, first, shuffle=False):
        x = rng.normal(size=(n, 2))
        y = (x[:, 0] > 0).astype(int)
        if shuffle:
            y = rng.permutation(y)
        return spark.createDataFrame([(first + i, float(a), float(b), "uv"[i % 2], int(k)) for i, ((a, b), k) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, s string, y int")

    task = utility.ColumnTask("y", F.col("y"), ["y"])
    real = rows(300, 0)
    good = {r["side"]: r for r in task.evaluate(rows(300, 1000), real, ["id"]).collect()}
    assert good["synth"]["roc_auc"] > 0.95 and good["real"]["roc_auc"] > 0.95
    bad = {r["side"]: r for r in utility.evaluate_multi_task(rows(300, 1000, True), real, [task], ["id"]).collect()}
    assert bad["synth"]["roc_auc"] < 0.85
    one = task.evaluate(real.where("y = 1"), real, ["id"]).where("side = 'synth'").first()
    assert one["roc_auc"] is None and one["accuracy"] is None
    assert utility.rank_topk_features(real.withColumn("t", F.lit(0)), F.col("y"), "id", "t", 1, ["y"]) == ["a"]
    table_ = utility.feature_ablation(rows(200, 5000), real, task, ["a", "b"], [1], ["id"]).collect()
    assert {r["features"] for r in table_} == {"all", "top1"}


def test_labels(spark):
    df = spark.createDataFrame([(1, 0, None, 1.0), (1, 30, 1.4, None), (2, 200, 0.0, None), (3, 5, None, 8.0)], "id int, h int, hospital_expire_flag double, los_icu double")
    assert {tuple(r) for r in utility.mortality_label(df, "id", "h").collect()} == {(1, 1), (2, 0)}
    assert {tuple(r) for r in utility.los_label(df, "id", "h").collect()} == {(1, 0), (2, 2), (3, 2)}
    assert {tuple(r) for r in utility.vasopressor_label(df, "id", ["hospital_expire_flag"]).collect()} == {(1, 1), (2, 0), (3, 0)}


@pytest.fixture(scope="module")
def small_flow_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x), float(c)], [float(c), 1.0]) for i, (x, c) in enumerate(zip(rng.normal(5, 1, 60), rng.integers(0, 2, 60), strict=True))]
    return spark.createDataFrame(rows, "id long, x_target array<double>, x_cond array<double>")


def test_pairs(spark, small_flow_rows):
    pairs = flow.expand_pairs(small_flow_rows, 3, 2, 2)
    assert pairs.count() == 60 * 6 and pairs.exceptAll(flow.expand_pairs(small_flow_rows.repartition(5), 3, 2, 2)).count() == 0


@pytest.mark.parametrize("kind", ["joint", "sequential"])
def test_generators(spark, small_flow_rows, kind):
    extra = {"categorical": (1,)} if kind == "sequential" else {}
    model = flow.GENERATORS[kind](nt=2, n_noise=2, settings={"maxIter": 2, "maxDepth": 2, "seed": 0}, **extra).fit(small_flow_rows)
    drawn = rollout.sample(model, small_flow_rows, 3).collect()
    assert len(drawn) == 60 and 3 < np.mean([r["x"][0] for r in drawn]) < 7
    if kind == "sequential":
        assert {r["x"][1] for r in drawn} <= {0.0, 1.0}
    subjects = spark.range(7).select("id", F.array().cast("array<double>").alias("x_static"))
    walk = rollout.rollout(model, subjects, 5, 1)
    assert walk.count() == 35 and {len(r["x_cond"]) for r in walk.collect()} == {2}
    a, b = (sorted(map(str, rollout.rollout(model, subjects.repartition(n), 5, 1).collect())) for n in (1, 4))
    assert a == b
    assert rollout.rollout(model, subjects, 5, 1, stop=0, threshold=-100.0).count() == 7


def test_sequential_flow_in_closed_form(spark):
    """One level of one-split trees: the velocity is the mean of x - z on either side, and a class that is alone is a constant."""
    rows = spark.createDataFrame([(i, [-1.0 if i % 2 else 1.0, 7.0], []) for i in range(400)], "id long, x_target array<double>, x_cond array<double>")
    model = flow.SequentialFlow(categorical=(1,), nt=1, n_noise=2, settings={"maxIter": 1, "maxDepth": 1, "stepSize": 1.0, "seed": 0}).fit(rows)
    pairs = flow.expand_pairs(rows, 2, 1, 2).groupBy((F.get("x_t", 0) > 0).alias("up")).agg(F.avg(F.get("y", 0)).alias("v"))
    v = {r["up"]: r["v"] for r in pairs.collect()}
    noise = rollout._with_noise(rows.select("id", F.col("x_cond").alias("cond")), 2, 5, 0)
    got = rollout.sample(model, rows, 5).join(noise, "id").select("x", "z").collect()
    assert len(got) == 400 and {r["x"][1] for r in got} == {7.0}
    far = [r for r in got if abs(r["z"][0]) > 0.1]  # elsewhere it depends on where the tree cuts between -1 and 1
    assert len(far) > 300 and all(r["x"][0] == pytest.approx(r["z"][0] + v[r["z"][0] > 0]) for r in far)


def test_trajectories_of_varying_length(spark, small_flow_rows):
    rows = small_flow_rows.select("id", "x_target", F.slice("x_target", 1, 2).alias("x_cond"))
    model = flow.JointFlow(nt=1, n_noise=1, settings={"maxIter": 2, "maxDepth": 2, "seed": 0}).fit(rows)
    subjects = spark.createDataFrame([(i, [], [float(i), 0.0] if i < 4 else None) for i in range(9)], "id long, x_static array<double>, first array<double>")
    for start in ("random", "zero", "given"):
        by = {}
        for r in rollout.sample_trajectories(model, subjects, 6, start, 1, 1, 0.5).orderBy("id", "step").collect():
            by.setdefault(r["id"], []).append(r)
        assert set(by) == set(range(9)) and len({len(x) for x in by.values()}) > 1
        for i, steps in by.items():
            assert [r["step"] for r in steps] == list(range(len(steps))) and [r["last"] for r in steps] == [False] * (len(steps) - 1) + [True]
            assert all(r["x"][1] <= 0.5 for r in steps[:-1]) and (steps[-1]["x"][1] > 0.5 or len(steps) == 6)
            assert start == "random" or steps[0]["x"] == ([0.0, 0.0] if start == "zero" else [float(i), 0.0]) or (start == "given" and i >= 4)
    with pytest.raises(ValueError):
        rollout.sample_trajectories(model, subjects, start="other")


def test_optimality_of_fits(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=400) > 0.5).astype(int)
    rows = spark.createDataFrame([(list(map(float, a)), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, label int")
    for l1, c in ((False, 1.0), (True, 0.05)):
        fine = utility.optimality(utility.fit_classifier(rows, c, l1, tol=1e-10), rows, c, l1, 1e-5).collect()
        assert len(fine) == 5 and all(r["optimal"] for r in fine) and (not l1 or any(r["weight"] == 0 for r in fine))
        poor = utility.optimality(utility.fit_classifier(rows, c, l1, max_iter=1), rows, c, l1, 1e-5).collect()
        assert not all(r["optimal"] for r in poor)


def test_label_conditional(small_flow_rows):
    fitted = flow.fit_label_conditional(small_flow_rows.withColumn("label", F.get("x_cond", 0)), "label", lambda: flow.JointFlow(nt=1, n_noise=1, settings={"maxIter": 1, "maxDepth": 1}))
    assert set(fitted) == {0.0, 1.0} and sum(share for _, share in fitted.values()) == pytest.approx(1.0)


def test_kinds_and_label_draws(spark):
    assert flow.flow_feature_types(["c", "q", "c"], 2) == ["q", "q", "c"]
    with pytest.raises(ValueError):
        flow.flow_feature_types(["q"], 2)
    drawn = flow.draw_labels(spark.range(4000), spark.createDataFrame([("a", 1), ("b", 3)], "label string, count long"), "label", "id")
    assert 900 < drawn.where("label = 'a'").count() < 1100
    assert flow.draw_labels(spark.range(3), spark.createDataFrame([], "label string, count long"), "label", "id").where("label is null").count() == 3


def test_flat_table(spark):
    from synthscope.operators.encode import TabularEncoder

    enc = TabularEncoder.fit(spark.createDataFrame([(1.0, 1, "a"), (2.0, 0, "b")], "hr double, vent int, sex string"), ["hr"], ["vent"], ["sex"])
    rows = spark.createDataFrame([(7, 0, [70.5, 0.9], [1.0])], "id long, step int, x array<double>, x_cond array<double>")
    assert rollout.create_flat_dataframe(spark, rows, enc, ["hr", "vent"], ["sex"]).first() == (7, 0, 70.5, 1, "b")
    assert rollout.marginal_rows(spark.range(100), 30, ["id"]).toDF("n", "id").where("id < 0 or id > 99").count() == 0


def test_seed_statistics(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", float("nan")), ("b", 3.0), ("c", float("inf"))]
    got = {r["k"]: tuple(r)[1:] for r in results.seed_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    s = np.std([1, 2, 4], ddof=1)
    assert got["a"] == pytest.approx((3, 7 / 3, s, 4.302653 * s / 3**0.5)) and got["b"] == (1, 3.0, 0.0, None) and got["c"] == (0, None, None, None)


def test_result_rows(spark):
    rows = [(1, 2, s, m, v) for s in (0, 1) for m, v in (("synth_roc_auc", 0.51234 + s / 100), ("los_synth_macro_f1", 0.1), ("dcr_median", 1.23456789))]
    out = results.build_result_rows(spark.createDataFrame(rows, "nt int, n_noise int, seed int, metric string, value double")).first()
    assert out["mortality_synth_roc_auc"] == 0.5173 and out["dcr_median"] == 1.234568 and out["degenerate_flag"] and out["trajectory_seed_count"] == 2 and out["corr_frobenius"] is None
    cells = results.grid(spark, [1, 2], [3])
    err = results.error_rows(cells, "boom")
    assert err.columns == results.RESULT_SCHEMA.names and {r["error"] for r in err.collect()} == {"boom"}
    assert results.remaining(cells, err).count() == 2 and results.remaining(cells, err.withColumn("error", F.lit(""))).count() == 0
    old = spark.createDataFrame([(1.0, None), (None, 2.0), (None, None)], "new double, old double")
    assert sorted(r["new"] for r in results.load_results(old, ["new"], {"new": "old"}).collect()) == [1.0, 2.0]
    ok, bad = results.ranked_diagnostics(spark.createDataFrame([(2.0, ""), (1.0, None), (0.0, "x")], "ks double, error string"), ["ks"])
    assert [r["ks"] for r in ok.collect()] == [1.0, 2.0] and bad.count() == 1


def test_bundle_and_first_state_diagnostics(spark):
    from synthscope.plans import cell, quality

    rows = [(i, i % 5, float(i % 7), float(i % 11), "abc"[i % 3]) for i in range(60)]
    real = spark.createDataFrame(rows, "subject_id int, hours_in int, x double, y double, kind string")
    samples = real.select("x", (F.col("y") * 1.5).alias("y"), "kind", F.lit("m").alias("model"), (F.col("subject_id") % 2).alias("seed"))
    plain = real.select("x", "y", "kind")
    got = {r["metric"]: r for r in cell.hour0_diagnostics(plain, samples, "model", "seed", ["kind"], {}).collect()}
    each = [quality.quality_metrics(plain, samples.where(f"seed = {s}").drop("model", "seed"), {}).first() for s in (0, 1)]
    assert got["avg_ks_stat"]["n"] == 2 and got["avg_ks_stat"]["mean"] == pytest.approx(sum(r["avg_ks_stat"] for r in each) / 2)
    assert {"wasserstein_mean", "wasserstein_scaled_mean", "tv_mean", "js_mean", "corr_frobenius"} <= set(got)

    def broken(_):
        raise ValueError("no label")

    frame = real.withColumn("row", F.col("subject_id"))
    (row,) = cell.evaluate_cell(frame, frame, [("mortality", broken, (0, 1), [])], "subject_id", "hours_in", "row", vitals={}, ranges={}, cap=20).collect()
    assert row["mortality_synth_roc_auc"] is None and row["avg_ks_stat"] == 0.0 and 0 < row["dcr_exact_match_rate"] <= 1 and row["degenerate_flag"] is False


def test_class_auc_falls_back(spark):
    rows = spark.createDataFrame([(0, 0.9, 0.1, 0.0), (2, 0.2, 0.1, 0.7), (2, 0.1, 0.1, 0.8), (0, 0.6, 0.2, 0.2)], "y int, p0 double, p1 double, p2 double")
    one = lambda df, names: rank.class_roc_auc(df, "y", names).first()["roc_auc"]
    assert one(rows, ["p0", "p1", "p2"]) == 1.0 and one(rows, ["p2", "p0"]) == 0.0 and one(rows.where("y = 0"), ["p0", "p1"]) is None and one(rows, []) is None
    three = rows.unionByName(rows.where("y = 2").withColumn("y", F.lit(3)))
    assert one(three, ["p0", "p1", "p2"]) is not None and one(three, ["p0", "p1"]) is None


def test_cells_count_rows_by_bins(spark):
    """Fits see a bounded number of cells with the rows' numbers and mean labels; a column of few values keeps them as they are."""
    rows = spark.range(20_000).select((F.col("id") % 10).cast("double").alias("few"), F.rand(1).alias("many"), (F.col("id") % 7).cast("double").alias("y"))
    got = flow.cells(rows, [F.col("few"), F.col("many")], [F.col("y"), -F.col("y")], [[0, 1], [0]])
    wide, narrow = ([r for r in got.collect() if r["design"] == k] for k in (0, 1))
    assert len(wide) <= 10 * flow.BINS and sorted(r["x"][0] for r in narrow) == list(map(float, range(10)))
    for part in (wide, narrow):
        assert sum(r["w"] for r in part) == 20_000
        assert abs(sum(r["w"] * r["y"][0] for r in part) - sum(i % 7 for i in range(20_000))) < 1e-6
    means = {r["x"][0]: r["w"] for r in narrow}
    assert set(means.values()) == {2000.0}
    at = sorted({r["x"][1] for r in wide})
    assert len(at) == flow.BINS and all(abs(x - (i + 0.5) / flow.BINS) < 0.02 for i, x in enumerate(at))


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """3 000 queries of 30 kinds: each gets its row, but only 30 are looked for."""
    ref = spark.range(50).select("id", (F.col("id") * 1.5).alias("v"), F.lit("a").alias("c"))
    query = spark.range(3000).select("id", (F.col("id") % 30).cast("double").alias("v"), F.lit("a").alias("c"))
    asked, found = [], knn.Search.found
    monkeypatch.setattr(knn.Search, "found", lambda self, q, again: asked.append(q.count()) or found(self, q, again))
    got = {r["id"]: r["d"][0] for r in knn.nearest(query, ref, ["v"], ["c"]).collect()}
    assert asked == [30, 30] and len(got) == 3000
    assert all(abs(d - min(abs(i % 30 - 1.5 * j) for j in range(50))) < 1e-12 for i, d in got.items())


def test_visits_go_out_in_bounded_batches(monkeypatch):
    """A row of many columns that meets many cells does not make one large batch."""
    monkeypatch.setattr(knn, "BLOCK_PAIRS", 400)
    x = np.arange(64.0)
    cells = knn.Cells.cut(np.tile(x, (8, 1)), np.zeros((0, 64), np.int64), 16).boxed([])
    cells.low, cells.high, cells.rows = np.zeros((8, cells.count)), np.full((8, cells.count), 63.0), np.full(cells.count, 4)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(64)), *[pa.array(x)] * 8, pa.array(np.full(64, 1e9))], ["id", *[f"n{j}" for j in range(8)], "tau"])
    out = list(knn._visits([batch], cells, 1, None, True))
    assert sum(b.num_rows for b in out) == 64 * (cells.count - 1) and max(b.num_rows for b in out) <= 40


def test_equal_rows_are_fitted_once(spark):
    """A fit sees distinct rows with the weights of all; the classes still weigh the same."""
    rows = spark.range(1200).select(F.array((F.col("id") % 4).cast("double")).alias("x"), (F.col("id") % 12 == 0).cast("int").alias("label"))
    data, n = utility.balanced(rows)
    got = data.collect()
    assert n == 1200 and len(got) == 5
    assert all(abs(sum(r["w"] for r in got if r["label"] == k) - 600) < 1e-9 for k in (0, 1))
    assert data.groupBy("x", "label").count().where("count > 1").isEmpty()


def test_privacy_metrics_search_once(spark, monkeypatch):
    """Synthetic rows are looked for among the training rows once for all metrics, which are the same as each by itself."""
    rng = np.random.default_rng(12)
    train, holdout, synth = (table(spark, rng, 90, shift, first) for shift, first in ((0.0, 0), (3.0, 1000), (1.0, 2000)))
    alone = [f(train, synth, "id").first().asDict() for f in (privacy.distance_to_closest_record, privacy.dcr_baseline_protection)]
    alone += [f(train, holdout, synth, "id").first().asDict() for f in (privacy.dcr_overfitting_protection, privacy.membership_inference)]
    asked, search = [], privacy.nearest
    monkeypatch.setattr(privacy, "nearest", lambda *a, **k: asked.append(1) or search(*a, **k))
    row = privacy.privacy_metrics(train, synth, "id", holdout).first().asDict()
    assert len(asked) == 5
    assert all(row[k] == pytest.approx(v) for part in alone for k, v in part.items())


def test_trajectory_metrics_read_each_table_once(spark, monkeypatch):
    """One sort of each table gives what the metrics give by themselves, gaps and infinite values included."""
    rng = np.random.default_rng(3)
    cell = lambda i, x: None if i % 7 == 0 else float("inf") if i == 31 else float(x)
    tables = [spark.createDataFrame([(i // 9, i, cell(i, x), cell(i + 3, x * k + y)) for i, (x, y) in enumerate(rng.normal(size=(180 + 9 * k, 2)))], "subject_id long, hours_in long, HR double, MAP double") for k in (1, 2)]
    one = (*tables, "subject_id", "hours_in", ["HR", "MAP"])
    alone = [trajectory.autocorr_distance(*one), trajectory.stay_length_ks(*tables, "subject_id"), trajectory.transition_mse_ratio(*one), trajectory.temporal_corr_drift(*tables, "subject_id", [("HR", "MAP")])]
    want, sorts, before = [d.first()[0] for d in alone], [], trajectory._with_before
    monkeypatch.setattr(trajectory, "_with_before", lambda *a: sorts.append(1) or before(*a))
    assert list(trajectory.trajectory_metrics(*tables).first()) == pytest.approx(want, nan_ok=True) and len(sorts) == 2


def test_visits_open_few_boxes(monkeypatch):
    """Queries go down the tree of cells: the same visits as from all distances of all boxes, of which few are computed."""
    rng = np.random.default_rng(5)
    ref, num = rng.uniform(size=(3, 8_000)), rng.uniform(-0.2, 1.2, size=(3, 600))
    kind, cat = rng.integers(0, 3, size=(1, 8_000)), rng.integers(0, 4, size=(1, 600))
    cells = knn.Cells.cut(ref, kind, 250)
    at = cells.cell_of(ref, kind, 8_000)
    ends = [{"cell": c, "rows": int((at == c).sum()), **{f"{e}_{n}{j}": f(x[j][at == c]) for n, x in (("n", ref), ("c", kind)) for j in range(len(x)) for e, f in (("low", min), ("high", max))}} for c in range(cells.count)]
    cells.boxed(ends)
    bound, tau = cells.bounds(num, cat, 600), np.full(600, 0.01)
    first = knn._first_cells(bound, cells.rows, 1)
    tau = np.maximum(tau, bound.min(axis=1))
    seen, whole = [], knn.Tree.bounds
    monkeypatch.setattr(knn.Tree, "bounds", lambda self, num, cat, q, at: seen.append(len(q)) or whole(self, num, cat, q, at))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), *map(pa.array, num), pa.array(cat[0]), pa.array(tau)], ["id", "n0", "n1", "n2", "c0", "tau"])
    for again, want in ((False, first), (True, ~first & (bound <= tau[:, None]))):
        got = {(i, c) for b in knn._visits([batch], cells, 1, None, again) for i, c in zip(b.column("id").to_pylist(), b.column("cell").to_pylist(), strict=True)}
        assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
    assert sum(seen) < 0.4 * 2 * 600 * cells.count
    monkeypatch.setattr(knn, "BLOCK_PAIRS", 500)
    assert sum(b.num_rows for b in knn._visits([batch], cells, 1, None, True)) == want.sum()


def test_other_cells_send_only_nearer_rows():
    """A query that meets another cell in vain makes no row to be merged."""
    query = pa.table({"id": [1, 2], "n0": [0.0, 5.0], "tau": [0.5, 0.5], "cell": pa.array([0, 0], pa.int32()), "part": pa.array([0, 0], pa.int32())})
    got = knn._nearest(query, pa.table({"id": [7, 8], "n0": [4.5, 9.0]}), 2, 1, 0)
    assert got.select(["id", "d2", "near"]).to_pylist() == [{"id": 2, "d2": [0.25, 16.0], "near": [7, 8]}]


def test_queries_of_one_id_are_one(spark):
    query = spark.createDataFrame([(1, 0.0), (1, 9.0), (2, 9.0)], "id long, v double")
    ref = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, v double")
    got = {r["id"]: (r["d"], r["near"]) for r in knn.nearest(query, ref, ["v"], k=2, cell_rows=2).collect()}
    assert got == {1: ([0.0, 0.0], [0, 9]), 2: ([0.0, 1.0], [9, 8])}


def test_candidates_are_not_one_task(spark):
    """The members of an attack are the least hashes of either side, without a limit that takes them all to one task."""
    from synthscope.operators import split

    train, holdout = (spark.range(n, m).withColumn("x", F.col("id") * 2) for n, m in ((0, 100), (200, 240)))
    got = split.member_candidates(train, holdout, ["id"], 3)
    want = {(r["id"], m) for d, m in ((train, 1), (holdout, 0)) for r in split.smallest_hashes(d, 40, ["id"], 3).collect()}
    assert {(r["id"], r["member"]) for r in got.collect()} == want and got.columns == ["id", "x", "member"]
    assert "Limit" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_some_queries_tell_the_parts(spark, monkeypatch):
    """Parts of cells are told from some queries, but all are answered; a reference for two neighbours serves one."""
    monkeypatch.setattr(knn, "COUNTED", 100)
    met, counted = knn._met_counts, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(knn, "_met_counts", lambda batches, **k: (counted.add(sum(b.column("n").to_pylist())) or b for b in met(batches, **k)))
    ref = spark.range(40).select("id", (F.col("id") * 2.0).alias("v"))
    search = knn.reference(ref, ["v"], k=2, cell_rows=10, chunk_rows=50)
    got = {r["id"]: (r["d"], r["near"]) for r in knn.nearest(spark.range(1000).select("id", (F.col("id") % 500 + 0.5).alias("v")), search, ["v"], k=1).collect()}
    assert 0 < counted.value < 500
    want = lambda v: min((abs(v - 2.0 * i), i) for i in range(40))
    assert got == {i: ([d], [n]) for i in range(1000) for d, n in [want(i % 500 + 0.5)]}
    with pytest.raises(ValueError):
        knn.nearest(ref, search, ["v"], k=3)
