"""Lags, filling, encoders, splits, profiles, sources on hand-made rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthscope.operators import encode, grid, impute, lag, profile, split
from synthscope.sources import io


@pytest.fixture(scope="module")
def stays(spark):
    rows = [(1, 1, 81.0, "a", 40), (1, 0, 80.0, "b", 40), (2, 0, 60.0, "c", 50), (1, 3, None, "d", 40), (2, 1, 61.0, None, 50), (1, 2, 82.0, "e", 40)]
    return spark.createDataFrame(rows, "subject_id int, hours_in int, hr double, mode string, age int")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_lags(stays):
    out, targets, cond = lag.prepare_autoregressive_data(stays, "subject_id", "hours_in", ["age"])
    assert targets == ["hr", "mode"] and cond == ["age", "hr_lag1", "mode_lag1"]
    got = by(out, "subject_id", "hours_in")
    assert [got[1, h]["hr_lag1"] for h in range(4)] == [-1.0, 80.0, 81.0, 82.0] and got[2, 0]["hr_lag1"] == -1.0 and got[2, 0]["mode_lag1"] == "-1.0"
    two = by(lag.prepare_autoregressive_data(stays, "subject_id", "hours_in", ["age", "mode"], lag=2, fill_strategy="zero")[0], "subject_id", "hours_in")
    assert [two[1, h]["hr_lag2"] for h in range(4)] == [0.0, 0.0, 80.0, 81.0]
    mean = by(lag.prepare_autoregressive_data(stays, "subject_id", "hours_in", ["age", "mode"], fill_strategy="mean")[0], "subject_id", "hours_in")
    assert mean[2, 0]["hr_lag1"] == pytest.approx((80 + 81 + 82 + 60) / 4)
    for bad in (dict(id_col="x", time_col="hours_in"), dict(id_col="subject_id", time_col="hours_in", fill_strategy="other"), dict(id_col="subject_id", time_col="hours_in", fill_strategy="mean")):
        with pytest.raises(ValueError):
            lag.prepare_autoregressive_data(stays, **bad)


def test_one_shuffle_for_all_lags(stays):
    wide = stays.select("subject_id", "hours_in", *[F.col("hr").alias(f"v{i}") for i in range(6)])
    plan = lag.prepare_autoregressive_data(wide, "subject_id", "hours_in")[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_fills(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, None), (2, 0, None), (2, 1, 9.0)], "id int, t int, x double")
    value = lambda d: [d[k]["x"] for k in sorted(d)]
    assert value(by(impute.forward_fill(df, "id", "t", ["x"]), "id", "t")) == [None, 5.0, 5.0, None, 9.0]
    assert value(by(impute.backward_fill(df, "id", "t", ["x"]), "id", "t")) == [5.0, 5.0, None, 9.0, 9.0]  # never from the next entity
    assert value(by(impute.fill_both_ways(df, "id", "t", ["x"]), "id", "t")) == [5.0, 5.0, 5.0, 9.0, 9.0]
    mixed = spark.createDataFrame([(1.0, "b"), (float("nan"), "a"), (3.0, None), (None, "a"), (2.0, "b")], "x double, s string")
    assert impute.column_medians(mixed, ["x"]) == {"x": 2.0} and impute.column_modes(mixed, ["s"]) == {"s": "a"}
    assert sorted(map(tuple, impute.fill_median_mode(mixed, ["x"], ["s"]).collect())) == [(1.0, "b"), (2.0, "a"), (2.0, "a"), (2.0, "b"), (3.0, "a")]


def test_grid(spark):
    eav = spark.createDataFrame([(1, 0, "a", 1.0), (1, 0, "a", 3.0), (1, 5, "b", 2.0), (2, 1, "z", 4.0), (3, 99, "a", 1.0)], "id int, step int, parameter string, value double")
    wide = grid.median_wide(grid.grid_rows(eav, 6, ["z"]), "id", "step", ["a", "b"])
    assert by(wide, "id", "step")[1, 0]["a"] == 2.0
    assert grid.dense_grid(eav, wide, "id", "step", 6).count() == 18
    rows = spark.createDataFrame([(1, 2, None, "x"), (1, 3, 7.0, None)], "id int, t int, v double, s string")
    assert grid.first_rows(rows, "id", "t").first() == (1, 2, 7.0, "x") and grid.hour0_rows(rows, "id", "t").first() == (1, 2, 7.0, "x")


def test_encoder(spark):
    train = spark.createDataFrame([(1.0, "b", 1, 3), (None, "a", 0, 4), (2.0, None, 1, 5)], "x double, s string, f int, k int")
    enc = encode.TabularEncoder.fit(train, ["x", "k"], ["f"], ["s"], ["k"])
    assert {r["value"]: r["code"] for r in enc.codes.collect()} == {"__NAN__": 0, "a": 1, "b": 2} and enc.feature_types == ["q", "q", "q", "c"]
    coded = enc.transform(train)
    assert sorted(map(tuple, coded.collect())) == [(0.0, 4.0, 0.0, 1.0), (1.0, 3.0, 1.0, 2.0), (2.0, 5.0, 1.0, 0.0)]
    assert sorted(map(tuple, enc.inverse_transform(coded).collect()), key=str) == [(0.0, 4, 0, "a"), (1.0, 3, 1, "b"), (2.0, 5, 1, None)]
    other = spark.createDataFrame([(1.0, "zzz", 1, 1)], "x double, s string, f int, k int")
    assert enc.transform(other).first()["s"] == 0.0
    parts = encode.merge_states(*[encode.label_state(train.where(F.col("k") == k), ["s"]) for k in (3, 4, 5)])
    assert sorted(map(tuple, encode.codes_of(parts).collect())) == sorted(map(tuple, enc.codes.collect()))
    assert enc.split_indices(["x", "s"], ["k", "f"]) == ([0, 3], [1, 2])
    for target, cond in ((["x"], ["k", "f"]), (["x", "s"], ["x", "k", "f"]), (["x", "s", "q"], ["k", "f"])):
        with pytest.raises(ValueError):
            enc.split_indices(target, cond)
    with pytest.raises(ValueError):
        encode.TabularEncoder.fit(train.limit(0), ["x"])


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4).alias("y"))
    parts = split.subject_split(df, "id")
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"test": 100, "holdout": 100, "train": 800}
    again = split.subject_split(df.repartition(7), "id")
    assert parts.exceptAll(again).count() == 0
    assert {r["part"] for r in split.subject_split(df.limit(3), "id").collect()} == {"test", "holdout", "train"}
    strat = split.train_test_split(df, 0.3, ["id"], "y").where("is_test").groupBy("y").count().collect()
    assert {r["count"] for r in strat} == {75}
    both = split.member_candidates(df.where("id < 600"), df.where("id >= 900"), ["id"])
    assert {r["member"]: r["count"] for r in both.groupBy("member").count().collect()} == {0: 100, 1: 100}
    assert split.sample_rows(df, 50, ["id"]).select("id").distinct().count() == 50 and split.sample_rows(df, 3000, ["id"]).count() == 3000
    assert split.cap_subjects(df, "y", 2).select("y").distinct().count() == 2 and split.capped(df, None, ["id"]).count() == 1000
    rand = split.random_rows(df, 200, ["id"], ["y"]).toDF("n", "id", "y")
    assert rand.where("id < 0 or id > 999 or y is null").count() == 0


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a", None), (-1.0, " ", None), (None, None, None)], "x double, s string, gone int")
    got = by(profile.coverage_profile(df, ["x"], ["s", "x"]), "column")
    assert got[("x",)]["pct_sentinel"] == 50.0 and got[("x",)]["role"] == "both" and got[("s",)]["n_text"] == 1 and got[("gone",)]["n_known"] == 0
    assert profile.all_missing_columns(df) == ["gone"] and profile.drop_all_missing(df).columns == ["x", "s"]


def test_sources(spark, tmp_path):
    for k, lines in {"1": ["00:00,RecordID,11", "00:07,HR,80", "01:10,HR,bad"], "2": ["00:00,RecordID,12", "00:30,Temp,37.5"]}.items():
        (tmp_path / f"{k}.txt").write_text("\n".join(["Time,Parameter,Value", *lines]))
    rows = io.read_eav_files(spark, f"{tmp_path}/*.txt").collect()
    assert {(r["entity_id"], r["parameter"], r["value"]) for r in rows} == {(11, "HR", 80.0), (11, "HR", None), (12, "Temp", 37.5)}
    df = spark.createDataFrame([(1, "x", 2.5)], "a int, b string, c double")
    for fmt in ("csv", "parquet", "json"):
        io.write_table(df, f"{tmp_path}/{fmt}", fmt)
    assert io.load_csv(spark, f"{tmp_path}/csv").first() == (1, "x", 2.5) and io.load_parquet(spark, f"{tmp_path}/parquet", ["c"]).columns == ["c"]
    assert io.load_flat_table(spark, f"{tmp_path}/csv", exclude_cols=["b", "none"]).columns == ["a", "c"] and io.count_rows(df) == 1
    schema = T.StructType([T.StructField("c", T.DoubleType()), T.StructField("new", T.StringType())])
    io.append_results(df, f"{tmp_path}/res", schema)
    io.append_results(df, f"{tmp_path}/res", schema)
    assert spark.read.parquet(f"{tmp_path}/res").collect() == [(2.5, None)] * 2
    built = []
    make = lambda: built.append(1) or df
    for sign in ("p", "p", "q"):
        io.cached_by_signature(spark, f"{tmp_path}/cache", {"path": sign}, make)
    assert len(built) == 2
    for reset in (False, False, True):
        io.reuse_or_build(spark, f"{tmp_path}/step", make, reset)
    assert len(built) == 4
    io.write_json_report(df, f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").first()[0] == '{"a":1,"b":"x","c":2.5}'
    assert spark.range(1).select(*io.parse_path_numbers(F.lit("/m/model_nt3_noise_8.pkl"), "nt", "noise")).first() == (3, 8)
    assert dict(io.cast_like(df, spark.createDataFrame([], "a string, c int")).dtypes) == {"a": "string", "b": "string", "c": "int"}


def test_refreshed_table_is_not_sorted_in_memory(spark, tmp_path):
    """Rows of a file are written as they come: no task holds them, with their partition's name, for a sort."""
    spark.range(0, 300_000, 1, 2).select(F.rand(1).alias("v")).write.parquet(f"{tmp_path}/source/a")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    tracked = spark.sparkContext._jsc.sc().statusStore()
    got = io.refreshed(spark, f"{tmp_path}/source", f"{tmp_path}/target", lambda files: spark.read.parquet(*files).select("v", F.col("_metadata.file_path").alias("file")))
    assert got.count() == 300_000 and got.select("file").distinct().count() == 2
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    stages = {s for j in jobs for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    written = [d for d in (tracked.lastStageAttempt(s) for s in sorted(stages)[-12:]) if d.outputRecords() == 300_000]
    assert written and max(d.peakExecutionMemory() for d in written) < 1 << 20
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_eav_files_of_a_folder(spark, tmp_path):
    """A folder of folders, listed by Spark's tasks: the same rows as by a pattern."""
    for k in range(40):
        (tmp_path / f"u={k}").mkdir()
        (tmp_path / f"u={k}" / "x.csv").write_text(f"Time,Parameter,Value\n00:00,RecordID,{k}\n00:07,HR,{k + 60}\n")
    got = io.read_eav_files(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(k, "00:07", "HR", k + 60.0) for k in range(40)] == sorted(map(tuple, io.read_eav_files(spark, f"{tmp_path}/*/*.csv").collect()))
