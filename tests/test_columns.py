import pytest

from synthscope.functions import columns as c


@pytest.mark.parametrize(("name", "want"), [(("Heart Rate", "mean"), "Heart_Rate_mean"), ("('Albumin ascites', 'std')", "Albumin_ascites_std"), ("plain", "plain"), ("(broken", "(broken"), ("('a', 'b', 'c')", "('a', 'b', 'c')"), (3, "3")])
def test_normalised_names(name, want):
    assert c.normalize_column_name(name) == want


def test_lists():
    assert len(c.SPARSE_COLUMNS) == 37 and len(c.SPARSE_PANEL_COLUMNS) == 27
    assert c.normalize_column_name_list(["a", ("b c", "d"), "a"]) == ["a", "b_c_d"]
    assert c.columns_to_drop_mean_only_biophysical(["a_mean", "a_std", "a_count", "b_std"]) == ["a_std", "a_count"]
    assert c.columns_to_drop_default_feature_pruning(["Height_mean_lag1", "x", "Height_mean", "x_std", "x_mean"]) == ["Height_mean_lag1", "Height_mean", "x_std"]
    assert c.is_lagged("a_lag1") and not c.is_lagged("a_lag2") and c.get_base_feature_name("a_lag1") == "a"
    assert {"vent", "vent_lag1"} <= c.get_known_binary_features_with_lag()
    assert c.split_static_dynamic(["subject_id", "hours_in", "age", "hr", "hadm_id_lag1"], ["age", "other"]) == (["age"], ["hr"])
    assert c.first_present(["a", "b"], ["x", "b"]) == "b" and c.first_present([], ["x"]) is None


def test_types(spark):
    df = spark.createDataFrame([(1, 0.0, "m", 5, 0.5), (0, 1.0, None, 7, None)], "flag int, vent double, sex string, n long, x double")
    assert c.identify_feature_types(df) == {"numeric": ["vent", "n", "x"], "binary": ["flag"], "categorical": ["sex"], "integer": ["n"]}
    assert c.identify_feature_types(df, known_binary=["vent"])["binary"] == ["flag", "vent"]
    assert c.is_binary_feature(df, "flag") and not c.is_binary_feature(df, "n")
    assert c.align_to(df, ["x", "gone"]).collect()[1] == (0.0, 0.0)


def test_valid_common(spark):
    a = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 1.0, float("inf")), (3.0, 1.0, float("nan"))], "ok double, flat double, few double")
    assert c.valid_common_numeric_columns(a, a) == ["ok"]
