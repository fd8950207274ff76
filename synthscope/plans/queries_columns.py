"""Registered queries of column, source, profile and split operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import scalars as S
from ..operators import encode, flow, grid, impute, joins, profile, rollout, split
from ..sources import io
from . import results
from .queries import _hashed, query


def _folder(df: DataFrame) -> str:
    """A new folder for tables that a query writes and reads back."""
    return io.scratch_folder(df.sparkSession)


# --- scalar functions -----------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%H:%M') AS clock, hour(ts)::INT AS hour FROM events")
def hour_of_text(t):
    clock = F.date_format("ts", "HH:mm")
    return t("events").select("event_id", clock.alias("clock"), S.hour_of(clock).alias("hour"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS seg_{v}" for v in _SEGMENTS) + " FROM customer")
def one_hot_all(t):
    return t("customer").select("c_custkey", *S.one_hot(F.col("c_mktsegment"), _SEGMENTS, "seg"))


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS seg_{v}" for v in _SEGMENTS[1:]) + " FROM customer")
def one_hot_without_first(t):
    return t("customer").select("c_custkey", *S.one_hot(F.col("c_mktsegment"), _SEGMENTS, "seg", drop_first=True))


@query("SELECT p_partkey, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS price FROM part", "price", "p_partkey", 6)
def standardised(t):
    row = t("part").agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s")).first()
    return t("part").select("p_partkey", S.standardise(F.col("p_retailprice"), F.lit(row["m"]), F.lit(row["s"])).alias("price"))


_GAPS = "(SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind FROM events)"


@query(f"SELECT event_id, coalesce(value, (SELECT median(value) FROM {_GAPS})) AS value, coalesce(kind, (SELECT kind FROM {_GAPS} WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {_GAPS}", "value", "event_id kind")
def median_mode_fill(t):
    gaps = t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind"))
    return impute.fill_median_mode(gaps, ["value"], ["kind"])


@query("SELECT o_orderkey, sha256(o_orderkey::VARCHAR || chr(31) || coalesce(o_orderpriority, chr(0))) AS signature FROM orders")
def row_signatures(t):
    return t("orders").select("o_orderkey", S.signature([F.col("o_orderkey"), F.col("o_orderpriority")]).alias("signature"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round_even(l_extendedprice / l_tax, 2) END AS ratio FROM lineitem", "ratio", "l_orderkey l_linenumber", 2)
def rounded_if_finite(t):
    ratio = F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / F.col("l_tax")).otherwise(F.lit(float("inf")))
    return t("lineitem").select("l_orderkey", "l_linenumber", S.round_if_finite(ratio, 2).alias("ratio"))


@query("SELECT event_id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS took FROM (SELECT event_id, (event_id % 8000)::DOUBLE + 0.37 AS s FROM events)")
def duration_texts(t):
    return t("events").select("event_id", S.duration_text((F.col("event_id") % 8000).cast("double") + 0.37).alias("took"))


# --- columns ---------------------------------------------------------------------------------


@query("SELECT user_id, value, event_type AS \"Heart_Rate_mean\" FROM events")
def normalised_names(t):
    """Names in the order of a list with repeats, once each."""
    wide = t("events").select(F.col("event_type").alias("('Heart Rate', 'mean')"), "value", "user_id")
    names = C.normalize_column_name_list(["user_id", "value", ("Heart Rate", "mean"), "('Heart Rate', 'mean')", "value"])
    return C.flatten_column_names(wide).select(*names)


@query("SELECT event_id, value FROM events")
def without_missing_columns(t):
    df = t("events").select("event_id", "value", F.lit(None).cast("double").alias("never"), F.when(F.col("value") < 0, "").otherwise("").alias("blank"))
    return profile.drop_all_missing(df)


@query("SELECT name FROM (VALUES ('never', (SELECT count(*) FROM events WHERE value < -1e300)), ('blank', (SELECT count(*) FROM events WHERE event_type = '')), ('value', (SELECT count(value) FROM events))) v(name, n) WHERE n = 0")
def all_missing(t):
    df = t("events").select(F.when(F.col("value") < -1e300, F.col("value")).alias("never"), F.when(F.col("event_type") == "", F.col("event_type")).otherwise("").alias("blank"), "value")
    return profile.non_missing_counts(df).where("n = 0").select(F.col("column").alias("name"))


@query("SELECT l_quantity, l_tax FROM lineitem")
def without_ids(t):
    return C.drop_id_columns(t("lineitem").select(F.col("l_orderkey").alias("subject_id"), F.col("l_partkey").alias("hadm_id"), F.col("l_suppkey").alias("icustay_id"), F.col("l_linenumber").alias("hours_in"), "l_quantity", "l_tax"))


@query("SELECT l_orderkey, l_tax AS age, l_quantity AS hr FROM lineitem")
def static_and_dynamic(t):
    df = t("lineitem").select(F.col("l_orderkey").alias("subject_id"), F.col("l_linenumber").alias("hours_in"), F.col("l_linenumber").alias("hours_in_lag1"), F.col("l_tax").alias("age"), F.col("l_quantity").alias("hr"))
    static, dynamic = C.split_static_dynamic(df.columns, ["age", "sex"])
    return df.select(F.col("subject_id").alias("l_orderkey"), *static, *dynamic)


@query("SELECT l_orderkey, l_quantity AS hr FROM lineitem")
def lagged_names(t):
    df = t("lineitem").select("l_orderkey", F.col("l_quantity").alias("hr_lag1"), F.col("l_tax").alias("hr_lag2"))
    return df.select("l_orderkey", *[F.col(c).alias(C.get_base_feature_name(c)) for c in df.columns if C.is_lagged(c)])


_BINARY_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, bool_and({e} IN (0, 1)) AS is_binary FROM lineitem" for n, e in (("returned", "(l_returnflag = 'R')::INT"), ("l_linenumber", "l_linenumber"), ("vent_lag1", "(l_linestatus = 'F')::INT")))


@query(_BINARY_SQL)
def binary_features(t):
    df = t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("returned"), "l_linenumber", (F.col("l_linestatus") == "F").cast("double").alias("vent_lag1"))
    return df.agg(F.count("*")).select(F.explode(F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(C.is_binary_feature(df, c)))])).alias("name", "is_binary"))


@query("SELECT l_orderkey, (l_linestatus = 'F')::INT AS vent, (l_linestatus = 'F')::INT AS vent_lag1 FROM lineitem")
def known_binary(t):
    on = (F.col("l_linestatus") == "F").cast("int")
    df = t("lineitem").select("l_orderkey", on.alias("vent"), on.alias("vent_lag1"), on.alias("vent_lag2"))
    known = C.get_known_binary_features_with_lag()
    return df.select("l_orderkey", *[c for c in df.columns if c in known])


@query("SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def common_columns(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(1).alias("gone"), "o_orderstatus")
    b = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(2).alias("gone"), "c_name")
    names = C.common_columns(a, b, drop=["gone"])
    return a.select(*names).unionByName(b.select(*names))


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_tax, 0.0::DOUBLE AS absent FROM lineitem")
def aligned_columns(t):
    return C.align_to(t("lineitem").select("l_tax", "l_orderkey", "l_quantity"), ["l_orderkey", "l_tax", "absent"])


_ROLES = "CASE WHEN c IN ('click', 'view') AND c IN ('view', 'error') THEN 'both' WHEN c IN ('click', 'view') THEN 'target' WHEN c IN ('view', 'error') THEN 'condition' ELSE 'other' END"


@query(f"SELECT event_id, {_ROLES.replace('c IN', 'event_type IN')} AS role FROM events")
def column_roles(t):
    return t("events").select("event_id", profile.column_role(F.col("event_type"), ["click", "view"], ["view", "error"]).alias("role"))


@query("SELECT 'qty' AS \"column\", 100.0::DOUBLE * count(CASE WHEN l_linenumber > 6 AND l_quantity > 20 THEN 1 END) / count(*) AS pct_known, 100.0::DOUBLE * count(CASE WHEN l_linenumber > 1 THEN 1 END) / count(*) AS lag_pct_known FROM lineitem", "pct_known lag_pct_known", "column", 6)
def coverage_with_lag(t):
    df = t("lineitem").select(F.when((F.col("l_linenumber") > 6) & (F.col("l_quantity") > 20), F.col("l_quantity")).alias("qty"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("qty_lag1"))
    return profile.removal_recommendations(profile.coverage_profile(df)).where("column = 'qty'").select("column", "pct_known", "lag_pct_known")


# --- joins, stacks ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice, c_acctbal FROM orders JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def join_known(t):
    side = t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(0.0).alias("o_totalprice"))
    return joins.join_known(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), side, ["o_custkey"])


@query("SELECT o_orderkey, o_custkey, c_acctbal FROM orders LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def attach_static(t):
    return joins.attach_static(t("orders").select("o_orderkey", "o_custkey"), t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), ["o_custkey"])


@query("SELECT o_custkey, o_orderkey, coalesce(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1.0::DOUBLE) AS o_totalprice_lag1, coalesce((c_acctbal > 0)::INT, 0) AS label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON o_custkey = c_custkey", "o_totalprice_lag1", "o_custkey o_orderkey label")
def attach_labels(t):
    """Labels join after lagging, so they get no lag."""
    from ..operators import lag

    table = lag.prepare_autoregressive_data(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")[0]
    labels = t("customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") > 0).cast("int").alias("label"))
    return joins.attach_labels(table, labels, "o_custkey", unknown=0)


@query("SELECT l_orderkey AS trajectory_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1)::INT AS timestep, l_quantity AS qty FROM lineitem", "qty", "trajectory_id timestep")
def stacked_trajectories(t):
    arrays = t("lineitem").groupBy(F.col("l_orderkey").alias("trajectory_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_quantity").alias("qty")))).alias("steps"))
    return grid.stack_trajectories(arrays, "steps").select("trajectory_id", "timestep", "qty")


# --- splits -------------------------------------------------------------------------------------


def _least(n: int, seed: int, key: str, table: str) -> str:
    return f"SELECT {key} FROM {table} ORDER BY {_hashed(seed, key)}, {key} LIMIT {n}"


@query(f"SELECT p_partkey, p_size FROM part WHERE p_partkey IN ({_least(150, 4, 'p_partkey', 'part')})")
def capped_rows(t):
    return split.capped(t("part").select("p_partkey", "p_size"), 150, ["p_partkey"], 4)


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ({_least(40, 2, 'o_custkey', '(SELECT DISTINCT o_custkey FROM orders)')})")
def capped_subjects(t):
    return split.cap_subjects(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 40, 2)


@query(f"SELECT p_partkey, draw FROM (SELECT p_partkey, row_number() OVER (ORDER BY {_hashed(6, 'p_partkey')}, p_partkey) - 1 AS draw FROM part) WHERE draw < 120")
def sampled_rows(t):
    return split.sample_rows(t("part").select("p_partkey"), 120, ["p_partkey"], seed=6)


_HALVES = "(SELECT c_custkey, c_nationkey < 15 AS inside FROM customer)"


@query(
    f"SELECT c_custkey, inside::INT AS member FROM (SELECT *, row_number() OVER (PARTITION BY inside ORDER BY {_hashed(0, 'c_custkey')}, c_custkey) AS r FROM {_HALVES}) "
    f"WHERE r <= (SELECT least(greatest(1, count(*) FILTER (inside) // 2), count(*) FILTER (NOT inside)) FROM {_HALVES})"
)
def attack_candidates(t):
    c = t("customer").select("c_custkey", "c_nationkey")
    return split.member_candidates(c.where("c_nationkey < 15"), c.where("c_nationkey >= 15"), ["c_custkey"]).select("c_custkey", "member")


def _unit(seed: int, tail: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || id || ':{tail}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"SELECT id, lo + {_unit(1, 'p_retailprice')} * (hi - lo) AS p_retailprice, brands[floor({_unit(1, 'p_brand')} * len(brands))::INT + 1] AS p_brand FROM (SELECT unnest(range(0, n)) AS id, lo, hi, brands FROM (SELECT count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi, list_sort(list(DISTINCT p_brand)) AS brands FROM part))", "p_retailprice", "id p_brand", 6)
def random_rows(t):
    return split.random_rows(t("part"), t("part").count(), ["p_retailprice"], ["p_brand"], 1)


# --- encoder, generation -----------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal, (code - 1)::DOUBLE AS segment FROM (SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal, dense_rank() OVER (ORDER BY c_mktsegment) AS code FROM customer)")
def encoded_vectors(t):
    """Target and condition arrays, with the encoder's metadata checked."""
    enc = encode.TabularEncoder.fit(t("customer"), ["c_acctbal"], [], ["c_mktsegment"])
    if enc.columns != ["c_acctbal", "c_mktsegment"] or enc.feature_types != ["q", "c"] or enc.split_indices(["c_acctbal"], ["c_mktsegment"]) != ([0], [1]):
        raise ValueError("metadata")
    rows = enc.vectors(t("customer"), ["c_acctbal"], ["c_mktsegment"], ["c_custkey"])
    return rows.select("c_custkey", F.get("x_target", 0).alias("c_acctbal"), F.get("x_cond", 0).alias("segment"))


@query("SELECT c_custkey AS id, 0 AS step, c_acctbal, (c_nationkey > 12)::INT AS inside, c_mktsegment FROM customer", "c_acctbal", "id step inside c_mktsegment")
def flat_rows(t):
    """Encoded arrays back as a table."""
    c = t("customer").select(F.col("c_custkey").alias("id"), F.lit(0).alias("step"), "c_acctbal", (F.col("c_nationkey") > 12).cast("int").alias("inside"), "c_mktsegment")
    enc = encode.TabularEncoder.fit(c, ["c_acctbal"], ["inside"], ["c_mktsegment"])
    rows = enc.vectors(c, ["c_acctbal", "inside"], ["c_mktsegment"], ["id", "step"]).select("id", "step", F.col("x_target").alias("x"), "x_cond")
    return rollout.create_flat_dataframe(c.sparkSession, rows, enc, ["c_acctbal", "inside"], ["c_mktsegment"])


@query(f"SELECT id, CASE WHEN {_unit(0, 'label')} < n1 / n THEN 'F' WHEN {_unit(0, 'label')} < n2 / n THEN 'O' ELSE 'P' END AS o_orderstatus FROM (SELECT c_custkey AS id FROM customer), (SELECT count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n2, count(*)::DOUBLE AS n FROM orders)")
def drawn_labels(t):
    return flow.draw_labels(t("customer").select(F.col("c_custkey").alias("id")), t("orders").groupBy("o_orderstatus").count(), "o_orderstatus", "id")


# --- sources ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice", "o_orderkey o_orderstatus", 4)
def csv_round_trip(t):
    path = _folder(o := t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    io.write_table(o, path, "csv")
    return io.load_csv(o.sparkSession, path, schema=o.schema)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def parquet_round_trip(t):
    path = _folder(o := t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    io.write_table(o, path)
    return io.load_parquet(o.sparkSession, path, ["o_orderkey", "o_totalprice"])


@query("SELECT p_partkey::INT AS p_partkey, p_size::INT AS p_size FROM part")
def flat_csv(t):
    path = _folder(p := t("part").select("p_partkey", "p_size", "p_brand"))
    io.write_table(p, path, "csv")
    return io.load_flat_table(p.sparkSession, path, exclude_cols=["p_brand", "absent"]).select(F.col("p_partkey").cast("int"), F.col("p_size").cast("int"))


@query("SELECT user_id AS entity_id, '00:00' AS time, event_type AS parameter, value FROM events", "value", "entity_id time parameter", 6)
def eav_files(t):
    """A file for some users each, scanned as one."""
    path = _folder(e := t("events"))
    rows = e.select("user_id", F.lit("00:00").alias("Time"), F.col("event_type").alias("Parameter"), F.col("value").cast("string").alias("Value"))
    ids = e.select("user_id").distinct().select("user_id", F.lit("00:00").alias("Time"), F.lit("RecordID").alias("Parameter"), F.col("user_id").cast("string").alias("Value"))
    tasks = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, else few bytes make one task, which writes all files
    rows.unionByName(ids).repartition(tasks, "user_id").write.partitionBy("user_id").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", 2).csv(path)  # tasks move their own files into place
    return io.read_eav_files(e.sparkSession, path)


@query("SELECT count(*) AS n FROM lineitem")
def row_count(t):
    df = t("lineitem")
    return df.agg(F.lit(io.count_rows(df)).cast("long").alias("n"))


_APPENDED = T.StructType([T.StructField("cell", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])


@query("SELECT o_orderkey AS cell, o_totalprice AS score, NULL::VARCHAR AS error FROM orders")
def appended_results(t):
    """Appended in two parts, the second of which is tried twice."""
    path = _folder(o := t("orders").select(F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("score"), F.lit(1).alias("unknown")))
    io.append_results(o.where("cell % 2 = 0"), path, _APPENDED, ["cell"])
    for _ in range(2):
        io.append_results(o, path, _APPENDED, ["cell"])
    return io.load_parquet(o.sparkSession, path)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def cast_back(t):
    """Columns as text, cast to the types of the table that they came from."""
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return io.cast_like(df.select(*[F.col(c).cast("string") for c in df.columns]), df)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def json_report(t):
    path = _folder(o := t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")))
    io.write_json_report(o, path)
    return o.sparkSession.read.schema(o.schema).json(path)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def built_once(t):
    """A stored table, read again where its signature holds."""
    path, p = _folder(t("part")), t("part").groupBy("p_brand").agg(F.count("*").alias("n"))
    first = io.cached_by_signature(p.sparkSession, path, {"columns": "p_brand", "version": 1}, lambda: p)
    first = io.reuse_or_build(p.sparkSession, f"{path}/again", lambda: first)
    io.cached_by_signature(p.sparkSession, path, {"version": 1, "columns": "p_brand"}, lambda: p.where("false"))
    return io.reuse_or_build(p.sparkSession, f"{path}/again", lambda: p.where("false"))


@query("SELECT o_orderstatus AS status, count(*) AS n, sum(o_totalprice) * any_value(CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END) AS total, any_value(CASE o_orderstatus WHEN 'P' THEN 2 ELSE 1 END)::INT AS built FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_orderstatus", "total", "status n built", 1)
def refreshed_table(t):
    """A table kept up to date with a folder tree: after the files of one status changed and those of another went, only the changed ones are built again."""
    orders = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    spark, folder = orders.sparkSession, _folder(orders)
    write = lambda rows, status: rows.where(F.col("status") == status).write.mode("overwrite").parquet(f"{folder}/source/{status}/x")
    for status in "FOP":
        write(orders, status)
    built = lambda n: io.refreshed(spark, f"{folder}/source", f"{folder}/target", lambda files: spark.read.parquet(*files).select("*", F.col("_metadata.file_path").alias("file"), F.lit(n).alias("built")))
    built(1)
    write(orders.withColumn("price", F.col("price") * 2), "P")
    write(orders.where("false"), "O")
    return built(2).groupBy("status").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.max("built").alias("built"))


@query("SELECT o_orderkey, (o_orderkey % 21)::INT AS nt, (o_orderkey % 34)::INT AS noise FROM orders")
def numbers_of_paths(t):
    path = F.format_string("models/flow_nt%d_noise%d.bin", (F.col("o_orderkey") % 21).cast("int"), (F.col("o_orderkey") % 34).cast("int"))
    return t("orders").select("o_orderkey", *io.parse_path_numbers(path, "nt", "noise"))


@query("SELECT nt, n_noise FROM (SELECT unnest([1, 2, 3, 5, 8, 13, 21]) AS nt), (SELECT unnest([1, 2, 3, 5, 8, 13, 21]) AS n_noise) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 22 = nt AND o_orderkey % 23 = n_noise AND o_totalprice > 300000)")
def profile_resume(t):
    """Cells of the full profile without a result."""
    o = t("orders").select((F.col("o_orderkey") % 22).cast("int").alias("nt"), (F.col("o_orderkey") % 23).cast("int").alias("n_noise"), F.when(F.col("o_totalprice") > 300000, "").otherwise("failed").alias("error"))
    return results.remaining(results.profile_grid(o.sparkSession, "challenge2012"), o)
