"""Registered queries: each operator on the driver's tables, with SQL that says the same.

Entities are users of ``events`` (a step a day) or orders of ``lineitem`` (a step a line). The
"synthetic" side of a comparison is the other half of the orders by hash, with shifted
columns, so that gaps are not zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import dist, rank
from ..functions import scalars as S
from ..operators import encode, flow, grid, impute, knn, lag, profile, rollout, split
from ..sources import io
from . import privacy, quality, results, trajectory, utility

QUERIES: dict = {}
ORACLES: dict = {}
KINDS = ["click", "error", "purchase", "signup", "view"]
N_STEPS = 30


def query(sql: str | None = None, floats: str = "", keep: str = "", digits: int = 9):
    """Registers a function of a table reader; the doubles named in ``floats`` are rounded on both sides."""
    names, rest = floats.split(), keep.split()

    def register(f):
        def run(spark, sf_dir):
            out = f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
            return out.select(*rest, *[(F.round(F.col(n).cast("double"), digits) + 0.0).alias(n) for n in names]) if names else out

        QUERIES[f.__name__] = run
        if sql:
            head = ", ".join([*[f'"{n}"' for n in rest], *[f'round("{n}"::DOUBLE, {digits}) + 0.0::DOUBLE AS "{n}"' for n in names]])  # no minus zero
            ORACLES[f.__name__] = f"SELECT {head} FROM ({sql})" if names else sql
        return f

    return register


# --- shared inputs ----------------------------------------------------------------------

EAV = "(SELECT user_id, event_type AS parameter, value, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS step FROM events)"
SIDE = "('0x' || substr(md5('0:' || {}), 1, 13))::BIGINT % 2"
LINE_COLS = ["qty", "price", "disc", "tax"]
LINES = f"(SELECT l_orderkey AS id, (l_linenumber::BIGINT * 1000000 + l_partkey) * 1000000 + floor(l_extendedprice * 100)::BIGINT % 1000000 AS t, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_returnflag AS flag, l_linestatus AS status, {SIDE.format('l_orderkey')} AS side FROM lineitem)"
REAL = f"(SELECT id, t, qty, price, disc, tax, flag, status FROM {LINES} WHERE side = 0)"
SYNTH = f"(SELECT id, t, qty * 1.1::DOUBLE AS qty, price * 0.9::DOUBLE AS price, disc + tax AS disc, tax, CASE WHEN disc > 0.08::DOUBLE THEN 'X' ELSE flag END AS flag, status FROM {LINES} WHERE side = 1)"


def eav(t) -> DataFrame:
    return t("events").select("user_id", F.col("event_type").alias("parameter"), "value", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("step"))


def lines(t) -> DataFrame:
    place = (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")) * 1000000 + F.floor(F.col("l_extendedprice") * 100) % 1000000  # lines tie within an order
    return t("lineitem").select(F.col("l_orderkey").alias("id"), place.alias("t"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def real_synth(t) -> tuple[DataFrame, DataFrame]:
    side = S.hash_rank(0, F.col("id")) % 2
    real = lines(t).where(side == 0)
    synth = lines(t).where(side == 1).select("id", "t", (F.col("qty") * 1.1).alias("qty"), (F.col("price") * 0.9).alias("price"), (F.col("disc") + F.col("tax")).alias("disc"), "tax", F.when(F.col("disc") > 0.08, "X").otherwise(F.col("flag")).alias("flag"), "status")
    return real, synth


def wide(t) -> DataFrame:
    return grid.median_wide(grid.grid_rows(eav(t), N_STEPS), "user_id", "step", KINDS)


WIDE = "(SELECT user_id, step, " + ", ".join(f"median(value) FILTER (parameter = '{k}') AS {k}" for k in KINDS) + f" FROM {EAV} WHERE step >= 0 AND step < {N_STEPS} GROUP BY user_id, step)"
DENSE = f"(SELECT i.user_id, s.step, {', '.join(KINDS)} FROM (SELECT DISTINCT user_id FROM events) i CROSS JOIN (SELECT unnest(range(0, {N_STEPS}))::INT AS step) s LEFT JOIN {WIDE} w ON i.user_id = w.user_id AND s.step = w.step)"


def dense(t) -> DataFrame:
    return grid.dense_grid(t("events"), wide(t), "user_id", "step", N_STEPS)


def _ff(k: str, order: str) -> str:
    return f"last_value({k} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if order == "f" else f"first_value({k} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


FILLED = f"(SELECT user_id, step, {', '.join(f'coalesce({_ff(k, chr(102))}, {_ff(k, chr(98))}) AS {k}' for k in KINDS)} FROM {DENSE})"


def filled(t) -> DataFrame:
    return impute.fill_both_ways(dense(t), "user_id", "step", KINDS)


# --- grid, filling, lags ------------------------------------------------------------------


@query(f"SELECT *, {', '.join(f'coalesce(lag({k}) OVER (PARTITION BY user_id ORDER BY step), -1.0::DOUBLE) AS {k}_lag1' for k in KINDS)} FROM {FILLED}", " ".join([*KINDS, *[f"{k}_lag1" for k in KINDS]]), "user_id step")
def lag_table(t):
    """Events to medians to a dense, filled grid with lags: the flagship."""
    return lag.prepare_autoregressive_data(filled(t), "user_id", "step")[0]


@query(f"SELECT * FROM {WIDE}", " ".join(KINDS), "user_id step")
def median_pivot(t):
    return wide(t)


@query(f"SELECT * FROM {DENSE}", " ".join(KINDS), "user_id step")
def dense_grid(t):
    return dense(t)


@query(f"SELECT user_id, step, {', '.join(f'{_ff(k, chr(102))} AS {k}' for k in KINDS)} FROM {DENSE}", " ".join(KINDS), "user_id step")
def forward_fill(t):
    return impute.forward_fill(dense(t), "user_id", "step", KINDS)


@query(f"SELECT user_id, step, {', '.join(f'{_ff(k, chr(98))} AS {k}' for k in KINDS)} FROM {DENSE}", " ".join(KINDS), "user_id step")
def backward_fill(t):
    return impute.backward_fill(dense(t), "user_id", "step", KINDS)


@query(f"SELECT user_id, step, {', '.join(f'coalesce({k}, (SELECT median({k}) FROM {DENSE})) AS {k}' for k in KINDS)} FROM {DENSE}", " ".join(KINDS), "user_id step")
def median_fill(t):
    d = dense(t)
    return impute.fill_values(d, impute.column_medians(d, KINDS))


_MEAN2 = f"SELECT user_id, step, {', '.join(f'lag({k}, 2) OVER (PARTITION BY user_id ORDER BY step) AS {k}_lag2' for k in KINDS)} FROM {DENSE}"


@query(f"SELECT user_id, step, {', '.join(f'coalesce({k}_lag2, avg({k}_lag2) OVER ()) AS {k}_lag2' for k in KINDS)} FROM ({_MEAN2})", " ".join(f"{k}_lag2" for k in KINDS), "user_id step")
def lag2_mean_fill(t):
    return lag.prepare_autoregressive_data(dense(t), "user_id", "step", lag=2, fill_strategy="mean")[0]


@query(f"SELECT user_id, step, {', '.join(f'coalesce(lag({k}) OVER (PARTITION BY user_id ORDER BY step), 0.0::DOUBLE) AS {k}_lag1' for k in KINDS)} FROM {DENSE}", " ".join(f"{k}_lag1" for k in KINDS), "user_id step")
def lag_zero_fill(t):
    return lag.prepare_autoregressive_data(dense(t), "user_id", "step", fill_strategy="zero")[0]


@query(f"SELECT id, abs(qty - before) AS step FROM (SELECT id, qty, lag(qty) OVER (PARTITION BY id ORDER BY t) AS before FROM {LINES}) WHERE before IS NOT NULL", "step", "id")
def absolute_steps(t):
    return lag.absolute_steps(lines(t), "id", "t", "qty")


@query(f"SELECT user_id, {', '.join(f'min_by({k}, step) FILTER ({k} IS NOT NULL) AS {k}' for k in KINDS)}, min(step) AS step FROM {WIDE} GROUP BY user_id", " ".join(KINDS), "user_id step")
def first_rows(t):
    return grid.first_rows(wide(t), "user_id", "step")


@query(f"SELECT user_id, step, {', '.join(KINDS)} FROM {WIDE} WHERE step = 0", " ".join(KINDS), "user_id step")
def hour0_rows(t):
    return grid.hour0_rows(wide(t), "user_id", "step")


@query(f"SELECT user_id, min_by(value, event_id) FILTER (event_type = 'click') AS click, min_by(CASE WHEN value > 50 THEN value END, event_id) FILTER (event_type = 'view' AND value > 50) AS view FROM events GROUP BY user_id", "click view", "user_id")
def static_attributes(t):
    rows = t("events").select("user_id", F.col("event_type").alias("parameter"), "value", "event_id")
    return grid.static_attributes(rows.where("parameter = 'click' or (parameter = 'view' and value > 50)"), "user_id", ["click", "view"], "event_id").join(rows.select("user_id").distinct(), "user_id", "right")


@query(f"SELECT user_id, (max(CASE WHEN parameter = 'purchase' THEN value ELSE 0 END) > 300)::INT AS label FROM {EAV} GROUP BY user_id")
def any_label(t):
    return grid.any_label(eav(t), "user_id", F.when((F.col("parameter") == "purchase") & (F.col("value") > 300), 1.0).otherwise(0.0))


@query("SELECT c.c_custkey, c.c_acctbal, o.o_orderkey, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def inner_join(t):
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_acctbal", "o_orderkey", "o_totalprice")


@query(f"SELECT user_id, step, parameter, value, c_mktsegment FROM {EAV} e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def static_left_join(t):
    return eav(t).join(t("customer").select("c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey"), "left").select("user_id", "step", "parameter", "value", "c_mktsegment")


# --- columns, profiles, splits ----------------------------------------------------------------


@query('SELECT l_orderkey AS "Heart_Rate_mean", l_quantity AS "plain" FROM lineitem')
def flatten_names(t):
    return C.flatten_column_names(t("lineitem").select(F.col("l_orderkey").alias("('Heart Rate', 'mean')"), F.col("l_quantity").alias("plain")))


@query('SELECT l_quantity AS "Heart_Rate_mean", l_tax AS "other_std" FROM lineitem')
def pruned_columns(t):
    df = t("lineitem").select(F.col("l_quantity").alias("Heart_Rate_mean"), F.col("l_discount").alias("Heart_Rate_std"), F.col("l_tax").alias("other_std"), F.col("l_tax").alias("Height_mean"), F.col("l_tax").alias("Height_mean_lag1"))
    return C.prune(df)


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def without_dates(t):
    return C.drop_datetime_columns(t("events"), by_type=True)


_IS_BINARY = "CASE WHEN bool_and(is_click IN (0, 1)) THEN 'binary' ELSE 'integer' END"


@query(
    f"SELECT 'is_click' AS name, {_IS_BINARY} AS kind FROM (SELECT (event_type = 'click')::INT AS is_click FROM events) "
    f"UNION ALL SELECT 'l', {_IS_BINARY} FROM (SELECT event_id AS is_click FROM events) UNION ALL SELECT 'p', CASE WHEN any_value(typeof(props)) = 'VARCHAR' THEN 'categorical' ELSE 'numeric' END FROM events UNION ALL SELECT 'value', CASE WHEN any_value(typeof(value)) = 'DOUBLE' THEN 'numeric' ELSE 'categorical' END FROM events"
)
def feature_types(t):
    df = t("events").select(F.when(F.col("event_type") == "click", 1).otherwise(0).alias("is_click"), F.col("event_id").alias("l"), F.col("props").alias("p"), "value")
    found = C.identify_feature_types(df)
    kinds = {c: k for k in ("numeric", "binary", "categorical", "integer") for c in found[k]}
    return df.agg(F.count("*")).select(F.explode(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])).alias("name", "kind"))


@query(f"SELECT k AS \"column\", n FROM (SELECT {', '.join(f'count({k}) AS {k}' for k in KINDS)} FROM {WIDE}) UNPIVOT (n FOR k IN ({', '.join(KINDS)}))")
def non_missing(t):
    return profile.non_missing_counts(wide(t).select(*KINDS))


def _coverage(table: str, names: list[str]) -> str:
    one = lambda k: f"SELECT '{k}' AS \"column\", count(*) AS n_rows, count({k}) AS n_known, 100.0::DOUBLE * count({k}) / count(*) AS pct_known, avg(({k} = -1)::INT) * 100 AS pct_sentinel, avg({k}) AS mean, stddev_pop({k}) AS std, min({k}) AS low, max({k}) AS high FROM {table}"
    return " UNION ALL ".join(map(one, names))


@query(_coverage(DENSE, KINDS), "pct_known pct_sentinel mean std low high", "column n_rows n_known", 6)
def coverage_profile(t):
    return profile.coverage_profile(dense(t).select(*KINDS))


_TIERS = f"SELECT \"column\", pct_known, CASE WHEN pct_known < 1 THEN 'REMOVE' WHEN pct_known < 5 THEN 'REMOVE_IF_PANEL' WHEN pct_known < 15 THEN 'REVIEW' END AS recommendation FROM ({_coverage('(SELECT CASE WHEN step > 25 THEN click END AS click, CASE WHEN step = 3 THEN signup END AS signup, CASE WHEN step > 28 AND user_id < 20 THEN view END AS view, purchase FROM ' + DENSE + ')', ['click', 'signup', 'view', 'purchase'])})"


@query(f"SELECT * FROM ({_TIERS}) WHERE recommendation IS NOT NULL", "pct_known", "column recommendation")
def removal_tiers(t):
    df = dense(t).select(F.when(F.col("step") > 25, F.col("click")).alias("click"), F.when(F.col("step") == 3, F.col("signup")).alias("signup"), F.when((F.col("step") > 28) & (F.col("user_id") < 20), F.col("view")).alias("view"), "purchase")
    return profile.removal_recommendations(profile.coverage_profile(df)).select("column", "pct_known", "recommendation")


@query("SELECT event_type AS value, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM events GROUP BY event_type", "share", "value n")
def value_shares(t):
    return profile.value_shares(t("events"), "event_type")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) < 45 THEN 'OTHER' ELSE p_name END AS name FROM part")
def rare_bucket(t):
    return profile.bucket_rare(t("part").select("p_partkey", F.col("p_name").alias("name")), "name", 45)


def _hashed(seed: int, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 13))::BIGINT"


_RANKED = f"SELECT c_custkey, row_number() OVER (ORDER BY {_hashed(0, 'c_custkey')}, c_custkey) AS r, count(*) OVER () AS n FROM customer"


@query(f"SELECT c_custkey, CASE WHEN r <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'test' WHEN r <= greatest(1, floor(n * 0.1::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE)) THEN 'holdout' ELSE 'train' END AS part FROM ({_RANKED})")
def subject_split(t):
    return split.subject_split(t("customer"), "c_custkey")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ({_RANKED}) WHERE r <= greatest(1, floor(n * 0.1::DOUBLE)))")
def test_part_rows(t):
    parts = split.subject_split(t("customer"), "c_custkey").withColumnRenamed("c_custkey", "o_custkey")
    return split.take_part(t("orders"), parts, "o_custkey", "test").select("o_orderkey", "o_totalprice")


@query(f"SELECT p_partkey FROM part ORDER BY {_hashed(3, 'p_partkey')}, p_partkey LIMIT 100")
def hashed_sample(t):
    return split.smallest_hashes(t("part"), 100, ["p_partkey"], 3).select("p_partkey")


@query(f"SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_hashed(0, 'c_custkey')}, c_custkey) <= ceil(count(*) OVER (PARTITION BY c_mktsegment) * 0.3::DOUBLE) AS is_test FROM customer")
def stratified_split(t):
    return split.train_test_split(t("customer"), 0.3, ["c_custkey"], "c_mktsegment").select("c_custkey", "c_mktsegment", "is_test")


@query(f"SELECT i AS draw, c_custkey FROM (SELECT unnest(range(0, 500)) AS i) d JOIN (SELECT c_custkey, row_number() OVER (ORDER BY ('0x' || substr(md5('5:' || c_custkey), 1, 13))::BIGINT, c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer) p ON ('0x' || substr(md5('5:' || i), 1, 13))::BIGINT % n = k")
def bootstrap_rows(t):
    return split.bootstrap(t("customer").select("c_custkey"), 500, ["c_custkey"], 5)


# --- scalars, encoder -----------------------------------------------------------------------------


@query(
    "SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) AS none, coalesce(nullif(p_size, 7), -1)::INT AS size, least(greatest(round_even(p_retailprice / 1000 - 0.5, 0), 0), 1)::INT AS clipped, coalesce(nullif(trim(p_type), ''), 'Unknown') AS kind, "
    "CASE WHEN p_size < 2 THEN 0 WHEN p_size < 7 THEN 1 ELSE 2 END AS binned FROM part"
)
def scalar_functions(t):
    return t("part").select("p_partkey", S.to_number(F.col("p_name")).alias("none"), F.coalesce(S.sentinel_to_null(F.col("p_size"), 7).cast("int"), F.lit(-1)).alias("size"), S.round_clip(F.col("p_retailprice") / 1000 - 0.5).alias("clipped"), S.normalise_text(F.col("p_type")).alias("kind"), S.bin_by_edges(F.col("p_size")).alias("binned"))


@query("SELECT 'c_mktsegment' AS col, c_mktsegment AS value, (row_number() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def label_codes(t):
    return encode.codes_of(encode.label_state(t("customer"), ["c_mktsegment"]))


@query("SELECT 'o_orderpriority' AS col, v AS value, (row_number() OVER (ORDER BY v <> '__NAN__', v) - 1)::INT AS code FROM (SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN '__NAN__' ELSE o_orderpriority END AS v FROM orders)")
def merged_fit_state(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return encode.codes_of(encode.merge_states(*[encode.label_state(o.where(F.col("o_orderkey") % 4 == k), ["o_orderpriority"]) for k in range(4)]))


def _encoder(t):
    train = t("customer").where("c_mktsegment <> 'BUILDING'")
    return encode.TabularEncoder.fit(train, ["c_acctbal"], [], ["c_mktsegment"])


_CODES = "(SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'))"


@query(f"SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal, coalesce(code, 0)::DOUBLE AS c_mktsegment FROM customer LEFT JOIN {_CODES} ON c_mktsegment = v")
def encode_rows(t):
    return _encoder(t).transform(t("customer"), ["c_custkey"])


@query(f"SELECT c_custkey, c_acctbal, CASE WHEN code IS NULL THEN (SELECT v FROM {_CODES} WHERE code = 0) ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN {_CODES} ON c_mktsegment = v")
def decode_round_trip(t):
    enc = _encoder(t)
    return enc.inverse_transform(enc.transform(t("customer"), ["c_custkey"]), ["c_custkey"])


_ERRORS = "(SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE event_type = 'error' GROUP BY user_id)"


@query(f"SELECT user_id, list_resize(v, n, 0.0::DOUBLE) AS padded, [CASE WHEN i <= len(v) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END for i in range(1, n + 1)] AS present FROM {_ERRORS}, (SELECT max(len(v)) AS n FROM {_ERRORS})")
def padded_vectors(t):
    """Each user's values, padded to the longest list, and which places are filled."""
    e = t("events").where("event_type = 'error'").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("v"))
    longest = e.agg(F.max(F.size("v"))).first()[0] or 1
    return e.select("user_id", S.padded(F.col("v"), longest).alias("padded"), S.presence(F.col("v"), longest).alias("present"))


# --- distributions and quality ------------------------------------------------------------------------


def _pairs(a: str, b: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"column\", {k} AS v, {s} AS s FROM {x}" for k in names for s, x in ((0, a), (1, b)))


_CUM = f"SELECT \"column\", v, sum(sum(1 - s)) OVER w / sum(sum(1 - s)) OVER (PARTITION BY \"column\")::DOUBLE AS fr, sum(sum(s)) OVER w / sum(sum(s)) OVER (PARTITION BY \"column\")::DOUBLE AS fs, lead(v) OVER w AS nx FROM ({_pairs(REAL, SYNTH, LINE_COLS)}) GROUP BY \"column\", v WINDOW w AS (PARTITION BY \"column\" ORDER BY v)"


@query(f"SELECT \"column\", max(abs(fr - fs)) AS ks FROM ({_CUM}) GROUP BY \"column\"", "ks", "column")
def ks_statistics(t):
    return dist.ks_statistics(*real_synth(t), LINE_COLS)


@query(f"SELECT c.\"column\", coalesce(sum(abs(fr - fs) * (nx - v)), 0) AS wasserstein, coalesce(sum(abs(fr - fs) * (nx - v)), 0) / any_value(d.s) AS scaled FROM ({_CUM}) c JOIN (SELECT unnest({LINE_COLS}) AS \"column\", unnest([stddev_pop(qty), stddev_pop(price), stddev_pop(disc), stddev_pop(tax)]) AS s FROM {REAL}) d ON c.\"column\" = d.\"column\" GROUP BY c.\"column\"", "wasserstein scaled", "column", 6)
def wasserstein(t):
    return dist.wasserstein(*real_synth(t), LINE_COLS)


def _shares(name: str) -> str:
    return f"(SELECT coalesce(a.v, b.v) AS v, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT {name} AS v, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM {REAL} GROUP BY {name}) a FULL JOIN (SELECT {name} AS v, count(*) / sum(count(*)) OVER ()::DOUBLE AS q FROM {SYNTH} GROUP BY {name}) b ON a.v = b.v)"


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"column\", 0.5 * sum(abs(p - q)) AS tv FROM {_shares(k)}" for k in ("flag", "status")), "tv", "column")
def total_variation(t):
    return dist.total_variation(*real_synth(t), ["flag", "status"])


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"column\", sqrt(greatest(0, sum(0.5 * CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END))) AS js FROM {_shares(k)}" for k in ("flag", "status")), "js", "column", 7)
def js_distance(t):
    return dist.js_distance(*real_synth(t), ["flag", "status"])


@query("SELECT avg(l_quantity) AS mean, median(l_quantity) AS median, quantile_cont(l_quantity, 0.95) AS p95, count(l_quantity) AS n FROM lineitem", "mean median p95", "n")
def column_summary(t):
    return dist.summarise(t("lineitem"), "l_quantity")


_PAIRS = [(a, b) for i, a in enumerate(LINE_COLS) for b in LINE_COLS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {REAL}" for a, b in _PAIRS), "r", "a b")
def correlations(t):
    return quality.correlations(real_synth(t)[0], LINE_COLS)


_FRO = " UNION ALL ".join(f"SELECT (SELECT corr({a}, {b}) FROM {SYNTH}) - (SELECT corr({a}, {b}) FROM {REAL}) AS d" for a, b in _PAIRS)


@query(f"SELECT sqrt(2 * sum(d * d)) AS corr_frobenius FROM ({_FRO})", "corr_frobenius")
def corr_frobenius(t):
    return quality.corr_frobenius(*[d.select(*LINE_COLS) for d in real_synth(t)])


_RANGES = {"qty": (2, 50), "disc": (0.01, 0.1)}


@query(f"SELECT 100.0 * (count(*) FILTER (qty < 2 OR qty > 50) + count(*) FILTER (disc < 0.01 OR disc > 0.1)) / (count(qty) + count(disc)) AS range_violation_pct FROM {SYNTH}", "range_violation_pct")
def range_violations(t):
    return quality.range_violation_pct(real_synth(t)[1], _RANGES)


@query(f"SELECT (SELECT avg(ks) FROM (SELECT max(abs(fr - fs)) AS ks FROM ({_CUM}) GROUP BY \"column\")) AS avg_ks_stat, (SELECT sqrt(2 * sum(d * d)) FROM ({_FRO})) AS corr_frobenius, (SELECT 100.0 * (count(*) FILTER (qty < 2 OR qty > 50) + count(*) FILTER (disc < 0.01 OR disc > 0.1)) / (count(qty) + count(disc)) FROM {SYNTH}) AS range_violation_pct", "avg_ks_stat corr_frobenius range_violation_pct")
def quality_bundle(t):
    return quality.quality_metrics(*[d.select(*LINE_COLS) for d in real_synth(t)], _RANGES)


# --- trajectories ------------------------------------------------------------------------------------


def _acf(table: str) -> str:
    parts = " UNION ALL ".join(f"SELECT id, '{k}' AS feature, count(*) AS n, count(b) AS m, stddev_pop(b) AS sb, stddev_pop(CASE WHEN b IS NOT NULL THEN x END) AS sx, covar_pop(b, x) AS cv FROM (SELECT id, {k} AS x, lag({k}) OVER (PARTITION BY id ORDER BY t) AS b FROM {table}) GROUP BY id" for k in LINE_COLS)
    return f"(SELECT id, feature, cv / (sb * sx) AS r FROM ({parts}) WHERE n >= 4 AND m >= 2 AND sb >= 1e-12 AND sx >= 1e-12)"


@query(f"SELECT * FROM {_acf(REAL)}", "r", "id feature", 7)
def autocorrelations(t):
    return trajectory.autocorrelations(real_synth(t)[0], "id", "t", LINE_COLS)


@query(f"SELECT avg(abs(a.r - b.r)) AS autocorr_distance FROM (SELECT feature, median(r) AS r FROM {_acf(REAL)} GROUP BY feature) a JOIN (SELECT feature, median(r) AS r FROM {_acf(SYNTH)} GROUP BY feature) b ON a.feature = b.feature", "autocorr_distance", digits=7)
def autocorr_distance(t):
    return trajectory.autocorr_distance(*real_synth(t), "id", "t", LINE_COLS)


_LEN = f"SELECT v, sum(sum(1 - s)) OVER w / sum(sum(1 - s)) OVER ()::DOUBLE AS fr, sum(sum(s)) OVER w / sum(sum(s)) OVER ()::DOUBLE AS fs FROM (SELECT count(*) AS v, 0 AS s FROM {REAL} GROUP BY id UNION ALL SELECT count(*), 1 FROM {SYNTH} GROUP BY id) GROUP BY v WINDOW w AS (ORDER BY v)"


@query(f"SELECT max(abs(fr - fs)) AS stay_length_ks FROM ({_LEN})", "stay_length_ks")
def stay_length_ks(t):
    return trajectory.stay_length_ks(*real_synth(t), "id")


def _steps(table: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{k}' AS feature, avg(abs(x - b)) AS step FROM (SELECT {k} AS x, lag({k}) OVER (PARTITION BY id ORDER BY t) AS b FROM {table})" for k in LINE_COLS) + ")"


@query(f"SELECT avg(b.step / a.step) AS transition_mse_ratio FROM {_steps(REAL)} a JOIN {_steps(SYNTH)} b ON a.feature = b.feature WHERE a.step > 1e-9", "transition_mse_ratio")
def step_ratio(t):
    return trajectory.transition_mse_ratio(*real_synth(t), "id", "t", LINE_COLS)


def _xcorr(table: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT id, '{a}|{b}' AS pair, covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) AS r FROM {table} GROUP BY id HAVING count(*) >= 4 AND stddev_pop({a}) >= 1e-12 AND stddev_pop({b}) >= 1e-12" for a, b in (("qty", "price"), ("disc", "tax"))) + ")"


@query(f"SELECT avg(abs(a.r - b.r)) AS temporal_corr_drift FROM (SELECT pair, median(r) AS r FROM {_xcorr(REAL)} GROUP BY pair) a JOIN (SELECT pair, median(r) AS r FROM {_xcorr(SYNTH)} GROUP BY pair) b ON a.pair = b.pair", "temporal_corr_drift", digits=7)
def pair_corr_drift(t):
    return trajectory.temporal_corr_drift(*real_synth(t), "id", [("qty", "price"), ("disc", "tax")])


# --- neighbours and privacy ------------------------------------------------------------------------------


def _parts(t) -> tuple[DataFrame, DataFrame]:
    p = t("part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"))
    side = S.hash_rank(0, F.col("id")) % 2
    return p.where(side == 0), p.where(side == 1).withColumn("price", F.col("price") * 1.01)


_PART = f"(SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS price, p_brand AS brand, p_type AS kind, {SIDE.format('p_partkey')} AS side FROM part)"
_PR = f"(SELECT id, size, price, brand, kind FROM {_PART} WHERE side = 0)"
_PS = f"(SELECT id, size, price * 1.01::DOUBLE AS price, brand, kind FROM {_PART} WHERE side = 1)"
_ST = f"(SELECT min(size) AS sl, max(size) AS sh, min(price) AS pl, max(price) AS ph FROM {_PR})"


def _enc(table: str) -> str:
    return f"(SELECT id, (size - sl) / (sh - sl) AS size, (price - pl) / (ph - pl) AS price, brand, kind FROM {table}, {_ST})"


def _near(q: str, r: str) -> str:
    return f"(SELECT q.id, sqrt(min((q.price - r.price) * (q.price - r.price) + (q.size - r.size) * (q.size - r.size) + 2 * (q.brand <> r.brand)::INT + 2 * (q.kind <> r.kind)::INT)) AS d FROM {_enc(q)} q CROSS JOIN {_enc(r)} r GROUP BY q.id)"


_DIST2 = f"(SELECT q.id, sqrt((q.price - r.price) * (q.price - r.price) + (q.size - r.size) * (q.size - r.size) + 2 * (q.brand <> r.brand)::INT + 2 * (q.kind <> r.kind)::INT) AS d, row_number() OVER (PARTITION BY q.id ORDER BY (q.price - r.price) * (q.price - r.price) + (q.size - r.size) * (q.size - r.size) + 2 * (q.brand <> r.brand)::INT + 2 * (q.kind <> r.kind)::INT) AS k FROM {_enc(_PS)} q CROSS JOIN {_enc(_PR)} r QUALIFY k <= 2)"


@query(f"SELECT id, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM {_DIST2} GROUP BY id", "d1 d2", "id")
def nearest_two(t):
    real, synth = _parts(t)
    enc = privacy.DistanceEncoder.fit(real, [synth], ["id"])
    return enc.nearest(synth, real, 2, "id").select("id", F.get("d", 0).alias("d1"), F.get("d", 1).alias("d2"))


@query(f"SELECT avg(d1) AS dcr_mean, median(d1) AS dcr_median, quantile_cont(d1, 0.05) AS dcr_p05, quantile_cont(d1, 0.95) AS dcr_p95, avg((d1 <= 1e-12)::INT) AS exact_match_rate, median(d1 / greatest(d2, 1e-12)) AS nndr_median FROM (SELECT id, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2 FROM {_DIST2} GROUP BY id)", "dcr_mean dcr_median dcr_p05 dcr_p95 exact_match_rate nndr_median")
def closest_record(t):
    return privacy.distance_to_closest_record(*_parts(t), "id")


@query(f"SELECT avg((EXISTS (SELECT 1 FROM {_PR} r WHERE r.size = s.size AND r.brand = s.brand AND r.kind = s.kind))::INT) AS exact_match_rate FROM {_PS} s", "exact_match_rate")
def exact_matches(t):
    real, synth = _parts(t)
    return privacy.exact_match_rate(real.drop("price"), synth.drop("price"), "id")


_HALF = f"('0x' || substr(md5('9:' || id), 1, 13))::BIGINT % 2"
_TRAIN, _HOLD = f"(SELECT * FROM {_PR} WHERE {_HALF} = 0)", f"(SELECT * FROM {_PR} WHERE {_HALF} = 1)"


def _enc_t(table: str) -> str:
    st = f"(SELECT min(size) AS sl, max(size) AS sh, min(price) AS pl, max(price) AS ph FROM {_TRAIN})"
    return f"(SELECT id, (size - sl) / (sh - sl) AS size, (price - pl) / (ph - pl) AS price, brand, kind FROM {table}, {st})"


def _near_t(q: str, r: str) -> str:
    return _near(q, r).replace(_enc(q), _enc_t(q)).replace(_enc(r), _enc_t(r))


@query(f"SELECT least(greatest((1 - avg((t.d < h.d)::INT)) * 2, 0), 1) AS dcr_overfitting_protection, avg((t.d < h.d)::INT) AS dcr_closer_to_training, median(t.d) AS median_train, median(h.d) AS median_holdout FROM {_near_t(_PS, _TRAIN)} t JOIN {_near_t(_PS, _HOLD)} h ON t.id = h.id", "dcr_overfitting_protection dcr_closer_to_training median_train median_holdout")
def overfitting_protection(t):
    real, synth = _parts(t)
    half = S.hash_rank(9, F.col("id")) % 2
    return privacy.dcr_overfitting_protection(real.where(half == 0), real.where(half == 1), synth, "id")


_HASH0 = "('0x' || substr(md5('0:' || id), 1, 13))::BIGINT"
_RANKED_HOLD = f"(SELECT *, row_number() OVER (ORDER BY {_HASH0}, id) AS r, count(*) OVER () AS n FROM {_HOLD})"
_OUTSIDE, _REFERENCE = f"(SELECT * FROM {_RANKED_HOLD} WHERE r <= ceil(n * 0.5::DOUBLE))", f"(SELECT * FROM {_RANKED_HOLD} WHERE r > ceil(n * 0.5::DOUBLE))"
_N_EACH = f"(SELECT least(greatest(1, (SELECT count(*) FROM {_TRAIN}) // 2), (SELECT count(*) FROM {_OUTSIDE})))"
_first_n = lambda table: f"SELECT id, size, price, brand, kind FROM (SELECT *, row_number() OVER (ORDER BY {_HASH0}, id) AS place FROM {table}) WHERE place <= {_N_EACH}"
_CANDIDATES = f"(SELECT *, 1 AS member FROM ({_first_n(_TRAIN)}) UNION ALL SELECT *, 0 FROM ({_first_n(_OUTSIDE)}))"
_KNOWN = f"(SELECT id, size, price, brand, kind FROM {_PS} UNION ALL SELECT id, size, price, brand, kind FROM {_TRAIN})"
_ATTACK = f"(SELECT member, ln((r.d + 1e-12::DOUBLE) / (s.d + 1e-12::DOUBLE)) AS score FROM {_CANDIDATES} c JOIN {_near_t(_CANDIDATES, _REFERENCE)} r ON c.id = r.id JOIN {_near_t(_CANDIDATES, _KNOWN)} s ON c.id = s.id)"
_ATTACK_BY = "(SELECT score AS s, sum(member) AS p, sum(1 - member) AS n FROM attack GROUP BY score)"


@query(
    f"WITH attack AS MATERIALIZED (SELECT * FROM {_ATTACK}), ranks AS (SELECT s, p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY s DESC)::DOUBLE AS fp FROM {_ATTACK_BY}) "
    "SELECT (SELECT sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) FROM ranks) AS mia_roc_auc, (SELECT sum(p * tp / (tp + fp)) / sum(p) FROM ranks) AS mia_average_precision, "
    "avg((score > 0)::INT) FILTER (member = 1) - avg((score > 0)::INT) FILTER (member = 0) AS mia_attacker_advantage, avg(score) FILTER (member = 1) AS member_mean, avg(score) FILTER (member = 0) AS nonmember_mean FROM attack",
    "mia_roc_auc mia_average_precision mia_attacker_advantage member_mean nonmember_mean", digits=5,
)
def membership_attack(t):
    real, synth = _parts(t)
    half = S.hash_rank(9, F.col("id")) % 2
    return privacy.membership_inference(real.where(half == 0), real.where(half == 1), synth.unionByName(real.where(half == 0)), "id")


_u0 = lambda c: f"(('0x' || substr(md5('0:' || id || ':{c}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_DRAWN = (
    f"(SELECT id, sl + {_u0('size')} * (sh - sl) AS size, pl + {_u0('price')} * (ph - pl) AS price, brands[floor({_u0('brand')} * len(brands))::INT + 1] AS brand, kinds[floor({_u0('kind')} * len(kinds))::INT + 1] AS kind "
    f"FROM (SELECT unnest(range(0, (SELECT count(*) FROM {_PS}))) AS id), {_ST}, (SELECT list_sort(list(DISTINCT brand)) AS brands, list_sort(list(DISTINCT kind)) AS kinds FROM {_PR}))"
)


@query(f"SELECT a AS synth_median, b AS random_median, least(1.0::DOUBLE, a / b) AS dcr_baseline_protection FROM (SELECT median(d) AS a FROM {_near(_PS, _PR)}), (SELECT median(d) AS b FROM {_near(_DRAWN, _PR)})", "synth_median random_median dcr_baseline_protection", digits=6)
def baseline_protection(t):
    return privacy.dcr_baseline_protection(*_parts(t), "id")


# --- scores, labels, utility -------------------------------------------------------------------------------

_SCORED = "(SELECT l.doc_id, l.quality AS y, floor(ln(d.n_chars + 1) * 4) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _scored(t) -> DataFrame:
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.floor(F.ln(F.col("n_chars") + 1) * 4).alias("s"))


_BY = f"(SELECT s, sum(y) AS p, sum(1 - y) AS n FROM {_SCORED} GROUP BY s)"


@query(f"SELECT 'all' AS \"by\", sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)) AS roc_auc, sum(p * tp / (tp + fp)) / sum(p) AS average_precision FROM (SELECT s, p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC)::DOUBLE AS tp, sum(n) OVER (ORDER BY s DESC)::DOUBLE AS fp FROM {_BY})", "roc_auc average_precision", "by n_pos n_neg")
def rank_metrics(t):
    return rank.rank_metrics(_scored(t), "y", "s")


_PRED = f"(SELECT y, (s >= 28)::INT AS p FROM {_SCORED})"
_PER = f"(SELECT k, sum((y = k AND p = k)::INT) AS tp, sum((y = k)::INT) AS re, sum((p = k)::INT) AS sa FROM {_PRED}, (VALUES (0), (1)) v(k) GROUP BY k)"


@query(f"SELECT sum(tp) / sum(re)::DOUBLE AS accuracy, avg(tp / re::DOUBLE) AS balanced_accuracy, max(CASE WHEN k = 1 THEN 2.0 * tp / (re + sa) END) AS f1, avg(2.0::DOUBLE * tp / (re + sa)) AS macro_f1, sum(2.0::DOUBLE * tp / (re + sa) * re) / sum(re) AS weighted_f1 FROM {_PER}", "accuracy balanced_accuracy f1 macro_f1 weighted_f1")
def confusion_metrics(t):
    return rank.classification_metrics(_scored(t).withColumn("p", (F.col("s") >= 28).cast("int")), "y", "p")


@query(f"SELECT id, CASE WHEN d < 2 THEN 0 WHEN d < 7 THEN 1 ELSE 2 END AS label FROM (SELECT user_id AS id, max(step) * 6 / 24.0 AS d FROM {EAV} GROUP BY user_id)")
def los_labels(t):
    return utility.los_label(eav(t).select(F.col("user_id").alias("id"), (F.col("step") * 6).alias("hour")), "id", "hour")


@query(f"SELECT user_id, min_by((value > 100)::INT, step * 1000000 + event_id) FILTER (event_type = 'view') AS label FROM (SELECT *, date_diff('day', DATE '2024-01-01', ts::DATE) AS step FROM events) GROUP BY user_id HAVING count(*) FILTER (event_type = 'view') > 0")
def first_labels(t):
    e = t("events").select("user_id", (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 1000000 + F.col("event_id")).alias("at"), F.when(F.col("event_type") == "view", (F.col("value") > 100).cast("double")).alias("hospital_expire_flag"))
    return utility.mortality_label(e, "user_id", "at")


def _utility_tables(t) -> tuple[DataFrame, DataFrame, utility.Task]:
    real, synth = real_synth(t)
    return synth.drop("t"), real.drop("t"), utility.ColumnTask("high_price", (F.col("price") > 50000).cast("int"), ["price"])


@query(None)
def row_utility(t):
    synth, real, task = _utility_tables(t)
    key = F.xxhash64("id", "qty", "price", "disc", "tax")
    return task.evaluate(synth.withColumn("row", key), real.withColumn("row", key), ["id", "row"])


@query(None)
def sequence_utility(t):
    real, synth = real_synth(t)
    label = lambda d: d.groupBy("id").agg((F.max("price") > 90000).cast("int").alias("label"))
    return utility.evaluate_sequence_task("order_price", synth, real, label, "id", "t", ["price"])


# --- result tables ---------------------------------------------------------------------------------------------

_SEEDS = "(SELECT o_orderpriority AS cell, o_orderstatus AS metric, (o_orderkey % 4)::INT AS seed, avg(o_totalprice) AS value FROM orders GROUP BY ALL)"


def _seeds(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderpriority").alias("cell"), F.col("o_orderstatus").alias("metric"), (F.col("o_orderkey") % 4).cast("int").alias("seed")).agg(F.avg("o_totalprice").alias("value"))


def _ci(q: str) -> str:
    return f"SELECT cell, metric, count(*) AS n, avg(value) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(value) END AS std, CASE WHEN count(*) > 1 THEN {q} * stddev_samp(value) / sqrt(count(*)) END AS ci95 FROM {_SEEDS} GROUP BY cell, metric"


_T = "[12.706205, 4.302653, 3.182446][count(*) - 1]"


@query(_ci(_T), "mean std ci95", "cell metric n", 4)
def seed_ci_t(t):
    return results.seed_statistics(_seeds(t), ["cell", "metric"], "value")


@query(_ci("1.96"), "mean std ci95", "cell metric n", 4)
def seed_ci_z(t):
    return results.seed_statistics(_seeds(t), ["cell", "metric"], "value", normal=True)


@query("SELECT nt, n_noise FROM (SELECT unnest([1, 2, 3]) AS nt) CROSS JOIN (SELECT unnest([1, 2, 5, 8]) AS n_noise) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 4 + 1 = nt AND o_orderkey % 5 + 1 = n_noise AND o_totalprice > 490000)")
def grid_resume(t):
    o = t("orders").select((F.col("o_orderkey") % 4 + 1).cast("int").alias("nt"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("n_noise"), F.when(F.col("o_totalprice") > 490000, "").otherwise("failed").alias("error"))
    return results.remaining(results.grid(o.sparkSession, [1, 2, 3], [1, 2, 5, 8]), o)


@query("SELECT p_brand, p_type, avg(p_retailprice) AS price FROM part GROUP BY p_brand, p_type ORDER BY round(avg(p_retailprice), 6) DESC, p_brand DESC, p_type DESC LIMIT 1", "price", "p_brand p_type", 6)
def best_config(t):
    rows = t("part").groupBy("p_brand", "p_type").agg(F.round(F.avg("p_retailprice"), 6).alias("price"))
    return results.best_row(rows.select("price", "p_brand", "p_type"), "price")


@query(f"SELECT count(*) - 1 AS n_overlapping FROM ({_ci('1.96')}) a, (SELECT mean AS m, ci95 AS c FROM ({_ci('1.96')}) ORDER BY mean DESC LIMIT 1) b WHERE mean - ci95 <= m + c AND mean + ci95 >= m - c")
def ci_overlap(t):
    return results.ci_overlaps(results.seed_statistics(_seeds(t), ["cell", "metric"], "value", normal=True), "mean", "ci95")


@query("SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus = 'O') AS gap FROM orders GROUP BY o_orderpriority", "gap", "o_orderpriority", 4)
def gap_pivot(t):
    means = t("orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    wide_ = results.pivot_grid(means, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], F.col("v"))
    return wide_.select("o_orderpriority", (F.col("F") - F.col("O")).alias("gap"))


_MC = f"SELECT metric, mean AS m, ci95 AS c FROM ({_ci('1.96')}) WHERE cell = "


@query(f"SELECT a.metric, a.m AS mean_a, b.m AS mean_b, b.m - a.m AS delta, sqrt(a.c * a.c + b.c * b.c) AS joint_ci95, abs(b.m - a.m) > sqrt(a.c * a.c + b.c * b.c) AS significant, CASE WHEN abs(b.m - a.m) <= sqrt(a.c * a.c + b.c * b.c) THEN 'unclear' WHEN b.m > a.m THEN 'b' ELSE 'a' END AS larger FROM ({_MC} '1-URGENT') a JOIN ({_MC} '5-LOW') b ON a.metric = b.metric", "mean_a mean_b delta joint_ci95", "metric significant larger", 4)
def model_compare(t):
    s = results.seed_statistics(_seeds(t), ["cell", "metric"], "value", normal=True)
    return results.compare_models(s.where("cell = '1-URGENT'"), s.where("cell = '5-LOW'"))


@query("SELECT o_orderstatus AS metric, CASE WHEN o_orderstatus = 'F' THEN arg_min(o_orderpriority, v) ELSE arg_max(o_orderpriority, v) END AS best FROM (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def best_models(t):
    rows = t("orders").groupBy(F.col("o_orderstatus").alias("metric"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("value"))
    return results.best_models(rows, {"F": False, "O": True, "P": True})


@query("SELECT regr_slope(l_extendedprice, ln(l_quantity)) AS slope, regr_intercept(l_extendedprice, ln(l_quantity)) AS intercept FROM lineitem", "slope intercept", digits=3)
def log_fit(t):
    return results.log_trend(t("lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT o_orderpriority, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderpriority", "o_totalprice", "o_orderpriority", 4)
def marginal_means(t):
    return results.marginal_means(t("orders"), "o_orderpriority", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def latest_result(t):
    return results.latest_row(t("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey::INT AS nt, NULL::DOUBLE AS extra, o_totalprice AS price FROM orders")
def schema_migration(t):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("nt", T.IntegerType()), T.StructField("extra", T.DoubleType()), T.StructField("price", T.DoubleType())])
    return io.migrate_schema(t("orders").select(F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("nt"), "o_orderstatus"), schema)


@query("SELECT user_id AS entity_id, 't' || event_id AS time, event_type AS parameter, value FROM events")
def eav_ids(t):
    e = t("events").select(F.concat(F.lit("f"), "user_id").alias("file"), F.concat(F.lit("t"), "event_id").alias("Time"), F.col("event_type").alias("Parameter"), F.col("value").cast("string").alias("Value"))
    ids = t("events").select("user_id").distinct().select(F.concat(F.lit("f"), "user_id").alias("file"), F.lit("00:00").alias("Time"), F.lit("RecordID").alias("Parameter"), F.col("user_id").cast("string").alias("Value"))
    return io.eav_with_ids(e.unionByName(ids), "RecordID")


# --- generation -----------------------------------------------------------------------------------------------


@query("SELECT (o_orderkey % 50) AS subject_id, floor(o_orderkey / 50)::INT AS hours_in, o_totalprice AS price, coalesce(lag(o_totalprice) OVER (PARTITION BY o_orderkey % 50 ORDER BY o_orderkey), -1.0::DOUBLE) AS price_lag1 FROM orders")
def uncond_relag(t):
    return rollout.unconditional_to_trajectories(t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), 50, ["price"])


def _noise(d: int) -> str:
    u, v = (f"('0x' || substr(md5('0:' || id || ':' || noise || ':{d}:{x}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE" for x in "uv")
    return f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u})) * cos(2.0::DOUBLE * pi() * {v})"


_PAIRS_SQL = f"SELECT id, noise, level, (level + 1) / 3.0::DOUBLE AS t, a, b, {_noise(0)} AS za, {_noise(1)} AS zb FROM (SELECT c_custkey AS id, c_acctbal / 1000 AS a, c_nationkey::DOUBLE AS b FROM customer), (SELECT unnest(range(0, 2))::INT AS noise), (SELECT unnest(range(0, 3))::INT AS level)"


@query(f"SELECT id, noise, level, t, (1 - t) * za + t * a AS x0, (1 - t) * zb + t * b AS x1, a - za AS y0, b - zb AS y1 FROM ({_PAIRS_SQL})", "t x0 x1 y0 y1", "id noise level", 6)
def flow_pairs(t):
    """Training pairs at three times for two noise copies of each customer."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.array((F.col("c_acctbal") / 1000), F.col("c_nationkey").cast("double")).alias("x_target"), F.array(F.lit(1.0)).alias("x_cond"))
    return flow.expand_pairs(rows, 2, 3, 2).select("id", "noise", "level", "t", *[F.get(c, i).alias(f"{n}{i}") for c, n in (("x_t", "x"), ("y", "y")) for i in (0, 1)])


@query(None)
def joint_rollout(t):
    """A joint flow fitted on order lines, rolled out for every customer."""
    table, targets, cond = lag.prepare_autoregressive_data(lines(t).select("id", "t", "qty", "disc"), "id", "t")
    rows = table.select(F.xxhash64("id", "t").alias("id"), F.array(*targets).alias("x_target"), F.array(*cond).alias("x_cond"))
    model = flow.JointFlow().fit(rows)
    subjects = t("customer").select(F.col("c_custkey").alias("id"), F.array().cast("array<double>").alias("x_static"))
    return rollout.rollout(model, subjects).select("id", "step", F.get("x", 0).alias("qty"), F.get("x", 1).alias("disc"))


@query("SELECT c_custkey AS id, c_acctbal AS bal_lag1, -1.0::DOUBLE AS other_lag1, c_nationkey::DOUBLE AS nation FROM customer")
def initial_conditions(t):
    df = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))
    return rollout.hour0_to_conditions(df, ["bal", "other"], ["bal_lag1", "other_lag1", "nation"])


@query(
    "SELECT q.vec_id AS id, sqrt(min(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE))))) AS d FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id",
    "d", "id", 6,
)
def nearest_vectors(t):
    """Every 20th vector as a query against all others, on all 64 dimensions: the nearest but itself."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", i).cast("double").alias(f"e{i}") for i in range(64)])
    found = knn.nearest(v.where("id % 20 = 0"), v, [f"e{i}" for i in range(64)], k=2)
    other = F.filter(F.arrays_zip("d", "near"), lambda x: x["near"] != F.col("id"))
    return found.select("id", F.get(other, 0)["d"].alias("d"))
