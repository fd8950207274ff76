"""Registered queries of fitted generators and models. What is drawn or fitted has no SQL; what must hold of it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import flow, rollout
from . import utility
from .queries import REAL, lines, query, real_synth

SETTINGS = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3, "seed": 0}


# --- generators ---------------------------------------------------------------------------------


def _steps(t) -> DataFrame:
    """Lines of orders with the line before (-1 at first) and whether they are the last."""
    w = W.partitionBy("id").orderBy("t")
    rows = lines(t).select("id", "t", (F.col("qty") / 50).alias("qty"), (F.col("disc") * 10).alias("disc"), F.when(F.lead("t").over(w).isNull(), 1.0).otherwise(0.0).alias("last"))
    return rows.select("id", "t", F.array("qty", "disc", "last").alias("x_target"), F.array(*[F.coalesce(F.lag(c).over(w), F.lit(rollout.START)) for c in ("qty", "disc", "last")]).alias("x_cond"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'random' WHEN 1 THEN 'zero' ELSE 'given' END AS start, true AS first_holds, true AS in_order, true AS ends_once FROM orders")
def stopped_trajectories(t):
    """A trajectory of up to 12 lines for every order, until the column "last" says so; a third each begins drawn, at zero and at a given state.

    Held against SQL is what must be true of each: it begins as asked, its steps follow one another, and its last step, and no other, ends it.
    """
    model = flow.JointFlow(nt=2, n_noise=1, settings=SETTINGS).fit(_steps(t).select(F.xxhash64("id", "t").alias("id"), "x_target", "x_cond"))
    start = F.when(F.col("o_orderkey") % 3 == 0, "random").when(F.col("o_orderkey") % 3 == 1, "zero").otherwise("given")
    given = F.array(F.col("o_totalprice") / 500_000, F.lit(0.5), F.lit(0.25))
    orders, out = t("orders").select(F.col("o_orderkey").alias("id"), start.alias("start"), F.array().cast("array<double>").alias("x_static"), given.alias("first")), None
    for kind in ("random", "zero", "given"):
        own = rollout.sample_trajectories(model, orders.where(F.col("start") == kind), 12, kind, 0, 2, 0.5)
        out = own if out is None else out.unionByName(own)
    stops = F.get("x", 2) > 0.5
    sums = out.groupBy("id").agg(F.count("*").alias("n"), F.max("step").alias("top"), F.countDistinct("step").alias("steps"), F.min_by("x", "step").alias("begins"), F.sum(F.when(stops, 1).otherwise(0)).alias("ends"), F.max_by(stops, "step").alias("over"), F.max_by("last", "step").alias("marked"), F.sum(F.when(F.col("last"), 1).otherwise(0)).alias("marks"))
    holds = F.when(F.col("start") == "zero", F.col("begins") == F.array(*[F.lit(0.0)] * 3)).when(F.col("start") == "given", F.col("begins") == F.col("first")).otherwise(F.size("begins") == 3)
    once = F.when(F.col("over"), F.col("ends") == 1).otherwise((F.col("ends") == 0) & (F.col("n") == 12)) & F.col("marked") & (F.col("marks") == 1)
    return orders.join(sums, "id").select("id", "start", holds.alias("first_holds"), ((F.col("n") == F.col("top") + 1) & (F.col("n") == F.col("steps"))).alias("in_order"), once.alias("ends_once"))


@query("SELECT o_orderkey AS id, true AS known, true AS finite FROM orders")
def sequential_draws(t):
    """A line for every order, a dimension at a time: quantity, discount, then one of the return flags that occur, given the two."""
    flag = F.when(F.col("flag") == "A", 0.0).when(F.col("flag") == "N", 1.0).otherwise(2.0)
    rows = lines(t).select(F.xxhash64("id", "t").alias("id"), F.array(F.col("qty") / 50, F.col("disc") * 10, flag).alias("x_target"), F.array(F.col("tax") * 10).alias("x_cond"))
    model = flow.SequentialFlow(categorical=(2,), nt=2, n_noise=1, settings=SETTINGS).fit(rows)
    drawn = rollout.sample(model, t("orders").select(F.col("o_orderkey").alias("id"), F.array(F.col("o_totalprice") / 500_000).alias("x_cond")))
    seen = lines(t).groupBy(flag.alias("code")).count()
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e6))
    return drawn.join(F.broadcast(seen), F.get("x", 2) == F.col("code"), "left").select("id", F.col("code").isNotNull().alias("known"), finite.alias("finite"))  # a row a class


# --- models --------------------------------------------------------------------------------------

_LABEL = "(CASE WHEN qty + 25 * (id % 2) > 38 THEN 1 ELSE 0 END)"
_X = f"(SELECT (disc - (SELECT avg(disc) FROM {REAL})) / (SELECT stddev_pop(disc) FROM {REAL}) AS a, (price - (SELECT avg(price) FROM {REAL})) / (SELECT stddev_pop(price) FROM {REAL}) AS b, {_LABEL} AS y FROM {REAL})"


def _label():
    return F.when(F.col("qty") + 25 * (F.col("id") % 2) > 38, 1).otherwise(0)


def _weighted(t, names) -> DataFrame:
    rows = real_synth(t)[0].withColumn("label", _label())
    plan = utility.FeaturePlan.fit(rows.select(*names))
    plan.numeric = list(names)
    return plan.features(rows, "label")


@query(
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT *, (SELECT count(*) FROM {_X})::DOUBLE / (2 * count(*) OVER (PARTITION BY y)) AS w FROM {_X}),
s AS (SELECT 0 AS i, 0.0::DOUBLE AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 UNION ALL
SELECT i + 1, c0 - (g0 * (h11 * h22 - h12 * h12) + g1 * (h02 * h12 - h01 * h22) + g2 * (h01 * h12 - h02 * h11)) / det, c1 - (g0 * (h02 * h12 - h01 * h22) + g1 * (h00 * h22 - h02 * h02) + g2 * (h01 * h02 - h00 * h12)) / det,
  c2 - (g0 * (h01 * h12 - h02 * h11) + g1 * (h01 * h02 - h00 * h12) + g2 * (h00 * h11 - h01 * h01)) / det FROM (
  SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h02 * h12) + h02 * (h01 * h12 - h02 * h11) AS det FROM (
    SELECT i, c0, c1, c2, sum(w * (p - y)) AS g0, sum(w * (p - y) * a) + c1 AS g1, sum(w * (p - y) * b) + c2 AS g2,
      sum(w * p * (1 - p)) AS h00, sum(w * p * (1 - p) * a) AS h01, sum(w * p * (1 - p) * b) AS h02, sum(w * p * (1 - p) * a * a) + 1 AS h11, sum(w * p * (1 - p) * a * b) AS h12, sum(w * p * (1 - p) * b * b) + 1 AS h22
    FROM (SELECT s.*, d.*, 1 / (1 + exp(-(c0 + c1 * a + c2 * b))) AS p FROM s, d WHERE i < 12) GROUP BY i, c0, c1, c2)))
SELECT unnest(['intercept', 'disc', 'price']) AS feature, unnest([c0, c1, c2]) AS weight FROM s WHERE i = 12""",
    "weight", "feature", 3,
)
def classifier_weights(t):
    """Weights of the balanced logistic regression on two standardised columns, against Newton's steps in SQL."""
    model = utility.fit_classifier(_weighted(t, ["disc", "price"]), tol=1e-10)
    values = [float(model.intercept), *map(float, model.coefficients.toArray())]
    return t("lineitem").limit(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("weight")) for n, v in zip(("intercept", "disc", "price"), values, strict=True)])).alias("r")).select("r.*")


@query("SELECT unnest(['intercept', 'disc', 'price', 'tax']) AS feature, true AS optimal")
def sparse_ranking(t):
    """Whether the L1 model that ranks features meets its optimality conditions in each: its gradient against the bound."""
    names, data = utility.first_row_features(real_synth(t)[0].drop("flag", "status"), _label(), "id", "t", ["qty"])
    model = utility.fit_classifier(data, c=0.5, l1=True, tol=1e-10)
    return utility.optimality(model, data, 0.5, True, 1e-4).select(F.get(F.lit(["intercept", *names]), F.col("feature") + 1).alias("feature"), "optimal")


@query("SELECT features, seed, true AS scored FROM (SELECT unnest(['all', 'top1', 'top2']) AS features), (SELECT unnest([0, 1])::INT AS seed)")
def ablation_table(t):
    """A task scored with all features and with the first one and two, two seeds each: every score is there and within its range."""
    real, synth = (d.drop("qty") for d in (d.withColumn("y", _label()) for d in real_synth(t)))
    task = utility.ColumnTask("y", F.col("y"), ["y"])
    out = utility.feature_ablation(synth, real, task, ["price", "disc"], [1, 2], ["id", "t"], [0, 1])
    within = lambda c: F.col(c).between(0, 1)
    return out.select("features", "seed", F.coalesce(within("accuracy") & within("f1") & within("roc_auc"), F.lit(False)).alias("scored"))


@query("SELECT unnest(['y', 'y', 'z', 'z']) AS task, unnest(['real', 'synth', 'real', 'synth']) AS side, true AS scored")
def several_tasks(t):
    """Two tasks on one pair of tables, each trained on either side."""
    real, synth = (d.withColumn("y", _label()).withColumn("z", (F.col("price") > 40_000).cast("int")) for d in real_synth(t))
    tasks = [utility.ColumnTask("y", F.col("y"), ["y", "qty"]), utility.ColumnTask("z", F.col("z"), ["z", "price"])]
    out = utility.evaluate_multi_task(synth, real, tasks, ["id", "t"])
    return out.select("task", "side", F.coalesce(F.col("roc_auc").between(0, 1) & F.col("accuracy").between(0, 1), F.lit(False)).alias("scored"))
