"""Models (M1-M5) and the workflows that train or seal predictions (E2, E12, E13, E17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import (
    ALPHA, BUDGET, guarded, ledger, query, table, with_guarded,
)
from railguard.catalog.evaluation import CROSSING_SQL, rounded, with_metrics
from railguard.operators import contracts, decisions, joins, metrics, ordering
from railguard.operators.flow import eligibility
from railguard.operators.guard import causal_state, guard
from railguard.operators.layout import Keys, Trajectories
from railguard.plans import models
from railguard.session import durable
from railguard.sources import sinks


def feature_table(spark, d):
    """Supplier-level ledger columns as features; quantity is missing in some rows."""
    f = table(spark, d, "lineitem")
    return f.select(
        F.col("l_returnflag").alias("domain"),
        F.concat_ws(":", "l_returnflag", F.col("l_suppkey").cast("string")).alias("unit"),
        F.col("l_orderkey").cast("double").alias("order_key"),
        "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        (1.0 - F.col("l_quantity") / 500.0 - F.col("l_discount")).alias("truth"),
    )


FEATURES = ["order_key", "quantity", "price", "discount"]


@query(
    "M1_median_imputation",
    """WITH m AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM lineitem WHERE l_linenumber <> 3 AND l_returnflag <> 'R')
 SELECT l_orderkey::DOUBLE AS order_key, l_linenumber, l_partkey, CASE WHEN l_linenumber <> 3 THEN l_quantity ELSE (SELECT q FROM m) END AS quantity,
   (l_linenumber = 3)::INT::DOUBLE AS missing FROM lineitem""",
)
def m1(spark, d):
    f = models.add_indicators(feature_table(spark, d), ["quantity"])
    filled = models.impute_median(f.filter("domain <> 'R'"), ["quantity"])
    return filled.transform(f).select(
        "order_key", "l_linenumber", "l_partkey", F.col("imputed__quantity").alias("quantity"),
        F.col("missing__quantity").alias("missing"),
    )


def _held_out(spark, d, kind, **kw):
    pipeline = models.build_pipeline(FEATURES, "truth", kind=kind, log_column="order_key", **kw)
    f = feature_table(spark, d)
    model = pipeline.fit(f.filter("domain <> 'R'"))
    scored = models.predict(model, f.filter("domain = 'R'"))
    return scored.groupBy("domain", "unit").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.avg(F.abs(F.col("prediction") - F.col("truth"))), 6).alias("mae"),
    )


@query("M2_forest_regression", None)
def m2(spark, d):
    f = feature_table(spark, d)
    weighted = metrics.row_weights(f, scale="mean_one").filter("domain <> 'R'")
    pipeline = models.build_pipeline(
        FEATURES, "truth", kind="forest", log_column="order_key", weight="weight"
    )
    # Three passes read the weighted records; the join behind them runs once.
    model = pipeline.fit(durable(weighted.select(*FEATURES, "truth", "weight")))
    scored = models.predict(model, f.filter("domain = 'R'"))
    return scored.groupBy("domain", "unit").agg(
        F.count(F.lit(1)).alias("records"),
        F.round(F.avg(F.abs(F.col("prediction") - F.col("truth"))), 6).alias("mae"),
    )


@query("M3_boosting", None)
def m3_boosting(spark, d):
    return _held_out(spark, d, "boosting")


@query("M3_ridge", None)
def m3(spark, d):
    return _held_out(spark, d, "ridge", scale=True)


@query(
    "M4_frozen_bundle",
    "SELECT l_returnflag AS domain, count(*) AS records, 0e0 AS maximum_difference FROM lineitem GROUP BY 1",
)
def m4(spark, d):
    """Fit, save, load and predict: the loaded bundle must agree with the fitted one."""
    from pyspark.ml import PipelineModel

    from railguard.session import scratch_path

    pipeline = models.build_pipeline(FEATURES, "truth", kind="ridge", log_column="order_key")
    f = feature_table(spark, d)
    model = pipeline.fit(f.filter("domain <> 'R'"))
    path = scratch_path(spark, "bundle")
    model.write().save(path)
    again = models.predict(PipelineModel.load(path), models.predict(model, f, "first"), "second")
    return again.groupBy("domain").agg(
        F.count(F.lit(1)).alias("records"),
        F.max(F.abs(F.col("first") - F.col("second"))).alias("maximum_difference"),
    )


@query(
    "M5_feature_scaling",
    """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem WHERE l_returnflag <> 'R')
 SELECT l_orderkey::DOUBLE AS order_key, l_linenumber, l_partkey, round((l_extendedprice - m) / sd, 8) + 0e0 AS scaled FROM lineitem, s""",
)
def m5(spark, d):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    f = VectorAssembler(inputCols=["price"], outputCol="v").transform(feature_table(spark, d))
    model = StandardScaler(withMean=True, inputCol="v", outputCol="s").fit(f.filter("domain <> 'R'"))
    value = F.round(vector_to_array("s")[0], 8) + F.lit(0.0)
    return model.transform(f).select("order_key", "l_linenumber", "l_partkey", value.alias("scaled"))


@query("E2_leave_one_domain_out", None)
def e2(spark, d):
    f = feature_table(spark, d)
    # Domains are declared data sets, a short list; which ones there are is read from the data.
    names = sorted(r["domain"] for r in f.select("domain").distinct().collect())
    both = models.leave_one_domain_out(f, names, {
        "price_only": models.build_pipeline(["price", "discount"], "truth", kind="ridge"),
        "full": models.build_pipeline(FEATURES, "truth", kind="ridge", log_column="order_key"),
    })
    units = metrics.unit_errors(both, ["price_only", "full"])
    domains = units.groupBy("domain", "method").agg(F.avg("mae").alias("unit_macro_mae"))
    return domains.withColumn("unit_macro_mae", F.round("unit_macro_mae", 6))


# --- sealed predictions, then labels ----------------------------------------------------


def sealed_predictions(spark, d):
    """Guard and smoothed comparator on label-blind input, sealed; opened only if unchanged."""
    from railguard.session import scratch_path

    blind = contracts.label_blind(ledger(spark, d).drop("truth"), ["truth"])
    t = ordering.with_rank(Trajectories.plan(blind))
    t = guard(t, alpha=ALPHA, budget=BUDGET)
    t = causal_state(t, "raw_candidate", "smoothed", alpha=0.05)
    path = scratch_path(spark, "sealed")
    sinks.seal(t.frame.drop(*[c for c in t.part if c not in t.keys.group]), path)
    return sinks.open_sealed(spark, path)


def _scored(spark, d):
    """Labels released after sealing, eligible units only, records after commissioning."""
    sealed = sealed_predictions(spark, d)
    labels = ledger(spark, d).select("domain", "unit", "ordinal", "truth")
    joined = joins.label_join(sealed, labels, ["domain", "unit", "ordinal"], "truth")
    units = eligibility(ledger(spark, d), Keys(), "truth", (0.85, 1.1), 6)
    return joins.keep_units(joined, units.filter("reason IS NULL"), ["domain", "unit"]).filter("rank > 5")


_SEAL = f""", u AS (SELECT domain, unit, count(*) AS n, count(*) FILTER (rn <= 5) AS anchors, quantile_cont(truth, 0.5) FILTER (rn <= 5) AS reference FROM led GROUP BY ALL),
 ok AS (SELECT domain, unit FROM u WHERE anchors >= 5 AND reference BETWEEN 0.85e0 AND 1.1e0 AND n - 5 >= 6),
 sc AS (SELECT gd.*, sm.b AS smoothed FROM gd JOIN sm USING (domain, unit, rn) SEMI JOIN ok USING (domain, unit) WHERE truth > 0 AND rn > 5),
 su AS (SELECT domain, unit, count(*) AS records, avg(abs(protected_state - truth)) AS s, avg(abs(guarded - truth)) AS g, avg(abs(smoothed - truth)) AS m FROM sc GROUP BY ALL)"""
_SMOOTH = """
sm AS (
  SELECT domain, unit, rn, least(greatest(raw_candidate, 0e0), 1.3e0) AS b FROM led WHERE rn = 1
  UNION ALL
  SELECT l.domain, l.unit, l.rn, least(greatest(s.b + 0.05e0 * least(l.raw_candidate - s.b, 0e0), 0e0), 1.3e0)
  FROM sm s JOIN led l ON l.domain = s.domain AND l.unit = s.unit AND l.rn = s.rn + 1
)"""


@query(
    "E12_sealed_then_scored",
    with_guarded(_SEAL + """ SELECT domain, unit, records, round(s, 9) AS protected_state, round(g, 9) AS guarded, round(m, 9) AS smoothed FROM su""", _SMOOTH),
)
def e12(spark, d):
    methods = ["protected_state", "guarded", "smoothed"]
    return _scored(spark, d).groupBy("domain", "unit").agg(
        F.count(F.lit(1)).alias("records"),
        *[F.round(F.avg(F.abs(F.col(m) - F.col("truth"))), 9).alias(m) for m in methods],
    )


@query(
    "E13_excluded_condition",
    with_guarded(_SEAL + """, ex AS (SELECT 'excluded' AS part, * FROM su WHERE domain = 'error' UNION ALL SELECT 'kept', * FROM su WHERE domain <> 'error' UNION ALL SELECT 'all', * FROM su)
 SELECT part, count(*) AS units, round(avg(g - s), 9) AS mean_difference, count(*) FILTER (g - s < -1e-12) AS wins, count(*) FILTER (g - s > 1e-12) AS losses FROM ex GROUP BY part""", _SMOOTH),
)
def e13(spark, d):
    """The contrast with one condition removed, on it alone, and on everything, in one pass."""
    gap = F.abs(F.col("guarded") - F.col("truth")) - F.abs(F.col("protected_state") - F.col("truth"))
    units = _scored(spark, d).groupBy("domain", "unit").agg(F.avg(gap).alias("difference"))
    part = F.when(F.col("domain") == "error", "excluded").otherwise("kept")
    both = units.withColumn("part", F.explode(F.array(part, F.lit("all"))))
    out = both.groupBy("part").agg(
        F.count(F.lit(1)).alias("units"), F.avg("difference").alias("mean_difference"),
        *metrics.win_tie_loss(),
    )
    return rounded(out.drop("ties"))


@query(
    "E17_threshold_decisions",
    with_metrics(""", t AS (SELECT threshold, max(a) FILTER (method = 'guarded') AS g, max(a) FILTER (method = 'fixed_shift') AS f FROM
   (SELECT threshold, method, avg(mean_absolute_delay_records) AS a FROM cs GROUP BY ALL) GROUP BY threshold)
 SELECT threshold, round(g, 9) AS guarded_delay, round(f, 9) AS shift_delay, round(g - f, 9) + 0e0 AS difference FROM t""", CROSSING_SQL),
)
def e17(spark, d):
    units = decisions.crossing_units(
        guarded(spark, d), ["fixed_shift", "guarded"], [0.8, 0.85, 0.9]
    )
    equal = decisions.domain_equal(decisions.crossing_summary(units))
    wide = equal.groupBy("threshold").pivot("method", ["guarded", "fixed_shift"]).agg(
        F.first("mean_absolute_delay_records")
    )
    gap = F.col("guarded") - F.col("fixed_shift")
    return rounded(
        wide.select(
            "threshold", F.col("guarded").alias("guarded_delay"),
            F.col("fixed_shift").alias("shift_delay"), gap.alias("difference"),
        )
    )


