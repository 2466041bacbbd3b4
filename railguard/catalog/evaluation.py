"""Hierarchical metrics, decisions and summaries (A1-A33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import (
    BUDGET,
    METHODS,
    guarded,
    ledger,
    query,
    table,
    with_guarded,
    with_ledger,
)
from railguard.functions.columns import relative_improvement_percent
from railguard.operators import decisions, flow, metrics, quantiles
from railguard.operators.layout import Keys
from railguard.operators.reshape import remap
from railguard.operators.selection import argmin_with_ties, decision_verdict


def rounded(df, digits=9):
    """Sums and means depend on the order of addition: compare nine digits."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


LONG_SQL = """
lg AS (SELECT domain, unit, rn, order_key, truth, method, prediction FROM (UNPIVOT
   (SELECT domain, unit, rn, order_key, truth, protected_state, fixed_shift, guarded, raw_candidate FROM gd)
   ON protected_state, fixed_shift, guarded, raw_candidate INTO NAME method VALUE prediction)),
um AS (
  SELECT domain, unit, method, count(*) AS records, avg(abs(prediction - truth)) AS mae,
    sqrt(avg((prediction - truth) * (prediction - truth))) AS rmse,
    coalesce(avg((move > 1e-12)::INT), 0e0) AS increase_fraction,
    coalesce(max(greatest(move, 0e0)), 0e0) AS maximum_increase
  FROM (SELECT *, prediction - lag(prediction) OVER (PARTITION BY domain, unit, method ORDER BY rn) AS move FROM lg)
  GROUP BY ALL),
dm AS (
  SELECT domain, method, count(*) AS units, avg(mae) AS unit_macro_mae, avg(rmse) AS unit_macro_rmse,
    max(mae) AS worst_unit_mae, avg(increase_fraction) AS mean_increase_fraction,
    max(maximum_increase) AS maximum_increase FROM um GROUP BY ALL),
ct AS (
  SELECT domain, max(unit_macro_mae) FILTER (method = 'guarded')
       - max(unit_macro_mae) FILTER (method = 'fixed_shift') AS difference FROM dm GROUP BY domain)"""


def with_metrics(sql: str, *extra: str) -> str:
    return with_guarded(sql, LONG_SQL, *extra)


def unit_table(spark, d):
    return metrics.unit_metrics(guarded(spark, d), METHODS)


def domain_table(spark, d):
    return metrics.domain_summary(unit_table(spark, d))


def shift_contrast(spark, d):
    return metrics.domain_contrast(domain_table(spark, d), "guarded", "fixed_shift")


@query(
    "A1_unit_metrics",
    with_metrics(""" SELECT domain, unit, method, records, round(mae, 9) AS mae, round(rmse, 9) AS rmse,
      round(increase_fraction, 9) AS increase_fraction, round(maximum_increase, 9) AS maximum_increase FROM um"""),
)
def a1(spark, d):
    return rounded(unit_table(spark, d))


@query(
    "A2_domain_summary",
    with_metrics(""" SELECT domain, method, units, round(unit_macro_mae, 9) AS unit_macro_mae, round(unit_macro_rmse, 9) AS unit_macro_rmse,
      round(worst_unit_mae, 9) AS worst_unit_mae, round(mean_increase_fraction, 9) AS mean_increase_fraction,
      round(maximum_increase, 9) AS maximum_increase FROM dm"""),
)
def a2(spark, d):
    return rounded(domain_table(spark, d))


@query(
    "A3_overall_summary",
    with_metrics(""" SELECT method, count(*) AS domains, round(avg(unit_macro_mae), 9) AS domain_equal_mae,
      round(avg(unit_macro_rmse), 9) AS domain_equal_rmse, round(max(unit_macro_mae), 9) AS worst_domain_mae FROM dm GROUP BY method"""),
)
def a3(spark, d):
    return rounded(metrics.overall_summary(domain_table(spark, d)))


@query(
    "A4_estimand_ladder",
    with_guarded(""", g AS (SELECT *, abs(guarded - truth) - abs(protected_state - truth) AS gap FROM gd),
 u AS (SELECT domain, unit, avg(gap) AS gap FROM g GROUP BY ALL), dd AS (SELECT domain, avg(gap) AS gap FROM u GROUP BY ALL)
 SELECT round((SELECT avg(gap) FROM g), 9) AS record_equal, round((SELECT avg(gap) FROM u), 9) AS unit_equal,
   round((SELECT avg(gap) FROM dd), 9) AS domain_equal, round((SELECT quantile_cont(gap, 0.5) FROM dd), 9) AS median_domain,
   round((SELECT quantile_cont(gap, 0.5) FROM u), 9) AS median_unit"""),
)
def a4(spark, d):
    return rounded(metrics.estimand_ladder(guarded(spark, d).frame, "guarded", "protected_state"))


_WEIGHTS = """, u AS (SELECT domain, unit, count(*) AS n FROM led GROUP BY ALL),
 dd AS (SELECT domain, count(*) AS units FROM u GROUP BY ALL),
 w AS (SELECT u.domain, u.unit, 1e0 / ((SELECT count(*) FROM dd) * units * n) AS weight FROM u JOIN dd USING (domain))"""


@query(
    "A5_row_weights",
    with_ledger(_WEIGHTS + """ SELECT domain, unit, ordinal, round(weight, 12) AS weight,
      round(weight * (SELECT count(*) FROM led), 9) AS mean_one FROM led JOIN w USING (domain, unit)"""),
)
def a5(spark, d):
    f = metrics.row_weights(ledger(spark, d))
    both = metrics.row_weights(f, scale="mean_one", out="mean_one")
    return both.select(
        "domain", "unit", "ordinal", F.round("weight", 12).alias("weight"),
        F.round("mean_one", 9).alias("mean_one"),
    )




@query(
    "A6_weighted_median",
    with_ledger(_WEIGHTS + """, c AS (SELECT domain, truth - raw_candidate AS v,
     sum(weight) OVER (PARTITION BY domain ORDER BY truth - raw_candidate) AS cum, sum(weight) OVER (PARTITION BY domain) AS total
   FROM led JOIN w USING (domain, unit))
 SELECT domain, min(v) AS weighted_median FROM c WHERE cum >= total * (0.5e0 - 1e-12) GROUP BY domain"""),
)
def a6(spark, d):
    f = metrics.row_weights(ledger(spark, d)).withColumn(
        "v", F.col("truth") - F.col("raw_candidate")
    )
    return quantiles.weighted_median(f, ["domain"], "v", "weight")


@query(
    "A7_budget_feasible_shift",
    with_guarded(_WEIGHTS + f""", c AS (SELECT truth - protected_state AS v,
     sum(weight) OVER (ORDER BY truth - protected_state) AS cum, sum(weight) OVER () AS total
   FROM gd JOIN w USING (domain, unit))
 SELECT min(v) AS weighted_median, least(greatest(min(v), -{BUDGET}e0), {BUDGET}e0) AS selected_shift
 FROM c WHERE cum >= total * (0.5e0 - 1e-12)"""),
)
def a7(spark, d):
    return metrics.budget_feasible_shift(guarded(spark, d).frame, "protected_state", BUDGET)


@query(
    "A8_quantile_profile",
    """SELECT l_returnflag, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum,
      round(avg((l_extendedprice > 50000)::INT), 9) AS above_50000_0, round(avg((l_extendedprice > 90000)::INT), 9) AS above_90000_0,
      round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS q95,
      round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY 1""",
)
def a8(spark, d):
    f = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    out = metrics.quantile_profile(f, ["l_returnflag"], "l_extendedprice", [50000.0, 90000.0])
    return out.withColumns(
        {c: F.round(c, 9 if c.startswith("above") else 6) for c in out.columns[3:]}
    )


@query(
    "A9_win_tie_loss",
    with_metrics(""", x AS (SELECT domain, unit, max(mae) FILTER (method = 'guarded') - max(mae) FILTER (method = 'protected_state') AS dif FROM um GROUP BY ALL)
 SELECT domain, count(*) FILTER (dif < -1e-9) AS wins, count(*) FILTER (abs(dif) <= 1e-9) AS ties, count(*) FILTER (dif > 1e-9) AS losses FROM x GROUP BY domain"""),
)
def a9(spark, d):
    units = metrics.unit_errors(guarded(spark, d).frame, ["guarded", "protected_state"])
    wide = units.groupBy("domain", "unit").pivot("method", ["guarded", "protected_state"]).agg(
        F.first("mae")
    )
    gap = F.col("guarded") - F.col("protected_state")
    return wide.groupBy("domain").agg(*metrics.win_tie_loss(gap, 1e-9))


@query(
    "A10_paired_contrast",
    with_metrics(""" SELECT round(avg(difference), 9) AS mean_difference, round(max(difference), 9) AS maximum_harm,
      round(min(difference), 9) AS maximum_gain, count(*) FILTER (difference < -1e-12) AS wins,
      count(*) FILTER (abs(difference) <= 1e-12) AS ties, count(*) FILTER (difference > 1e-12) AS losses FROM ct"""),
)
def a10(spark, d):
    return rounded(metrics.contrast_summary(shift_contrast(spark, d)))


@query(
    "A10_difference_map",
    with_metrics(""" SELECT string_agg(domain || '=' || printf('%.6f', difference), ';' ORDER BY domain) AS per_domain FROM ct"""),
)
def a10_map(spark, d):
    mapped = metrics.difference_map(shift_contrast(spark, d))
    entries = F.transform(
        F.map_entries("per_domain_difference"),
        lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.6f", e["value"])),
    )
    return mapped.select(F.concat_ws(";", entries).alias("per_domain"))


_CERT = f""", x AS (SELECT *, abs(guarded - protected_state) AS moved, abs(guarded - truth) - abs(protected_state - truth) AS regret,
   guarded - lag(guarded) OVER (PARTITION BY domain, unit ORDER BY rn) AS inc FROM gd)"""


@query(
    "A11_certificate",
    with_guarded(_CERT + f""" SELECT count(*) AS records, count(DISTINCT unit) AS units, max(moved) AS maximum_displacement,
     max(regret) AS maximum_regret, greatest(max(inc), 0e0) AS maximum_increase, min(guarded) AS minimum_output,
     max(guarded) AS maximum_output, count(*) FILTER (moved > {BUDGET}e0 + 1e-12) AS violating_records,
     count(DISTINCT unit) FILTER (moved > {BUDGET}e0 + 1e-12) AS violating_units,
     count(DISTINCT domain) FILTER (moved > {BUDGET}e0 + 1e-12) AS violating_domains FROM x"""),
)
def a11(spark, d):
    return metrics.certificate(guarded(spark, d), "protected_state", "guarded", "truth", BUDGET)


@query(
    "A12_regret_bounds",
    with_metrics(""", x AS (SELECT domain, unit, max(mae) FILTER (method = 'guarded') - max(mae) FILTER (method = 'protected_state') AS gap FROM um GROUP BY ALL)
 SELECT round(max(gap), 9) AS maximum_unit_harm, round((SELECT max(g) FROM (SELECT avg(gap) AS g FROM x GROUP BY domain)), 9) AS maximum_domain_harm FROM x"""),
)
def a12(spark, d):
    units = metrics.unit_errors(guarded(spark, d).frame, ["guarded", "protected_state"])
    return rounded(metrics.regret_bounds(units, "guarded", "protected_state"))


@query(
    "A13_violations_of_raw_candidate",
    with_guarded(f""" SELECT count(*) AS records, count(*) FILTER (abs(raw_candidate - protected_state) > {BUDGET}e0 + 1e-12) AS violating_records,
     count(DISTINCT unit) FILTER (abs(raw_candidate - protected_state) > {BUDGET}e0 + 1e-12) AS violating_units,
     count(DISTINCT domain) FILTER (abs(raw_candidate - protected_state) > {BUDGET}e0 + 1e-12) AS violating_domains FROM gd"""),
)
def a13(spark, d):
    out = metrics.certificate(guarded(spark, d), "protected_state", "raw_candidate", "truth", BUDGET)
    return out.select("records", "violating_records", "violating_units", "violating_domains")


@query(
    "A14_transition_metrics",
    with_metrics(""", x AS (SELECT *, prediction - lag(prediction) OVER (PARTITION BY domain, unit, method ORDER BY rn) AS move FROM lg),
 u AS (SELECT domain, unit, method, count(*) FILTER (move > 1e-12) AS p, count(move) AS t, max(move) AS h, max(move - 0.001e0) AS e FROM x GROUP BY ALL)
 SELECT method, sum(p)::BIGINT AS positive_transitions, sum(t)::BIGINT AS total_transitions, round(sum(p) / sum(t), 9) AS positive_fraction,
   count(*) FILTER (p > 0) AS affected_units, round(greatest(max(h), 0e0), 9) AS maximum_increase,
   round(max(e), 9) AS maximum_envelope_excess FROM u GROUP BY method"""),
)
def a14(spark, d):
    t = guarded(spark, d)
    t = t.with_frame(t.frame.withColumn("rise", F.lit(0.001)))
    return rounded(metrics.transition_metrics(t, METHODS, "rise"))


THRESHOLDS, RATIOS = [0.8, 0.85, 0.9], [1.0, 5.0, 10.0]
_DECISIONS = """, du AS (
  SELECT domain, unit, threshold, cost_ratio, method,
    avg((truth > threshold AND prediction <= threshold)::INT + cost_ratio * (truth <= threshold AND prediction > threshold)::INT) AS binary_cost,
    avg(greatest(truth - prediction, 0e0) + cost_ratio * greatest(prediction - truth, 0e0)) AS continuous_cost,
    avg((truth > threshold AND prediction <= threshold)::INT) AS premature_rate,
    avg((truth <= threshold AND prediction > threshold)::INT) AS missed_rate
  FROM lg, (VALUES (0.8e0), (0.85e0), (0.9e0)) a(threshold), (VALUES (1e0), (5e0), (10e0)) b(cost_ratio)
  WHERE method <> 'raw_candidate' GROUP BY ALL)"""
_COMPARED = ["protected_state", "fixed_shift", "guarded"]


@query(
    "A15_decision_costs",
    with_metrics(_DECISIONS + """ SELECT domain, unit, threshold, cost_ratio, method, round(binary_cost, 9) AS binary_cost,
      round(continuous_cost, 9) AS continuous_cost, round(premature_rate, 9) AS premature_rate, round(missed_rate, 9) AS missed_rate FROM du"""),
)
def a15(spark, d):
    f = guarded(spark, d).frame
    return rounded(decisions.decision_units(f, _COMPARED, THRESHOLDS, RATIOS))


@query(
    "A16_decision_summary",
    with_metrics(_DECISIONS + """, dd AS (SELECT domain, threshold, cost_ratio, method, avg(binary_cost) AS b, avg(continuous_cost) AS c,
      avg(premature_rate) AS p, avg(missed_rate) AS m FROM du GROUP BY ALL)
 SELECT threshold, cost_ratio, method, round(avg(b), 9) AS domain_equal_binary_cost, round(avg(c), 9) AS domain_equal_continuous_cost,
   round(avg(p), 9) AS domain_equal_premature_rate, round(avg(m), 9) AS domain_equal_missed_rate, count(*) AS domains FROM dd GROUP BY ALL"""),
)
def a16(spark, d):
    f = guarded(spark, d).frame
    units = decisions.decision_units(f, _COMPARED, THRESHOLDS, RATIOS)
    return rounded(decisions.decision_summary(units))


CROSSING_SQL = """
cu AS (
  SELECT domain, unit, threshold, method, count(*) AS records,
    min(rn) FILTER (truth <= threshold) AS tr, min(rn) FILTER (prediction <= threshold) AS pr,
    min(order_key) FILTER (truth <= threshold) AS tk, min(order_key) FILTER (prediction <= threshold) AS pk,
    count(*) FILTER (truth <= threshold) AS deg, count(*) FILTER (truth <= threshold AND prediction > threshold) AS late_n,
    count(*) FILTER (truth > threshold) AS hea, count(*) FILTER (truth > threshold AND prediction <= threshold) AS early_n
  FROM lg, (VALUES (0.8e0), (0.85e0), (0.9e0)) a(threshold) WHERE method <> 'raw_candidate' GROUP BY ALL),
cr AS (
  SELECT domain, unit, records, threshold, method, tr IS NOT NULL AS truth_crossed, pr IS NOT NULL AS prediction_crossed,
    tr AS truth_first_record, pr AS prediction_first_record, coalesce(pr, records + 1) - tr AS delay_records,
    (pk - tk)::DOUBLE AS order_delay, (coalesce(pr, records + 1) - tr > 0)::INT AS late,
    CASE WHEN tr IS NOT NULL THEN (coalesce(pr, records + 1) - tr < 0)::INT ELSE (pr IS NOT NULL)::INT END AS premature,
    (coalesce(pr, records + 1) - tr = 0)::INT AS on_time,
    CASE WHEN deg > 0 THEN late_n / deg END AS late_record_rate, CASE WHEN hea > 0 THEN early_n / hea END AS premature_record_rate
  FROM cu),
cs AS (
  SELECT domain, threshold, method, count(*) AS units, count(*) FILTER (truth_crossed) AS truth_crossing_units,
    count(*) FILTER (prediction_crossed) AS prediction_crossing_units,
    avg(delay_records) AS mean_delay_records, avg(abs(delay_records)) AS mean_absolute_delay_records,
    quantile_cont(greatest(delay_records, 0)::DOUBLE, 0.95) FILTER (truth_crossed) AS p95_late_delay_records,
    avg(abs(order_delay)) AS mean_absolute_order_delay, avg(late) AS late_unit_rate,
    avg(premature) FILTER (truth_crossed) AS premature_unit_rate, avg(on_time) AS on_time_unit_rate,
    avg(premature) FILTER (NOT truth_crossed) AS premature_rate_without_crossing,
    avg(late_record_rate) AS macro_late_record_rate, avg(premature_record_rate) AS macro_premature_record_rate
  FROM cr GROUP BY ALL)"""


def crossing_table(spark, d):
    return decisions.crossing_units(guarded(spark, d), _COMPARED, THRESHOLDS)


@query(
    "W7_crossing_delays",
    with_metrics(""" SELECT domain, unit, records, threshold, method, truth_crossed, prediction_crossed, truth_first_record,
      prediction_first_record, delay_records, order_delay, late, premature, on_time,
      round(late_record_rate, 9) AS late_record_rate, round(premature_record_rate, 9) AS premature_record_rate FROM cr""", CROSSING_SQL),
)
def w7_delays(spark, d):
    out = crossing_table(spark, d)
    return out.withColumns(
        {c: F.round(c, 9) for c in ("late_record_rate", "premature_record_rate")}
    )


_SUMMARY_COLUMNS = ", ".join(
    f"round({c}, {0 if c == 'mean_absolute_order_delay' else 9}) AS {c}"
    for c in decisions.SUMMARY_METRICS
)


def _short(df):
    digits = {c: 9 for c in decisions.SUMMARY_METRICS} | {"mean_absolute_order_delay": 0}
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "A17_threshold_summary",
    with_metrics(
        f" SELECT domain, threshold, method, units, truth_crossing_units, prediction_crossing_units, {_SUMMARY_COLUMNS} FROM cs",
        CROSSING_SQL,
    ),
)
def a17(spark, d):
    return _short(decisions.crossing_summary(crossing_table(spark, d)))


_MEANS = ", ".join(
    f"round(avg({c}), {-1 if c == 'mean_absolute_order_delay' else 9}) AS {c}"
    for c in decisions.SUMMARY_METRICS
)


@query(
    "A18_domain_equal_thresholds",
    with_metrics(f" SELECT threshold, method, {_MEANS} FROM cs GROUP BY ALL", CROSSING_SQL),
)
def a18(spark, d):
    out = decisions.domain_equal(decisions.crossing_summary(crossing_table(spark, d)))
    digits = {c: 9 for c in decisions.SUMMARY_METRICS} | {"mean_absolute_order_delay": -1}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "A19_comparator_differences",
    with_metrics(f""", tall AS (UNPIVOT (SELECT domain, threshold, method, {', '.join(decisions.COMPARED_METRICS)} FROM cs)
   ON {', '.join(decisions.COMPARED_METRICS)} INTO NAME metric VALUE v),
 wide AS (SELECT domain, threshold, metric, max(v) FILTER (method = 'guarded') AS g, max(v) FILTER (method = 'protected_state') AS protected_state,
   max(v) FILTER (method = 'fixed_shift') AS fixed_shift FROM tall GROUP BY ALL),
 gaps AS (SELECT threshold, metric, 'protected_state' AS reference, g - protected_state AS dif FROM wide
   UNION ALL SELECT threshold, metric, 'fixed_shift', g - fixed_shift FROM wide)
 SELECT threshold, reference, metric, count(dif) AS domains, round(avg(dif), 9) + 0e0 AS mean_difference,
   round(quantile_cont(dif, 0.5), 9) + 0e0 AS median_difference, count(*) FILTER (dif < -1e-12) AS wins,
   count(*) FILTER (abs(dif) <= 1e-12) AS ties, count(*) FILTER (dif > 1e-12) AS losses FROM gaps GROUP BY ALL""", CROSSING_SQL),
)
def a19(spark, d):
    summary = decisions.crossing_summary(crossing_table(spark, d))
    out = decisions.comparator_differences(summary, "guarded", ["protected_state", "fixed_shift"])
    return rounded(out).withColumn("threshold", F.col("threshold"))


@query(
    "A20_leave_one_domain_out",
    with_metrics(""" SELECT domain AS omitted_domain, (SELECT count(*) FROM ct) - 1 AS retained_domains,
      round(((SELECT sum(difference) FROM ct) - difference) / ((SELECT count(*) FROM ct) - 1), 9) AS mean_difference FROM ct"""),
)
def a20(spark, d):
    return rounded(metrics.leave_one_out(shift_contrast(spark, d)))


@query(
    "A21_largest_domain_sensitivity",
    with_guarded(""", x AS (SELECT domain, count(*) AS units, sum(n)::BIGINT AS records, avg(gap) AS difference FROM (
   SELECT domain, unit, count(*) AS n, avg(abs(guarded - truth) - abs(fixed_shift - truth)) AS gap FROM gd GROUP BY ALL) GROUP BY domain),
 a AS (SELECT domain FROM x ORDER BY units DESC, records DESC, domain DESC LIMIT 1), b AS (SELECT domain FROM x ORDER BY records DESC, units DESC, domain DESC LIMIT 1)
 SELECT (SELECT domain FROM a) AS largest_by_units, round((SELECT avg(difference) FROM x WHERE domain <> (SELECT domain FROM a)), 9) AS without_largest_by_units,
   (SELECT domain FROM b) AS largest_by_records, round((SELECT avg(difference) FROM x WHERE domain <> (SELECT domain FROM b)), 9) AS without_largest_by_records"""),
)
def a21(spark, d):
    gap = F.abs(F.col("guarded") - F.col("truth")) - F.abs(F.col("fixed_shift") - F.col("truth"))
    units = guarded(spark, d).frame.groupBy("domain", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("gap")
    )
    domains = units.groupBy("domain").agg(
        F.count(F.lit(1)).alias("units"), F.sum("n").alias("records"), F.avg("gap").alias("difference")
    )
    return rounded(metrics.largest_domain_sensitivity(domains))


@query(
    "A22_source_group_sensitivity",
    with_metrics(""", r AS (SELECT CASE WHEN domain IN ('click', 'view') THEN 'browse' ELSE domain END AS domain, method, avg(mae) AS m FROM um GROUP BY ALL),
 c AS (SELECT domain, max(m) FILTER (method = 'guarded') - max(m) FILTER (method = 'fixed_shift') AS dif FROM r GROUP BY domain)
 SELECT count(*) AS domains, round(avg(dif), 9) AS mean_difference, round(max(dif), 9) AS maximum_harm, round(min(dif), 9) AS maximum_gain FROM c"""),
)
def a22(spark, d):
    units = metrics.unit_errors(guarded(spark, d).frame, ["guarded", "fixed_shift"])
    merged = remap(units, "domain", {"click": "browse", "view": "browse"})
    domains = merged.groupBy("domain", "method").agg(F.avg("mae").alias("unit_macro_mae"))
    contrast = metrics.domain_contrast(domains, "guarded", "fixed_shift")
    return rounded(
        contrast.agg(
            F.count(F.lit(1)).alias("domains"),
            F.avg("difference").alias("mean_difference"),
            F.max("difference").alias("maximum_harm"),
            F.min("difference").alias("maximum_gain"),
        )
    )


@query(
    "A23_path_area",
    """WITH x AS (SELECT o_orderpriority AS p, date_part('year', o_orderdate)::INT - 1990 AS x, round(avg(o_totalprice), 4) AS y FROM orders GROUP BY ALL),
 s AS (SELECT *, lag(x) OVER (PARTITION BY p ORDER BY x) AS x0, lag(y) OVER (PARTITION BY p ORDER BY x) AS y0 FROM x)
 SELECT p, round(sum(0.5e0 * (y + y0) * (x - x0)) / max(x), 4) AS normalised_area FROM s GROUP BY p""",
)
def a23(spark, d):
    yearly = (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("p"), (F.year("o_orderdate") - 1990).alias("x"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("y"))
    )
    out = metrics.path_area(yearly, ["p"], "x", "y")
    return out.withColumn("normalised_area", F.round("normalised_area", 4))


@query(
    "A24_argmin_with_ties",
    """WITH s AS (SELECT l_suppkey, l_discount, l_tax + 0e0 AS l_tax, round(avg(abs(l_extendedprice - 30000e0)) / 30000e0, 1) AS score FROM lineitem GROUP BY ALL),
 t AS (SELECT *, min(score) OVER (PARTITION BY l_suppkey) AS best FROM s)
 SELECT l_suppkey, l_discount + 0e0 AS l_discount, l_tax, score FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_tax) AS n FROM t WHERE score <= best + 1e-12) WHERE n = 1""",
)
def a24(spark, d):
    gap = F.abs(F.col("l_extendedprice") - 30000.0)
    scores = (
        table(spark, d, "lineitem")
        .groupBy("l_suppkey", (F.col("l_discount") + 0.0).alias("l_discount"), (F.col("l_tax") + 0.0).alias("l_tax"))
        .agg(F.round(F.avg(gap) / 30000.0, 1).alias("score"))
    )
    return argmin_with_ties(scores, ["l_suppkey"], "score", [F.desc("l_discount"), F.asc("l_tax")])


ARMS = {"raw_pooled": "raw_candidate", "raw_equal": "protected_state",
        "change_pooled": "fixed_shift", "change_equal": "guarded"}


@query(
    "A25_factorial_effects",
    with_metrics(""", w AS (SELECT domain, max(unit_macro_mae) FILTER (method = 'raw_candidate') AS rp, max(unit_macro_mae) FILTER (method = 'protected_state') AS re,
   max(unit_macro_mae) FILTER (method = 'fixed_shift') AS cp, max(unit_macro_mae) FILTER (method = 'guarded') AS ce FROM dm GROUP BY domain),
 e AS (SELECT domain, 'feature_under_pooled' AS effect, cp - rp AS dif FROM w UNION ALL SELECT domain, 'feature_under_equal', ce - re FROM w
   UNION ALL SELECT domain, 'weighting_with_raw', re - rp FROM w UNION ALL SELECT domain, 'weighting_with_change', ce - cp FROM w
   UNION ALL SELECT domain, 'interaction', ce - cp - re + rp FROM w)
 SELECT effect, round(avg(dif), 9) + 0e0 AS mean_difference, round(max(dif), 9) + 0e0 AS maximum_harm, round(min(dif), 9) + 0e0 AS maximum_gain FROM e GROUP BY effect"""),
)
def a25(spark, d):
    effects = metrics.factorial_effects(domain_table(spark, d), ARMS, "unit_macro_mae")
    out = metrics.contrast_summary(effects, ["effect"])
    return rounded(out.select("effect", "mean_difference", "maximum_harm", "maximum_gain"))


@query(
    "A26_relative_improvement",
    with_metrics(""", w AS (SELECT domain, max(unit_macro_mae) FILTER (method = 'guarded') AS g, max(unit_macro_mae) FILTER (method = 'protected_state') AS s,
      max(unit_macro_mae) FILTER (method = 'raw_candidate') AS c FROM dm GROUP BY domain)
 SELECT domain, round(CASE WHEN s <> 0 THEN 100e0 * (s - g) / s END, 6) AS improvement_percent,
   round(CASE WHEN s - c <> 0 THEN (s - g) / (s - c) END, 6) AS utility_retained FROM w"""),
)
def a26(spark, d):
    wide = domain_table(spark, d).groupBy("domain").pivot(
        "method", ["guarded", "protected_state", "raw_candidate"]
    ).agg(F.first("unit_macro_mae"))
    kept = F.try_divide(
        F.col("protected_state") - F.col("guarded"), F.col("protected_state") - F.col("raw_candidate")
    )
    return wide.select(
        "domain",
        F.round(relative_improvement_percent("guarded", "protected_state"), 6).alias("improvement_percent"),
        F.round(kept, 6).alias("utility_retained"),
    )


@query(
    "A27_decision_rule",
    with_metrics(f""", x AS (SELECT method, max(abs(prediction - protected_state)) AS moved, coalesce(max(inc), 0e0) AS inc FROM (
   SELECT method, prediction, gd.protected_state, prediction - lag(prediction) OVER (PARTITION BY method, domain, unit ORDER BY rn) AS inc
   FROM lg JOIN gd USING (domain, unit, rn)) GROUP BY method),
 bs AS (SELECT domain, max(unit_macro_mae) FILTER (method = 'fixed_shift') AS f, max(unit_macro_mae) FILTER (method = 'protected_state') AS s FROM dm GROUP BY domain),
 v AS (SELECT 'fixed_shift' AS baseline UNION ALL SELECT 'protected_state'),
 g AS (SELECT method, baseline, avg(unit_macro_mae - CASE baseline WHEN 'fixed_shift' THEN f ELSE s END) < 0 AS gain
   FROM dm JOIN bs USING (domain), v WHERE method <> baseline GROUP BY ALL)
 SELECT method, baseline, gain, moved <= {BUDGET}e0 + 1e-12 AS budget_held, inc <= 1e-12 AS monotone,
   CASE WHEN NOT (moved <= {BUDGET}e0 + 1e-12 AND inc <= 1e-12) THEN 'REJECT' WHEN gain THEN 'RETAIN' ELSE 'NARROW' END AS verdict
 FROM g JOIN x USING (method)"""),
)
def a27(spark, d):
    """Every method against two baselines: a broken certificate rejects, whatever the gain."""
    t = guarded(spark, d)
    macro = metrics.domain_summary(metrics.unit_metrics(t, METHODS))
    moved = [F.max(F.abs(F.col(m) - F.col("protected_state"))).alias(m) for m in METHODS]
    displaced = t.frame.agg(*moved).unpivot([], METHODS, "method", "maximum_displacement")
    # Domains are a short list: the metrics of all methods stand in one row per domain.
    wide = macro.groupBy("domain").pivot("method", METHODS).agg(
        F.first("unit_macro_mae").alias("mae"), F.first("maximum_increase").alias("increase")
    )
    pairs = [(m, b) for m in METHODS for b in ("fixed_shift", "protected_state") if m != b]
    rows = [
        F.struct(
            F.lit(m).alias("method"), F.lit(b).alias("baseline"),
            F.col(f"g{i}").alias("mean"), F.col(f"u{i}").alias("maximum_increase"),
        )
        for i, (m, b) in enumerate(pairs)
    ]
    means = wide.agg(
        *[F.avg(F.col(f"{m}_mae") - F.col(f"{b}_mae")).alias(f"g{i}") for i, (m, b) in enumerate(pairs)],
        *[F.max(f"{m}_increase").alias(f"u{i}") for i, (m, b) in enumerate(pairs)],
    ).select(F.inline(F.array(*rows)))
    gates = {
        "gain": F.col("mean") < 0,
        "budget_held": F.col("maximum_displacement") <= BUDGET + 1e-12,
        "monotone": F.col("maximum_increase") <= 1e-12,
    }
    judged = means.join(displaced, "method").select(
        "method", "baseline", *decision_verdict(gates, {"budget_held", "monotone"})
    )
    return judged.select("method", "baseline", *[F.col("gates")[g].alias(g) for g in gates], "verdict")


_REASON = "CASE WHEN value < 2 THEN 'too_low' WHEN value > 150 THEN 'too_high' END"


@query(
    "A28_unit_profile",
    f"""WITH e AS (SELECT *, {_REASON} AS reason FROM events)
 SELECT event_type, user_id, arg_min(value, (ts, event_id)) FILTER (reason IS NULL) AS first_value,
   arg_max(value, (ts, event_id)) FILTER (reason IS NULL) AS last_value, min(value) FILTER (reason IS NULL) AS minimum_value,
   max(value) FILTER (reason IS NULL) AS maximum_value, count(*) FILTER (reason IS NULL) AS valid_records,
   count(*) FILTER (reason IS NOT NULL) AS invalid_records,
   concat_ws(';', CASE WHEN count(*) FILTER (reason = 'too_high') > 0 THEN 'too_high=' || count(*) FILTER (reason = 'too_high') END,
     CASE WHEN count(*) FILTER (reason = 'too_low') > 0 THEN 'too_low=' || count(*) FILTER (reason = 'too_low') END) AS reasons
 FROM e GROUP BY ALL""",
)
def a28(spark, d):
    f = table(spark, d, "events").withColumn("reason", F.expr(_REASON))
    keys = Keys(domain="event_type", unit="user_id", order=("ts", "event_id"))
    out = metrics.unit_profile(f, keys, "value", "reason")
    text = F.transform(
        F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return out.withColumn("reasons", F.concat_ws(";", text))


@query(
    "A29_unit_size_profile",
    with_ledger(""" SELECT domain, count(*) AS units, min(n) AS minimum_records, quantile_cont(n::DOUBLE, 0.5) AS median_records, max(n) AS maximum_records
      FROM (SELECT domain, unit, count(*) AS n FROM led GROUP BY ALL) GROUP BY domain"""),
)
def a29(spark, d):
    return metrics.unit_size_profile(ledger(spark, d))


_FLOW = """, u AS (
  SELECT domain, unit, count(*) AS n, count(*) FILTER (rn <= 5) AS anchors, quantile_cont(truth, 0.5) FILTER (rn <= 5) AS reference FROM led GROUP BY ALL),
 r AS (SELECT *, CASE WHEN anchors < 5 THEN 'anchor_missing' WHEN reference < 0.85e0 OR reference > 1.1e0 THEN 'reference_out_of_range'
   WHEN n - 5 < 6 THEN 'too_few_records' END AS reason FROM u),
 rc AS (SELECT domain, reason, count(*) AS c FROM r WHERE reason IS NOT NULL GROUP BY ALL)"""


@query(
    "A30_sample_flow",
    with_ledger(_FLOW + """ SELECT domain, count(*) AS raw_units, sum(n)::BIGINT AS raw_records, count(*) FILTER (reason IS NULL) AS eligible_units,
   count(*) FILTER (reason IS NOT NULL) AS excluded_units, coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS excluded_records,
   coalesce(sum(least(n, 5)) FILTER (reason IS NULL), 0)::BIGINT AS anchor_records,
   coalesce(sum(n - least(n, 5)) FILTER (reason IS NULL), 0)::BIGINT AS scored_records,
   coalesce((SELECT string_agg(reason || '=' || c, ';' ORDER BY reason) FROM rc WHERE rc.domain = r.domain), '') AS exclusion_reasons
 FROM r GROUP BY domain"""),
)
def a30(spark, d):
    f = ledger(spark, d)
    units = flow.eligibility(f, Keys(), "truth", (0.85, 1.1), 6)
    return flow.sample_flow(f, Keys(), units)


@query(
    "A31_condition_means",
    """SELECT o_orderstatus || '|' || o_orderpriority AS condition, count(*) AS units, round(avg(o_totalprice), 4) AS mean_value FROM orders GROUP BY ALL""",
)
def a31(spark, d):
    f = table(spark, d, "orders")
    out = metrics.condition_means(f, ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return out.withColumn("mean_value", F.round("mean_value", 4))


@query(
    "A32_distinct_counts",
    "SELECT count(DISTINCT event_type) AS domains, count(DISTINCT user_id) AS units FROM events",
)
def a32(spark, d):
    return table(spark, d, "events").agg(
        F.countDistinct("event_type").alias("domains"), F.countDistinct("user_id").alias("units")
    )


_BUDGETS = [0.01, 0.02, 0.05]
_FRONTIER = "".join(
    f""", p{i} AS (SELECT {b}e0 AS budget, domain, unit, truth, protected_state, raw_candidate,
   protected_state + least(greatest(raw_candidate - protected_state, -{b}e0), {b}e0) AS capped FROM gd)"""
    for i, b in enumerate(_BUDGETS)
)


@query(
    "A33_budget_frontier",
    with_guarded(_FRONTIER + ", pa AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(_BUDGETS))) + """),
 uu AS (SELECT budget, domain, unit, avg(abs(capped - truth)) AS m, avg(abs(capped - truth)) - avg(abs(protected_state - truth)) AS gap,
   max(abs(capped - protected_state)) AS moved FROM pa GROUP BY ALL),
 dd AS (SELECT budget, domain, avg(m) AS m, max(gap) AS ug, avg(gap) AS dg, max(moved) AS moved FROM uu GROUP BY ALL)
 SELECT budget, round(avg(m), 9) AS domain_equal_mae, round(max(ug), 9) AS maximum_unit_harm, round(max(dg), 9) AS maximum_domain_harm,
   round(max(moved), 9) AS maximum_displacement FROM dd GROUP BY budget"""),
)
def a33(spark, d):
    from railguard.plans.workflows import budget_frontier

    return rounded(budget_frontier(guarded(spark, d).frame, "protected_state", "raw_candidate", _BUDGETS))




@query(
    "D2_ledger_sink",
    with_metrics(" SELECT domain, method, units, round(unit_macro_mae, 9) AS unit_macro_mae FROM dm"),
)
def d2(spark, d):
    """Prediction ledger as Parquet and metrics as CSV, both read back under their schema."""
    from railguard.session import scratch_path
    from railguard.sources import sinks, tables

    path = scratch_path(spark, "ledger")
    t = guarded(spark, d)
    predictions = t.frame.drop(*[c for c in t.part if c not in t.keys.group])
    sinks.write_ledger(predictions, {"domains": rounded(metrics.domain_summary(
        metrics.unit_metrics(t, METHODS)
    )).select("domain", "method", "units", "unit_macro_mae")}, path)
    schema = "domain string, method string, units bigint, unit_macro_mae double"
    return tables.read_csv(spark, f"{path}/domains", schema)
