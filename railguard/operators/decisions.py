"""Threshold decisions: crossing delays, premature and missed reviews, decision costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from railguard.functions.columns import is_missed, is_premature
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.metrics import win_tie_loss
from railguard.operators.ordering import with_rank


def decision_units(
    df: DataFrame, methods: list[str], thresholds: list[float], ratios: list[float],
    truth: str = "truth", keys: Keys = Keys(),
) -> DataFrame:
    """Decision costs per unit over the threshold x ratio x method grid.

    The grid never multiplies records: rates per threshold and one-sided errors are
    aggregated as columns, and the grid is laid out on the per-unit result (both costs
    are linear in the ratio).
    """
    zero = F.lit(0.0)
    aggs = []
    for m in methods:
        gap = F.col(truth) - F.col(m)
        aggs += [
            F.avg(F.greatest(gap, zero)).alias(f"{m}__under"),
            F.avg(F.greatest(-gap, zero)).alias(f"{m}__over"),
        ]
        for i, threshold in enumerate(thresholds):
            aggs += [
                F.avg(is_premature(truth, m, threshold)).alias(f"{m}__{i}__premature"),
                F.avg(is_missed(truth, m, threshold)).alias(f"{m}__{i}__missed"),
            ]
    units = df.groupBy(*keys.group).agg(*aggs)
    rows = [
        F.struct(
            F.lit(float(threshold)).alias("threshold"),
            F.lit(float(ratio)).alias("cost_ratio"),
            F.lit(m).alias("method"),
            (F.col(f"{m}__{i}__premature") + ratio * F.col(f"{m}__{i}__missed")).alias(
                "binary_cost"
            ),
            (F.col(f"{m}__under") + ratio * F.col(f"{m}__over")).alias("continuous_cost"),
            F.col(f"{m}__{i}__premature").alias("premature_rate"),
            F.col(f"{m}__{i}__missed").alias("missed_rate"),
        )
        for i, threshold in enumerate(thresholds)
        for ratio in ratios
        for m in methods
    ]
    return units.select(*keys.group, F.inline(F.array(*rows)))


_COSTS = ["binary_cost", "continuous_cost", "premature_rate", "missed_rate"]


def decision_summary(units: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Unit means inside each domain, then the equal-weight mean over domains."""
    grid = ["threshold", "cost_ratio", "method"]
    domains = units.groupBy(keys.domain, *grid).agg(*[F.avg(c).alias(c) for c in _COSTS])
    return domains.groupBy(*grid).agg(
        *[F.avg(c).alias(f"domain_equal_{c}") for c in _COSTS],
        F.count(F.lit(1)).alias("domains"),
    )


def crossing_units(
    t: Trajectories, methods: list[str], thresholds: list[float], truth: str = "truth"
) -> DataFrame:
    """First crossings of truth and predictions, delays and record-level error counts.

    A prediction that never crosses is censored one past the last record; a unit whose
    truth never crosses has no delay, and any predicted crossing of it is premature.
    """
    ranked = with_rank(t, "_rank").frame
    order = F.col(t.keys.order[0])
    aggs = [F.count(F.lit(1)).alias("records")]
    for i, thr in enumerate(thresholds):
        low = F.col(truth) <= thr
        aggs += [
            F.min(F.when(low, F.col("_rank"))).alias(f"t{i}"),
            F.min(F.when(low, order)).alias(f"to{i}"),
            F.count_if(low).alias(f"d{i}"),
        ]
        for m in methods:
            seen = F.col(m) <= thr
            aggs += [
                F.min(F.when(seen, F.col("_rank"))).alias(f"{m}__{i}__p"),
                F.min(F.when(seen, order)).alias(f"{m}__{i}__po"),
                F.count_if(low & ~seen).alias(f"{m}__{i}__late"),
                F.count_if(~low & seen).alias(f"{m}__{i}__early"),
            ]
    units = ranked.groupBy(*t.keys.group).agg(*aggs)
    rows = []
    for i, thr in enumerate(thresholds):
        t_rank, degraded = F.col(f"t{i}"), F.col(f"d{i}")
        healthy = F.col("records") - degraded
        for m in methods:
            p_rank = F.col(f"{m}__{i}__p")
            censored = F.coalesce(p_rank, F.col("records") + 1)
            delay = censored - t_rank
            late, early = F.col(f"{m}__{i}__late"), F.col(f"{m}__{i}__early")
            rows.append(
                F.struct(
                    F.lit(float(thr)).alias("threshold"),
                    F.lit(m).alias("method"),
                    t_rank.isNotNull().alias("truth_crossed"),
                    p_rank.isNotNull().alias("prediction_crossed"),
                    t_rank.alias("truth_first_record"),
                    p_rank.alias("prediction_first_record"),
                    delay.alias("delay_records"),
                    (F.col(f"{m}__{i}__po") - F.col(f"to{i}")).cast("double").alias("order_delay"),
                    (delay > 0).cast("int").alias("late"),
                    F.when(t_rank.isNotNull(), delay < 0)
                    .otherwise(p_rank.isNotNull())
                    .cast("int")
                    .alias("premature"),
                    (delay == 0).cast("int").alias("on_time"),
                    F.when(degraded > 0, late / degraded).alias("late_record_rate"),
                    F.when(healthy > 0, early / healthy).alias("premature_record_rate"),
                )
            )
    return units.select(*t.keys.group, "records", F.inline(F.array(*rows)))


def crossing_summary(units: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Delay and rate summary per domain, threshold and method; NULL where undefined.

    The 95% late delay is exact: delays are whole numbers, so it is taken over distinct
    delays with their frequency and no list of units is ever collected.
    """
    group = [keys.domain, "threshold", "method"]
    crossed = F.col("truth_crossed")
    late_delay = F.when(crossed, F.greatest(F.col("delay_records"), F.lit(0)))
    sums = units.groupBy(*group, late_delay.alias("_late_delay")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(crossed).alias("crossing"),
        F.count_if("prediction_crossed").alias("predicted"),
        F.sum("delay_records").alias("delay"),
        F.sum(F.abs("delay_records")).alias("abs_delay"),
        F.sum(F.abs("order_delay")).alias("order_delay"),
        F.count("order_delay").alias("both"),
        F.sum("late").alias("late"),
        F.sum(F.when(crossed, F.col("premature"))).alias("premature_crossers"),
        F.sum("on_time").alias("on_time"),
        F.sum(F.when(~crossed, F.col("premature"))).alias("premature_others"),
        F.sum("late_record_rate").alias("late_rate"),
        F.count("late_record_rate").alias("late_rate_n"),
        F.sum("premature_record_rate").alias("early_rate"),
        F.count("premature_record_rate").alias("early_rate_n"),
    )

    def ratio(top: str, bottom: str):
        # A group with nothing eligible has no rate rather than a zero.
        return F.try_divide(F.sum(top).cast("double"), F.sum(bottom).cast("double"))

    return sums.groupBy(*group).agg(
        F.sum("n").alias("units"),
        F.sum("crossing").alias("truth_crossing_units"),
        F.sum("predicted").alias("prediction_crossing_units"),
        ratio("delay", "crossing").alias("mean_delay_records"),
        ratio("abs_delay", "crossing").alias("mean_absolute_delay_records"),
        F.percentile("_late_delay", 0.95, F.col("n")).alias("p95_late_delay_records"),
        ratio("order_delay", "both").alias("mean_absolute_order_delay"),
        ratio("late", "crossing").alias("late_unit_rate"),
        ratio("premature_crossers", "crossing").alias("premature_unit_rate"),
        ratio("on_time", "crossing").alias("on_time_unit_rate"),
        F.try_divide(
            F.sum("premature_others").cast("double"),
            (F.sum("n") - F.sum("crossing")).cast("double"),
        ).alias("premature_rate_without_crossing"),
        ratio("late_rate", "late_rate_n").alias("macro_late_record_rate"),
        ratio("early_rate", "early_rate_n").alias("macro_premature_record_rate"),
    )


SUMMARY_METRICS = [
    "mean_delay_records", "mean_absolute_delay_records", "p95_late_delay_records",
    "mean_absolute_order_delay", "late_unit_rate", "premature_unit_rate", "on_time_unit_rate",
    "premature_rate_without_crossing", "macro_late_record_rate", "macro_premature_record_rate",
]

COMPARED_METRICS = [
    "mean_absolute_delay_records", "p95_late_delay_records", "late_unit_rate",
    "premature_unit_rate", "macro_late_record_rate", "macro_premature_record_rate",
]


def domain_equal(summary: DataFrame) -> DataFrame:
    """Equal-weight mean over domains; undefined domain values are skipped."""
    return summary.groupBy("threshold", "method").agg(
        *[F.avg(c).alias(c) for c in SUMMARY_METRICS]
    )


def comparator_differences(
    summary: DataFrame, method: str, references: list[str], keys: Keys = Keys(),
    metrics: list[str] | None = None,
) -> DataFrame:
    """Per threshold, reference and metric: mean and median difference, wins/ties/losses."""
    metrics = metrics or COMPARED_METRICS
    tall = summary.select(keys.domain, "threshold", "method", *metrics).unpivot(
        [keys.domain, "threshold", "method"], metrics, "metric", "value"
    )
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    wide = tall.groupBy(keys.domain, "threshold", "metric").agg(
        pick(method).alias("_mine"), *[pick(r).alias(r) for r in references]
    )
    gaps = wide.select(
        "threshold",
        "metric",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("reference"), (F.col("_mine") - F.col(r)).alias("difference")
                    )
                    for r in references
                ]
            )
        ),
    )
    return gaps.groupBy("threshold", "reference", "metric").agg(
        F.count("difference").alias("domains"),
        F.avg("difference").alias("mean_difference"),
        F.percentile("difference", 0.5).alias("median_difference"),
        *win_tie_loss(),
    )
