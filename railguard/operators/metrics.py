"""Hierarchical metrics: record -> unit -> domain -> overall, each level re-weighted.

Methods stay as columns through the one large aggregation (per unit) and become rows
only afterwards, so the record table is never multiplied by the number of methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from railguard.functions.columns import TOLERANCE
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.ordering import with_previous
from railguard.operators.quantiles import exact_quantiles, weighted_median
from railguard.session import durable


def _method_rows(units: DataFrame, ids: list[str], methods: list[str], fields: list[str]):
    rows = [
        F.struct(F.lit(m).alias("method"), *[F.col(f"{m}__{f}").alias(f) for f in fields])
        for m in methods
    ]
    return units.select(*ids, F.inline(F.array(*rows)))


def unit_metrics(
    t: Trajectories, methods: list[str], truth: str = "truth", tolerance: float = TOLERANCE
) -> DataFrame:
    """Per unit and method: MAE, RMSE and how often and how far the trajectory rises.

    Records without truth count for the increments but not for the errors.
    """
    t = with_previous(t, {f"{m}__before": m for m in methods})
    aggs: list[Column] = []
    for m in methods:
        error = F.col(m) - F.col(truth)
        move = F.col(m) - F.col(f"{m}__before")
        aggs += [
            F.count(error).alias(f"{m}__records"),
            F.avg(F.abs(error)).alias(f"{m}__mae"),
            F.sqrt(F.avg(error * error)).alias(f"{m}__rmse"),
            F.coalesce(F.avg((move > tolerance).cast("double")), F.lit(0.0)).alias(
                f"{m}__increase_fraction"
            ),
            F.coalesce(F.max(F.greatest(move, F.lit(0.0))), F.lit(0.0)).alias(
                f"{m}__maximum_increase"
            ),
        ]
    units = t.frame.groupBy(*t.keys.group).agg(*aggs)
    fields = ["records", "mae", "rmse", "increase_fraction", "maximum_increase"]
    return _method_rows(units, t.keys.group, methods, fields)


def unit_errors(
    df: DataFrame, methods: list[str], truth: str = "truth", keys: Keys = Keys()
) -> DataFrame:
    """Unit MAE only: needs no order, so it is a single map-side combined aggregate."""
    aggs = [F.count(truth).alias("records")]
    aggs += [F.avg(F.abs(F.col(m) - F.col(truth))).alias(f"{m}__mae") for m in methods]
    units = df.groupBy(*keys.group).agg(*aggs)
    rows = [F.struct(F.lit(m).alias("method"), F.col(f"{m}__mae").alias("mae")) for m in methods]
    return units.select(*keys.group, "records", F.inline(F.array(*rows)))


def domain_summary(units: DataFrame, keys: Keys = Keys()) -> DataFrame:
    return units.groupBy(keys.domain, "method").agg(
        F.count(F.lit(1)).alias("units"),
        F.avg("mae").alias("unit_macro_mae"),
        F.avg("rmse").alias("unit_macro_rmse"),
        F.max("mae").alias("worst_unit_mae"),
        F.avg("increase_fraction").alias("mean_increase_fraction"),
        F.max("maximum_increase").alias("maximum_increase"),
    )


def overall_summary(domains: DataFrame) -> DataFrame:
    return domains.groupBy("method").agg(
        F.count(F.lit(1)).alias("domains"),
        F.avg("unit_macro_mae").alias("domain_equal_mae"),
        F.avg("unit_macro_rmse").alias("domain_equal_rmse"),
        F.max("unit_macro_mae").alias("worst_domain_mae"),
    )


def domain_contrast(
    domains: DataFrame, method: str, baseline: str, keys: Keys = Keys(),
    value: str = "unit_macro_mae",
) -> DataFrame:
    """One row per domain: metric of ``method`` minus metric of ``baseline``."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col(value)))
    return (
        domains.filter(F.col("method").isin(method, baseline))
        .groupBy(keys.domain)
        .agg((pick(method) - pick(baseline)).alias("difference"))
    )


def win_tie_loss(difference: str | Column = "difference", tolerance: float = TOLERANCE):
    d = F.col(difference) if isinstance(difference, str) else difference
    return [
        F.count_if(d < -tolerance).alias("wins"),
        F.count_if(F.abs(d) <= tolerance).alias("ties"),
        F.count_if(d > tolerance).alias("losses"),
    ]


def contrast_summary(contrast: DataFrame, group: list[str] | None = None) -> DataFrame:
    return contrast.groupBy(*(group or [])).agg(
        F.avg("difference").alias("mean_difference"),
        F.max("difference").alias("maximum_harm"),
        F.min("difference").alias("maximum_gain"),
        *win_tie_loss(),
    )


def difference_map(contrast: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Per-domain differences as one MAP (domains are few; sorted for stable text)."""
    entries = F.array_sort(F.collect_list(F.struct(keys.domain, "difference")))
    return contrast.agg(F.map_from_entries(entries).alias("per_domain_difference"))


def estimand_ladder(
    df: DataFrame, method: str, baseline: str, truth: str = "truth", keys: Keys = Keys()
) -> DataFrame:
    """Record-, unit- and domain-equal mean differences plus unit and domain medians.

    Everything comes from one per-unit aggregate: sums and counts for the record level,
    means for the unit level.
    """
    gap = F.abs(F.col(method) - F.col(truth)) - F.abs(F.col(baseline) - F.col(truth))
    units = durable(
        df.groupBy(*keys.group).agg(
            F.sum(gap).alias("gap_sum"), F.count(gap).alias("n"), F.avg(gap).alias("gap")
        )
    )
    domains = units.groupBy(keys.domain).agg(
        F.sum("gap_sum").alias("gap_sum"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("units"),
        F.sum("gap").alias("unit_gap_sum"), F.avg("gap").alias("gap"),
    )
    top = domains.agg(
        (F.sum("gap_sum") / F.sum("n")).alias("record_equal"),
        (F.sum("unit_gap_sum") / F.sum("units")).alias("unit_equal"),
        F.avg("gap").alias("domain_equal"),
        F.percentile("gap", 0.5).alias("median_domain"),
    )
    median = exact_quantiles(units.withColumn("_all", F.lit(1)), ["_all"], "gap", [0.5])
    both = top.unionByName(
        median.select(F.col("quantile").alias("median_unit")), allowMissingColumns=True
    )
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def row_weights(
    df: DataFrame, keys: Keys = Keys(), scale: str = "sum_one", out: str = "weight"
) -> DataFrame:
    """Weight of a record: domains, then units, then records share equally.

    ``sum_one``: weights add to 1.  ``mean_one``: they average to 1.
    """
    if scale not in ("sum_one", "mean_one"):
        raise ValueError("scale must be sum_one or mean_one")
    units = df.groupBy(*keys.group).agg(F.count(F.lit(1)).alias("_rows"))
    domains = units.groupBy(keys.domain).agg(
        F.count(F.lit(1)).alias("_units"), F.sum("_rows").alias("_domain_rows")
    )
    everything = Window.partitionBy()
    # One row per domain: an unpartitioned window over it is as small as the domain list.
    domains = domains.withColumn("_domains", F.count(F.lit(1)).over(everything)).withColumn(
        "_all_rows", F.sum("_domain_rows").over(everything)
    )
    weight = 1.0 / (F.col("_domains") * F.col("_units") * F.col("_rows"))
    if scale == "mean_one":
        weight = weight * F.col("_all_rows")
    per_unit = units.join(domains, keys.domain).select(*keys.group, weight.alias(out))
    return df.join(per_unit, keys.group)


def budget_feasible_shift(
    df: DataFrame, state: str, budget: float, truth: str = "truth", keys: Keys = Keys()
) -> DataFrame:
    """Best constant shift of the state: weighted median residual, clipped to the budget."""
    residual = row_weights(df, keys).withColumn("_r", F.col(truth) - F.col(state))
    median = weighted_median(residual.withColumn("_all", F.lit(1)), ["_all"], "_r", "weight")
    shift = F.least(F.greatest(F.col("weighted_median"), F.lit(-budget)), F.lit(budget))
    return median.select("weighted_median", shift.alias("selected_shift"))


def quantile_profile(df: DataFrame, group: list[str], value: str, caps: list[float]) -> DataFrame:
    """Minimum, median, upper quantiles, maximum and share above each cap, per group."""
    above = [
        F.avg((F.col(value) > cap).cast("double")).alias(f"above_{str(cap).replace('.', '_')}")
        for cap in caps
    ]
    ends = df.groupBy(*group).agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"), *above)
    q = exact_quantiles(df, group, value, [0.5, 0.95, 0.99])
    wide = q.groupBy(*group).pivot("prob", [0.5, 0.95, 0.99]).agg(F.first("quantile"))
    wide = wide.toDF(*group, "median", "q95", "q99")
    return ends.join(wide, group)


def certificate(
    t: Trajectories, state: str, output: str, truth: str, budget: float,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row: largest displacement, regret and increase, range, and violation counts."""
    t = with_previous(t, {"_before": output})
    moved = F.abs(F.col(output) - F.col(state))
    regret = F.abs(F.col(output) - F.col(truth)) - F.abs(F.col(state) - F.col(truth))
    units = t.frame.groupBy(*t.keys.group).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(moved).alias("displacement"),
        F.max(regret).alias("regret"),
        F.coalesce(F.max(F.col(output) - F.col("_before")), F.lit(0.0)).alias("increase"),
        F.min(output).alias("low"),
        F.max(output).alias("high"),
        F.count_if(moved > budget + tolerance).alias("over"),
    )
    return units.agg(
        F.sum("n").alias("records"),
        F.count(F.lit(1)).alias("units"),
        F.max("displacement").alias("maximum_displacement"),
        F.max("regret").alias("maximum_regret"),
        F.greatest(F.max("increase"), F.lit(0.0)).alias("maximum_increase"),
        F.min("low").alias("minimum_output"),
        F.max("high").alias("maximum_output"),
        F.sum("over").alias("violating_records"),
        F.count_if(F.col("over") > 0).alias("violating_units"),
        F.countDistinct(F.when(F.col("over") > 0, F.col(t.keys.domain))).alias("violating_domains"),
    )


def regret_bounds(units: DataFrame, method: str, state: str, keys: Keys = Keys()) -> DataFrame:
    """Largest unit-level and domain-level loss increase of a method over the state."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("mae")))
    gaps = (
        units.filter(F.col("method").isin(method, state))
        .groupBy(*keys.group)
        .agg((pick(method) - pick(state)).alias("gap"))
    )
    domains = gaps.groupBy(keys.domain).agg(
        F.max("gap").alias("worst_unit"), F.avg("gap").alias("gap")
    )
    return domains.agg(
        F.max("worst_unit").alias("maximum_unit_harm"), F.max("gap").alias("maximum_domain_harm")
    )


def transition_metrics(
    t: Trajectories, methods: list[str], allowance: str | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rises between neighbouring outputs, per method; optional allowance envelope excess."""
    t = with_previous(t, {f"{m}__before": m for m in methods})
    aggs, fields = [], ["positive", "total", "affected", "highest", "excess"]
    for m in methods:
        move = F.col(m) - F.col(f"{m}__before")
        spare = move - F.col(allowance) if allowance else F.lit(None).cast("double")
        aggs += [
            F.count_if(move > tolerance).alias(f"{m}__positive"),
            F.count(move).alias(f"{m}__total"),
            F.max((move > tolerance).cast("int")).alias(f"{m}__affected"),
            F.max(move).alias(f"{m}__highest"),
            F.max(spare).alias(f"{m}__excess"),
        ]
    units = _method_rows(t.frame.groupBy(*t.keys.group).agg(*aggs), t.keys.group, methods, fields)
    return units.groupBy("method").agg(
        F.sum("positive").alias("positive_transitions"),
        F.sum("total").alias("total_transitions"),
        (F.sum("positive") / F.sum("total")).alias("positive_fraction"),
        F.sum(F.coalesce("affected", F.lit(0))).cast("bigint").alias("affected_units"),
        F.greatest(F.max("highest"), F.lit(0.0)).alias("maximum_increase"),
        F.max("excess").alias("maximum_envelope_excess"),
    )


def leave_one_out(contrast: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Mean difference with each domain left out (one row per domain, no self join)."""
    everything = Window.partitionBy()
    total, n = F.sum("difference").over(everything), F.count(F.lit(1)).over(everything)
    return contrast.select(
        F.col(keys.domain).alias("omitted_domain"),
        (n - 1).alias("retained_domains"),
        F.when(n > 1, (total - F.col("difference")) / (n - 1)).alias("mean_difference"),
    )


def largest_domain_sensitivity(domains: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Mean difference without the domain that has most units, and most records.

    ``domains`` has one row per domain: units, records, difference.
    """
    by_units = F.max(F.struct("units", "records", keys.domain))
    by_records = F.max(F.struct("records", "units", keys.domain))
    n, total = F.count(F.lit(1)), F.sum("difference")
    lookup = F.map_from_entries(F.collect_list(F.struct(keys.domain, "difference")))
    largest_units, largest_records = by_units[keys.domain], by_records[keys.domain]
    return domains.agg(
        largest_units.alias("largest_by_units"),
        ((total - F.element_at(lookup, largest_units)) / (n - 1)).alias("without_largest_by_units"),
        largest_records.alias("largest_by_records"),
        ((total - F.element_at(lookup, largest_records)) / (n - 1)).alias(
            "without_largest_by_records"
        ),
    )


def path_area(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Trapezoid area of y over x, divided by the largest x."""
    w = Window.partitionBy(*group).orderBy(x)
    stepped = df.withColumns({"_x0": F.lag(x).over(w), "_y0": F.lag(y).over(w)})
    area = 0.5 * (F.col(y) + F.col("_y0")) * (F.col(x) - F.col("_x0"))
    return stepped.groupBy(*group).agg((F.sum(area) / F.max(x)).alias("normalised_area"))


def factorial_effects(domains: DataFrame, arms: dict[str, str], value: str, keys: Keys = Keys()):
    """2x2 effects per domain: feature and weighting main effects and their interaction.

    ``arms`` names the methods of the four cells: raw_pooled, raw_equal, change_pooled,
    change_equal.
    """
    wide = domains.groupBy(keys.domain).agg(
        *[F.max(F.when(F.col("method") == m, F.col(value))).alias(a) for a, m in arms.items()]
    )
    rp, re, cp, ce = (F.col(a) for a in ("raw_pooled", "raw_equal", "change_pooled", "change_equal"))
    effects = {
        "feature_under_pooled": cp - rp,
        "feature_under_equal": ce - re,
        "weighting_with_raw": re - rp,
        "weighting_with_change": ce - cp,
        "interaction": ce - cp - re + rp,
    }
    rows = [F.struct(F.lit(k).alias("effect"), v.alias("difference")) for k, v in effects.items()]
    return wide.select(keys.domain, F.inline(F.array(*rows)))


def condition_means(
    units: DataFrame, conditions: list[str], value: str, label: str = "condition"
) -> DataFrame:
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in conditions])
    return units.groupBy(key.alias(label)).agg(
        F.count(F.lit(1)).alias("units"), F.avg(value).alias("mean_value")
    )


def unit_profile(df: DataFrame, keys: Keys, value: str, reason: str) -> DataFrame:
    """Per unit: first/last/extreme values, valid and invalid counts, reason counter map."""
    order = F.struct(*keys.order)
    counts = df.groupBy(*keys.group, reason).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(order, F.col(value))).alias("first"),
        F.max(F.struct(order, F.col(value))).alias("last"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    # One row per (unit, reason) remains: reasons are a fixed short list.
    valid = F.col(reason).isNull()
    entries = F.array_sort(
        F.collect_list(F.when(~valid, F.struct(F.col(reason), F.col("n"))))
    )
    return counts.groupBy(*keys.group).agg(
        F.min(F.when(valid, F.col("first")))[value].alias("first_value"),
        F.max(F.when(valid, F.col("last")))[value].alias("last_value"),
        F.min(F.when(valid, F.col("low"))).alias("minimum_value"),
        F.max(F.when(valid, F.col("high"))).alias("maximum_value"),
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid_records"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("invalid_records"),
        F.map_from_entries(entries).alias("reasons"),
    )


def unit_size_profile(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Per domain: number of units and smallest, median and largest unit."""
    units = df.groupBy(*keys.group).agg(F.count(F.lit(1)).alias("n"))
    # Sizes repeat, so the exact median runs over distinct sizes with their frequency.
    sizes = units.groupBy(keys.domain, "n").agg(F.count(F.lit(1)).alias("times"))
    return sizes.groupBy(keys.domain).agg(
        F.sum("times").alias("units"),
        F.min("n").alias("minimum_records"),
        F.percentile("n", 0.5, F.col("times")).alias("median_records"),
        F.max("n").alias("maximum_records"),
    )
