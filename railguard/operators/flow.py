"""Which records take part: active stages, eligibility with reasons, sample-flow ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railguard.operators.layout import Keys
from railguard.operators.ordering import first_records


def active_stage(current: str | Column, threshold: float) -> Column:
    """Sign of the first current reading that reaches the threshold: charge or discharge."""
    active = F.filter(current, lambda v: F.abs(v) >= threshold)
    first = F.get(active, F.lit(0))
    return (
        F.when(first.isNull(), "inactive").when(first > 0, "charge").otherwise("discharge")
    )


def eligibility(
    df: DataFrame, keys: Keys, label: str, reference_range: tuple[float, float],
    minimum_records: int, anchors: int = 5,
) -> DataFrame:
    """One row per unit with the first failing reason, or NULL when it is eligible.

    The reference is the median label of the commissioning window; scored records are
    those after it.
    """
    sizes = df.groupBy(*keys.group).agg(F.count(F.lit(1)).alias("records"))
    references = first_records(df, keys, anchors).groupBy(*keys.group).agg(
        F.count(F.lit(1)).alias("anchors"), F.percentile(label, 0.5).alias("reference")
    )
    low, high = reference_range
    reason = (
        F.when(F.col("anchors") < anchors, "anchor_missing")
        .when(~F.col("reference").between(low, high), "reference_out_of_range")
        .when(F.col("records") - anchors < minimum_records, "too_few_records")
    )
    return sizes.join(references, keys.group).withColumn("reason", reason)


def sample_flow(
    df: DataFrame, keys: Keys, units: DataFrame, anchors: int = 5
) -> DataFrame:
    """Counts per domain at each stage: raw, anchors, excluded with reasons, scored.

    ``units`` is an eligibility table.  All counts follow from it, so the record table
    is read once.
    """
    eligible = F.col("reason").isNull()
    anchor_rows = F.least(F.col("records"), F.lit(anchors).cast("bigint"))
    counted = units.groupBy(keys.domain, "reason").agg(
        F.count(F.lit(1)).alias("u"),
        F.sum("records").alias("r"),
        F.sum(anchor_rows).alias("a"),
    )
    reasons = F.array_sort(
        F.collect_list(F.when(~eligible, F.concat_ws("=", "reason", F.col("u").cast("string"))))
    )
    zero = F.lit(0).cast("bigint")
    return counted.groupBy(keys.domain).agg(
        F.sum("u").alias("raw_units"),
        F.sum("r").alias("raw_records"),
        F.coalesce(F.sum(F.when(eligible, F.col("u"))), zero).alias("eligible_units"),
        F.coalesce(F.sum(F.when(~eligible, F.col("u"))), zero).alias("excluded_units"),
        F.coalesce(F.sum(F.when(~eligible, F.col("r"))), zero).alias("excluded_records"),
        F.coalesce(F.sum(F.when(eligible, F.col("a"))), zero).alias("anchor_records"),
        F.coalesce(F.sum(F.when(eligible, F.col("r") - F.col("a"))), zero).alias("scored_records"),
        F.concat_ws(";", reasons).alias("exclusion_reasons"),
    )


def unreconciled(flow: DataFrame) -> DataFrame:
    """Rows of a flow ledger whose stages do not add up."""
    return flow.filter(
        (F.col("raw_units") != F.col("eligible_units") + F.col("excluded_units"))
        | (
            F.col("raw_records")
            != F.col("excluded_records") + F.col("anchor_records") + F.col("scored_records")
        )
    )
