"""Fail-closed contracts: each returns the violating rows; ``enforce`` raises if any exist."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from railguard.functions.columns import TOLERANCE, is_finite
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.ordering import first_records, with_previous


class ContractViolation(ValueError):
    """Raised when a table breaks a declared contract."""


def enforce(violations: DataFrame, name: str) -> None:
    sample = violations.limit(5).collect()  # for the message only
    if sample:
        raise ContractViolation(f"{name}: {[r.asDict() for r in sample]}")


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Keep exactly the required columns; raises (without a job) if some are missing."""
    required = list(required)
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractViolation(f"missing columns {missing}")
    return df.select(*required)


def forbid_columns(columns: Iterable[str], forbidden: Iterable[str]) -> None:
    """Model contract: no outcome column among the features and no duplicate names."""
    columns = list(columns)
    if len(set(columns)) != len(columns):
        raise ContractViolation("duplicate feature names")
    leaked = sorted(set(columns) & set(forbidden))
    if leaked:
        raise ContractViolation(f"outcome columns among the features {leaked}")


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column with its number of NULL, NaN or infinite values."""
    counts = df.agg(*[F.count_if(~is_finite(c)).alias(c) for c in columns])
    return _tall(counts, columns).filter(F.col("violations") > 0)


def _tall(one_row: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in columns]
    return one_row.select(F.inline(F.array(*pairs)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return duplicate_keys(df, df.columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def shared_units(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Unit ids that occur in more than one domain."""
    # Distinct pairs first: the second aggregate sees one row per unit and domain.
    return (
        df.select(keys.domain, keys.unit)
        .distinct()
        .groupBy(keys.unit)
        .agg(F.count(F.lit(1)).alias("domains"))
        .filter(F.col("domains") > 1)
    )


def blank_ids(df: DataFrame, column: str) -> DataFrame:
    text = F.trim(F.col(column).cast("string"))
    return df.filter(text.isNull() | (text == "") | (F.lower(text) == "nan"))


def roster_counts(df: DataFrame, keys: Keys = Keys()) -> DataFrame:
    """Exact numbers of domains, units and records, built from per-unit counts."""
    units = df.groupBy(*keys.group).agg(F.count(F.lit(1)).alias("n"))
    return units.agg(
        F.countDistinct(keys.domain).alias("domains"),
        F.count(F.lit(1)).alias("units"),
        F.sum("n").alias("records"),
    )


def roster_mismatch(df: DataFrame, expected: Mapping[str, int], keys: Keys = Keys()) -> DataFrame:
    counts = roster_counts(df, keys)
    wrong = [F.col(k) != F.lit(v) for k, v in expected.items()]
    bad = wrong[0]
    for more in wrong[1:]:
        bad = bad | more
    return counts.filter(bad)


def roster_differences(
    long: DataFrame, method: str, methods: list[str], keys: list[str], value: str
) -> DataFrame:
    """Keys whose set of methods, or whose value across methods, is not complete and equal.

    One aggregate compares all methods at once instead of one set difference per method.
    """
    return (
        long.groupBy(*keys)
        .agg(
            F.size(F.collect_set(method)).cast("bigint").alias("methods"),
            F.count(F.lit(1)).alias("rows"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
        .filter(
            (F.col("methods") != len(methods))
            | (F.col("rows") != len(methods))
            | ~F.col("low").eqNullSafe(F.col("high"))
        )
    )


def varying_values(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Groups in which a declared constant takes more than one value."""
    return (
        df.groupBy(*group)
        .agg(F.min(column).alias("low"), F.max(column).alias("high"))
        .filter(~F.col("low").eqNullSafe(F.col("high")))
    )


def state_violations(
    t: Trajectories, state: str, y_min: float, y_max: float, tolerance: float = TOLERANCE
) -> DataFrame:
    """Records whose protected state leaves the range or rises."""
    t = with_previous(t, {"before": state})
    b = F.col(state)
    outside = (b < y_min - tolerance) | (b > y_max + tolerance)
    rises = F.coalesce(b - F.col("before") > tolerance, F.lit(False))
    return t.frame.filter(outside | rises).withColumn(
        "reason", F.when(outside, "outside_range").otherwise("increases")
    )


def missing_anchors(df: DataFrame, keys: Keys = Keys(), count: int = 5) -> DataFrame:
    """Units with fewer than ``count`` commissioning records."""
    return (
        first_records(df, keys, count)
        .groupBy(*keys.group)
        .agg(F.count(F.lit(1)).alias("anchors"))
        .filter(F.col("anchors") < count)
    )


def bad_schedule(df: DataFrame, columns: Mapping[str, bool]) -> DataFrame:
    """Rows with an invalid schedule value; the flag asks for strictly positive values."""
    bad: Column = F.lit(False)
    for name, positive in columns.items():
        low = (F.col(name) <= 0) if positive else (F.col(name) < 0)
        bad = bad | ~is_finite(name) | low
    return df.filter(bad)


def label_blind(df: DataFrame, outcome_columns: Iterable[str]) -> DataFrame:
    """Prediction-stage contract: fails as soon as an outcome column is present."""
    forbid_columns(df.columns, outcome_columns)
    return df
