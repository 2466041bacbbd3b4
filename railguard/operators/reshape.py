"""Reshaping and set operations: unpivot, pivot, union of arms, top-1, roster sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def methods_to_rows(
    df: DataFrame, ids: list[str], methods: list[str], name: str = "method",
    value: str = "prediction",
) -> DataFrame:
    return df.select(*ids, *methods).unpivot(ids, methods, name, value)


def methods_to_columns(
    long: DataFrame, ids: list[str], methods: list[str], value: str, name: str = "method"
) -> DataFrame:
    """Explicit method names keep this one aggregation without a first pass for values."""
    return long.groupBy(*ids).pivot(name, methods).agg(F.first(value))


def union_arms(arms: dict[str, DataFrame], label: str = "arm") -> DataFrame:
    tagged = [df.withColumn(label, F.lit(name)) for name, df in arms.items()]
    return reduce(DataFrame.unionByName, tagged)


def top_one(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Best row of every group; the constant bound prunes in map tasks before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 1).drop("_n")


def remap(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace some values of a column (for example to merge two domains)."""
    new = F.col(column)
    for old, target in mapping.items():
        new = F.when(F.col(column) == old, F.lit(target)).otherwise(new)
    return df.withColumn(column, new)


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, tagged ``left_only`` or ``right_only``, in one shuffle."""
    both = left.select(*keys, F.lit(1).alias("side")).unionByName(
        right.select(*keys, F.lit(2).alias("side"))
    )
    return (
        both.groupBy(*keys)
        .agg(F.bit_or("side").alias("sides"))
        .filter(F.col("sides") != 3)
        .select(
            *keys,
            F.when(F.col("sides") == 1, "left_only").otherwise("right_only").alias("status"),
        )
    )
