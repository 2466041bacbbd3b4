"""Equi-joins whose cardinality is part of their meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from railguard.operators.contracts import duplicate_keys, enforce
from railguard.operators.layout import Trajectories
from railguard.operators.ordering import with_next


def complete_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner one-to-one join that must match every row of both sides (eager checks).

    One aggregate over both key sets finds duplicates and unmatched keys together.
    """
    sides = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    bad = sides.groupBy(*keys).agg(F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"))
    enforce(bad.filter((F.col("left_rows") != 1) | (F.col("right_rows") != 1)), "one-to-one join")
    return left.join(right, keys)


def lookup(
    df: DataFrame, table: DataFrame, keys: list[str], *, required: bool = True
) -> DataFrame:
    """Many-to-one left join of parameters; optionally no row may miss its parameter."""
    enforce(duplicate_keys(table, keys), "lookup keys")
    values = [c for c in table.columns if c not in keys]
    side = table.withColumn("_found", F.lit(True))
    # Whether the side is broadcast is left to the adaptive planner, which knows its size.
    joined = df.join(side, keys, "left")
    if not required:
        return joined.drop("_found")
    message = F.concat(F.lit("no parameter for "), F.concat_ws("/", *keys))
    checked = F.when(F.col("_found").isNull(), F.raise_error(message).cast("boolean"))
    # A harmless reference keeps the check alive through column pruning.
    first = values[0]
    return joined.withColumn(
        first, F.when(F.coalesce(checked, F.lit(True)), F.col(first))
    ).drop("_found")


def label_join(df: DataFrame, labels: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Left label join, then keep finite positive labels only."""
    y = F.col(label).cast("double")
    return df.join(labels, keys, "left").filter(
        y.isNotNull() & ~F.isnan(y) & (y > 0) & (y < F.lit(float("inf")))
    )


def keep_units(df: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(units.select(*keys), keys, "left_semi")


def drop_units(df: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(units.select(*keys), keys, "left_anti")


def align_labels(
    t: Trajectories, label: str, lead_first: set[str], out: str = "target"
) -> Trajectories:
    """Label of the next record for the listed domains, of the same record elsewhere.

    The shift happens on the recorded order, before any filter removes records.
    """
    shifted = with_next(t, {"_next": label})
    leads = F.col(t.keys.domain).isin(*sorted(lead_first))
    value = F.when(leads, F.col("_next")).otherwise(F.col(label))
    return t.with_frame(shifted.frame.withColumn(out, value).drop("_next"))


def pair_forward(
    t: Trajectories, kind: str, opener: str, closer: str, columns: list[str]
) -> DataFrame:
    """Pair each opener with the first closer before the next opener (as-of forward join).

    Only openers and closers matter, and an opener pairs exactly when the next of them is
    a closer, so one neighbour lookup over the filtered records replaces any range join.
    """
    events = t.with_frame(t.frame.filter(F.col(kind).isin(opener, closer)))
    following = {f"next_{c}": c for c in [kind, *columns]}
    paired = with_next(events, following).frame
    return paired.filter((F.col(kind) == opener) & (F.col(f"next_{kind}") == closer)).drop(
        f"next_{kind}"
    )


def compare_tables(
    left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float
) -> DataFrame:
    """Full outer comparison: status per key and the largest absolute difference."""
    a = left.select(*keys, *[F.col(v).alias(f"{v}_left") for v in values], F.lit(1).alias("_l"))
    b = right.select(*keys, *[F.col(v).alias(f"{v}_right") for v in values], F.lit(1).alias("_r"))
    gaps = [
        F.when(F.col(f"{v}_left").eqNullSafe(F.col(f"{v}_right")), 0.0).otherwise(
            F.abs(F.col(f"{v}_left") - F.col(f"{v}_right"))
        )
        for v in values
    ]
    gap = gaps[0] if len(gaps) == 1 else F.greatest(*gaps)
    return (
        a.join(b, keys, "full_outer")
        .withColumn("max_difference", gap)
        .withColumn(
            "status",
            F.when(F.col("_l").isNull(), "right_only")
            .when(F.col("_r").isNull(), "left_only")
            .when(F.col("max_difference") <= tolerance, "equal")
            .otherwise("different"),
        )
        .drop("_l", "_r")
    )


