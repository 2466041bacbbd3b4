"""Ordered operators: ranks, neighbours, running extremes and sums, blocks and gaps.

Each one is a plain Spark window while units are short.  For cut units the same
window runs per piece and a carried value from earlier pieces completes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from railguard.operators.layout import PIECE, Keys, Trajectories
from railguard.session import durable

_CARRY = "_carry_"


def with_rank(t: Trajectories, name: str = "rank") -> Trajectories:
    """1-based position of a record inside its unit."""
    ranked = t.frame.withColumn(name, F.row_number().over(t.window()).cast("bigint"))
    if t.cut:
        carried = t.carry({"n": F.count(F.lit(1))}, {_CARRY: F.sum("n")})
        ranked = (
            t.join_carry(ranked, carried)
            .withColumn(name, F.col(name) + F.coalesce(F.col(_CARRY), F.lit(0)))
            .drop(_CARRY)
        )
    return t.with_frame(ranked)


def with_previous(t: Trajectories, columns: dict[str, str], step: int = 1) -> Trajectories:
    """Value of the neighbouring record: ``step=1`` the one before, ``step=-1`` the one after."""
    if step not in (1, -1):
        raise ValueError("step must be 1 or -1")
    shift = F.lag if step == 1 else F.lead
    w = t.window()
    frame = t.frame.withColumns({out: shift(col).over(w) for out, col in columns.items()})
    if not t.cut:
        return t.with_frame(frame)
    order = F.struct(*t.keys.order)
    value = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns.values())])
    edge = F.max_by(value, order) if step == 1 else F.min_by(value, order)
    pieces = t.frame.groupBy(*t.part).agg(edge.alias("edge"))
    long_units = pieces.filter(F.col(PIECE) > 0).select(*t.keys.group).distinct()
    neighbours = (
        pieces.join(F.broadcast(long_units), t.keys.group, "left_semi")
        .withColumn(
            _CARRY, shift("edge").over(Window.partitionBy(*t.keys.group).orderBy(PIECE))
        )
        .drop("edge")
    )
    at_edge = (
        F.row_number().over(w) == 1
        if step == 1
        else F.lead(F.lit(1)).over(w).isNull()
    )
    frame = t.join_carry(frame.withColumn("_edge", at_edge), neighbours)
    return t.with_frame(
        frame.withColumns(
            {
                out: F.when(F.col("_edge"), F.col(f"{_CARRY}.v{i}")).otherwise(F.col(out))
                for i, out in enumerate(columns)
            }
        ).drop("_edge", _CARRY)
    )


def with_next(t: Trajectories, columns: dict[str, str]) -> Trajectories:
    return with_previous(t, columns, step=-1)


_RUNNING = {
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def with_running(t: Trajectories, columns: dict[str, tuple[str, Column]]) -> Trajectories:
    """Running ``min``/``max``/``sum`` of an expression over the records seen so far."""
    w = t.running()
    frame = t.frame.withColumns(
        {out: _RUNNING[how][0](expr).over(w) for out, (how, expr) in columns.items()}
    )
    if t.cut:
        carried = t.carry(
            {f"s_{out}": _RUNNING[how][0](expr) for out, (how, expr) in columns.items()},
            {f"{_CARRY}{out}": _RUNNING[how][0](f"s_{out}") for out, (how, _) in columns.items()},
        )
        frame = t.join_carry(frame, carried)
        frame = frame.withColumns(
            {
                out: _RUNNING[how][1](F.col(out), F.col(f"{_CARRY}{out}"))
                for out, (how, _) in columns.items()
            }
        ).drop(*[f"{_CARRY}{out}" for out in columns])
    return t.with_frame(frame)


#: Bits behind the point of the two whole-number limbs of an exact sum.
_HIGH_BITS, _LOW_BITS = 20, 50


def with_exact_sum(t: Trajectories, out: str, value: Column) -> Trajectories:
    """Running sum that is the same to the last bit wherever a unit is cut.

    A value becomes two whole numbers, of 2^-20 and of 2^-50 (what is smaller is cut off per
    record, about 1e-15); whole numbers add up exactly in any order. Billions of records of
    values up to a few thousand fit; beyond, the job stops instead of wrapping around.
    """
    scaled = value.cast("double") * float(1 << _HIGH_BITS)
    high = F.floor(scaled)
    low = F.floor((scaled - high) * float(1 << (_LOW_BITS - _HIGH_BITS)))
    t = with_running(t, {"_high": ("sum", high.cast("bigint")), "_low": ("sum", low.cast("bigint"))})
    total = F.col("_high") / float(1 << _HIGH_BITS) + F.col("_low") / float(1 << _LOW_BITS)
    return t.with_frame(t.frame.withColumn(out, total).drop("_high", "_low"))


def first_records(df: DataFrame, keys: Keys, count: int) -> DataFrame:
    """The first ``count`` records of every unit with their 1-based ``rank``.

    ``row_number`` under a constant bound lets Spark keep only ``count`` rows per unit
    in each map task before the shuffle, so a huge unit costs no more than a small one.
    """
    w = Window.partitionBy(*keys.group).orderBy(*keys.order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= count)


def first_records_median(
    df: DataFrame, keys: Keys, columns: list[str], count: int = 5, prefix: str = "reference_"
) -> DataFrame:
    """Per-unit median over the commissioning window (first ``count`` records)."""
    # At most ``count`` values per unit reach the aggregate, so exact percentiles are cheap.
    return (
        first_records(df, keys, count)
        .groupBy(*keys.group)
        .agg(*[F.percentile(c, 0.5).alias(f"{prefix}{c}") for c in columns])
    )


def numbered_by_range(df: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
    """0-based number of each row inside its group, whatever the group's size or key type.

    Rows are spread by range, written once, and numbered per stored slice; the counts of
    earlier slices are added.  No task orders more than its own slice.
    """
    columns = [*group, order]
    sliced = durable(
        df.repartitionByRange(*[F.col(c) for c in columns]).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        *group, "_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    local = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(order)) - 1
    return (
        sliced.withColumn("_local", local)
        .join(offsets, [*group, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("bigint"))
        .drop("_local", "_offset", "_slice")
    )


def with_occurrence_id(t: Trajectories, prefix: str = "EXT") -> Trajectories:
    """0-based ordinal of a row within its key plus a zero-padded synthetic record id."""
    ranked = with_rank(t, "within_key_ordinal").frame
    ordinal = F.col("within_key_ordinal") - 1
    return t.with_frame(
        ranked.withColumn("within_key_ordinal", ordinal).withColumn(
            "record_id", F.format_string(f"{prefix}-%05d", F.col("within_key_ordinal"))
        )
    )


def elapsed_with_resets(
    t: Trajectories, time: str, out: str = "elapsed", cap: float = 3600.0
) -> Trajectories:
    """Cumulative seconds; a clock that jumps back restarts from its new reading."""
    t = with_previous(t, {"_before": time})
    step = F.col(time) - F.col("_before")
    gained = F.when(step >= 0, step).otherwise(F.greatest(F.col(time), F.lit(0.0)))
    gained = F.when(F.col("_before").isNull(), 0.0).otherwise(
        F.least(F.greatest(gained, F.lit(0.0)), F.lit(cap))
    )
    t = t.with_frame(t.frame.withColumn("_gain", gained))
    t = with_exact_sum(t, out, F.col("_gain"))
    return t.with_frame(t.frame.drop("_before", "_gain"))


def cumulative_charge(
    t: Trajectories, elapsed: str, current: str, out: str = "charge", cap: float = 3600.0
) -> Trajectories:
    """Trapezoid integral of current over time in ampere-hours, steps clipped to [0, cap]."""
    t = with_previous(t, {"_t0": elapsed, "_i0": current})
    dt = F.least(F.greatest(F.col(elapsed) - F.col("_t0"), F.lit(0.0)), F.lit(cap))
    area = F.coalesce(0.5 * (F.col("_i0") + F.col(current)) * dt / 3600.0, F.lit(0.0))
    t = t.with_frame(t.frame.withColumn("_area", area))
    t = with_exact_sum(t, out, F.col("_area"))
    return t.with_frame(t.frame.drop("_t0", "_i0", "_area"))


def with_block(t: Trajectories, active: Column, out: str = "block") -> Trajectories:
    """Number contiguous runs of active records (1, 2, ...); inactive records get NULL."""
    t = t.with_frame(t.frame.withColumn("_on", active.cast("int")))
    t = with_previous(t, {"_was_on": "_on"})
    starts = (F.col("_on") == 1) & (F.coalesce(F.col("_was_on"), F.lit(0)) == 0)
    t = t.with_frame(t.frame.withColumn("_start", starts.cast("bigint")))
    t = with_running(t, {out: ("sum", F.col("_start"))})
    return t.with_frame(
        t.frame.withColumn(out, F.when(F.col("_on") == 1, F.col(out))).drop(
            "_on", "_was_on", "_start"
        )
    )


def trim_to_first(t: Trajectories, starts: Column) -> Trajectories:
    """Drop everything before the first record of a unit where ``starts`` holds."""
    t = t.with_frame(t.frame.withColumn("_hit", starts.cast("int")))
    t = with_running(t, {"_seen": ("max", F.col("_hit"))})
    return t.with_frame(t.frame.filter(F.col("_seen") == 1).drop("_hit", "_seen"))


def first_seen_order(df: DataFrame, scope: list[str], key: str, position: str) -> DataFrame:
    """Keys of each scope numbered by where they first appear."""
    firsts = df.groupBy(*scope, key).agg(F.min(position).alias("first_position"))
    w = Window.partitionBy(*scope).orderBy("first_position")
    return firsts.withColumn("source_order", F.row_number().over(w).cast("bigint"))


def with_unit_rows(t: Trajectories, out: str = "unit_rows") -> Trajectories:
    """Number of records of the unit on every record."""
    if not t.cut:
        counted = F.count(F.lit(1)).over(Window.partitionBy(*t.keys.group))
        return t.with_frame(t.frame.withColumn(out, counted))
    sizes = t.frame.groupBy(*t.keys.group).agg(F.count(F.lit(1)).alias(out))
    return t.with_frame(t.frame.join(sizes, t.keys.group))


def prefix_part(t: Trajectories, fraction: float = 0.5, rank: str = "rank") -> Trajectories:
    """Leading ``floor(fraction * n)`` records of each unit, at least one."""
    sized = with_unit_rows(t, "_n")
    keep = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    return t.with_frame(sized.frame.filter(F.col(rank) <= keep).drop("_n"))


def evenly_spaced(t: Trajectories, cap: int, rank: str = "rank") -> DataFrame:
    """At most ``cap`` records per unit, spread evenly with both ends kept.

    This is a sampling operator: the cap is its purpose.  Target positions are the
    half-even rounded points ``i * (n - 1) / (cap - 1)``, joined back by position.
    """
    sizes = t.frame.groupBy(*t.keys.group).agg(F.count(F.lit(1)).alias("_n"))
    step = (F.col("_n") - 1).cast("double") / F.lit(float(cap - 1))
    points = F.when(
        F.col("_n") <= cap,
        F.transform(F.sequence(F.lit(0), F.col("_n").cast("int") - 1), lambda i: i.cast("bigint")),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(cap - 1)),
            lambda i: F.rint(i.cast("double") * step).cast("bigint"),
        )
    )
    places = F.transform(F.array_distinct(points), lambda i: i + 1)
    wanted = sizes.select(*t.keys.group, F.explode(places).alias(rank))
    return t.frame.join(wanted, [*t.keys.group, rank], "left_semi")
