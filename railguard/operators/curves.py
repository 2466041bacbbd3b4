"""Curve features: nested measurement arrays of one cycle to one fixed-width row.

Everything is an array expression on the row that holds the arrays, so feature
extraction needs no shuffle at all and parallelises over cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railguard.functions.arrays import array_mean, array_std, let, value_finite
from railguard.functions.columns import is_finite
from railguard.operators.layout import Keys
from railguard.operators.ordering import first_records

# The interpolation grid in seconds and the rejection reasons in test order.
GRID_SECONDS = [0, 60, 120, 180, 240, 300, 360, 420, 480, 540, 600]
REJECTIONS = [
    "misaligned_or_short_charge_arrays",
    "invalid_nominal_capacity",
    "no_positive_charge_increment",
    "insufficient_finite_charge_points",
    "charge_window_not_covered",
    "charge_window_interpolation_failed",
    "insufficient_points_in_charge_window",
    "nonpositive_early_charge_throughput",
]
STEP_CAP = 3600.0


def increments(values: Column) -> Column:
    """Differences of neighbouring elements."""
    n = F.size(values)
    return F.zip_with(F.slice(values, 2, n - 1), F.slice(values, 1, n - 1), lambda b, a: b - a)


def elapsed_array(times: Column) -> Column:
    """Cumulative seconds of a clock that may restart; each step lies in [0, 3600]."""

    def advance(acc, t):
        step = t - acc["last"]
        gain = F.when(step >= 0, step).otherwise(F.greatest(t, F.lit(0.0)))
        bounded = F.least(F.greatest(gain, F.lit(0.0)), F.lit(STEP_CAP))
        return let(
            acc["total"] + bounded,
            lambda total: F.struct(
                t.alias("last"), total.alias("total"),
                F.concat(acc["out"], F.array(total)).alias("out"),
            ),
        )

    start = F.struct(
        F.get(times, F.lit(0)).alias("last"), F.lit(0.0).alias("total"),
        F.array(F.lit(0.0)).alias("out"),
    )
    rest = F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0)))
    return F.aggregate(rest, start, advance)["out"]


def interpolate(x: Column, y: Column, grid: list[float]) -> Column:
    """Linear interpolation of (x, y) at ``grid``; x is non-decreasing, first y per x wins.

    One pass per grid point keeps the bracketing points: the last with x <= g and the
    first with x >= g.  Duplicate x never replaces an earlier point.
    """
    empty = F.lit(None).cast("struct<x:double,y:double>")

    def between(b, g):
        lo, hi = b["lo"], b["hi"]
        slope = (hi["y"] - lo["y"]) / (hi["x"] - lo["x"])
        return (
            F.when(lo.isNull(), hi["y"])
            .when(hi.isNull() | (hi["x"] == lo["x"]), lo["y"])
            .otherwise(slope * (g - lo["x"]) + lo["y"])
        )

    def locate(points, g):
        def seen(acc, p):
            closer = (p["x"] <= g) & (acc["lo"].isNull() | (p["x"] > acc["lo"]["x"]))
            reached = (p["x"] >= g) & acc["hi"].isNull()
            return F.struct(
                F.when(closer, p).otherwise(acc["lo"]).alias("lo"),
                F.when(reached, p).otherwise(acc["hi"]).alias("hi"),
            )

        start = F.struct(empty.alias("lo"), empty.alias("hi"))
        return let(F.aggregate(points, start, seen), lambda b: between(b, g))

    at = F.array(*[F.lit(float(g)) for g in grid])
    return let(
        F.arrays_zip(x.alias("x"), y.alias("y")),
        lambda points: F.transform(at, lambda g: locate(points, g)),
    )


def early_features(
    df: DataFrame, *, current: str, voltage: str, charge: str, time: str,
    temperature: str | None, nominal: float | Column, window_seconds: float = 600.0,
) -> DataFrame:
    """Add ``features`` (struct, NULL when rejected) and ``reason`` (first failing test)."""
    capacity = (nominal if isinstance(nominal, Column) else F.lit(float(nominal))).cast("double")
    window = F.lit(float(window_seconds))
    grid = [g * window_seconds / 600.0 for g in GRID_SECONDS]
    size = F.size(current)
    aligned = (
        (F.size(voltage) == size) & (F.size(charge) == size) & (F.size(time) == size) & (size >= 3)
    )
    first_reason = F.when(~F.coalesce(aligned, F.lit(False)), REJECTIONS[0]).when(
        ~is_finite(capacity) | (capacity <= 0), REJECTIONS[1]
    )
    floor = F.greatest(F.lit(1e-10), 1e-8 * capacity)
    rises = F.transform(
        increments(F.col(charge)), lambda s: F.coalesce(value_finite(s) & (s > floor), F.lit(False))
    )
    # 1-based position of the first rise; 0 when there is none or the arrays are unusable.
    start = F.when(first_reason.isNull(), F.array_position(rises, True)).otherwise(0).cast("int")

    def points(begin):
        tail = F.greatest(size - begin + 1, F.lit(0))
        cut = lambda c: F.slice(F.col(c), F.greatest(begin, F.lit(1)), tail)
        no_heat = F.transform(cut(current), lambda _: F.lit(None).cast("double"))
        heat = no_heat
        if temperature is not None:
            n = F.size(temperature)
            heat = F.when(n == size, cut(temperature)).when(n == tail, F.col(temperature))
            heat = F.coalesce(heat, no_heat)
        zipped = F.arrays_zip(
            cut(current).alias("i"), cut(voltage).alias("v"), cut(charge).alias("q"),
            cut(time).alias("t"), heat.alias("h"),
        )
        finite = F.filter(
            zipped,
            lambda p: value_finite(p["i"]) & value_finite(p["v"]) & value_finite(p["q"])
            & value_finite(p["t"]),
        )
        return F.when(begin > 0, finite)

    def rejected(reason):
        return F.struct(reason.alias("reason"), F.lit(None).cast(_feature_type(grid)).alias("features"))

    def with_points(p):
        early = F.coalesce(
            first_reason, F.when(p.isNull(), REJECTIONS[2]), F.when(F.size(p) < 3, REJECTIONS[3])
        )
        return F.when(early.isNotNull(), rejected(early)).otherwise(
            let(elapsed_array(F.transform(p, lambda x: x["t"])), lambda e: with_elapsed(p, e))
        )

    def with_elapsed(p, e):
        uncovered = F.when(F.element_at(e, -1) < window, REJECTIONS[4]).when(
            F.size(F.array_distinct(e)) < 2, REJECTIONS[5]
        )
        on_grid = lambda f: interpolate(e, F.transform(p, lambda x: x[f]), grid)
        inside = F.filter(F.arrays_zip(e.alias("e"), p.alias("p")), lambda z: z["e"] <= window)
        parts = F.struct(
            on_grid("v").alias("gv"), on_grid("i").alias("gi"), on_grid("q").alias("gq"),
            inside.alias("w"),
        )
        return F.when(uncovered.isNotNull(), rejected(uncovered)).otherwise(let(parts, judge))

    def judge(s):
        gained = F.element_at(s["gq"], -1) - F.element_at(s["gq"], 1)
        late = F.when(F.size(s["w"]) < 3, REJECTIONS[6]).when(
            ~is_finite(gained) | (gained <= 0), REJECTIONS[7]
        )
        return F.when(late.isNotNull(), rejected(late)).otherwise(
            let(
                F.struct(
                    F.transform(s["w"], lambda z: z["p"]["v"]).alias("v"),
                    F.transform(s["w"], lambda z: z["p"]["i"] / capacity).alias("i"),
                    F.filter(F.transform(s["w"], lambda z: z["p"]["h"]), value_finite).alias("h"),
                ),
                lambda w: F.struct(
                    F.lit(None).cast("string").alias("reason"),
                    _feature_struct(s, w, gained, capacity, window_seconds, grid).alias("features"),
                ),
            )
        )

    outcome = let(start, lambda begin: let(points(begin), with_points))
    out = df.withColumn("_outcome", outcome)
    return out.withColumns(
        {"reason": F.col("_outcome.reason"), "features": F.col("_outcome.features")}
    ).drop("_outcome")


def _feature_names(grid: list[float]) -> list[str]:
    return [
        "delta_q_per_nominal", "voltage_mean", "voltage_std", "voltage_slope_per_hour",
        "current_c_mean", "current_c_std", "current_c_abs_mean", "points",
        "temperature_available", "temperature_mean", "temperature_std",
        *[f"voltage_at_{int(g)}s" for g in grid],
        *[f"current_c_at_{int(grid[i])}s" for i in (0, 5, 10)],
    ]


def _feature_type(grid: list[float]) -> str:
    return "struct<" + ",".join(f"{n}:double" for n in _feature_names(grid)) + ">"


def _feature_struct(s, w, gained, capacity, window_seconds, grid) -> Column:
    slope = (F.element_at(s["gv"], -1) - F.element_at(s["gv"], 1)) / F.lit(window_seconds / 3600.0)
    values = [
        gained / capacity,
        array_mean(w["v"]),
        let(array_mean(w["v"]), lambda m: array_std(w["v"], m)),
        slope,
        array_mean(w["i"]),
        let(array_mean(w["i"]), lambda m: array_std(w["i"], m)),
        array_mean(F.transform(w["i"], lambda i: F.abs(i))),
        F.size(s["w"]).cast("double"),
        (F.size(w["h"]) > 0).cast("double"),
        array_mean(w["h"]),
        let(array_mean(w["h"]), lambda m: array_std(w["h"], m)),
        *[F.element_at(s["gv"], i + 1) for i in range(len(grid))],
        *[F.element_at(s["gi"], i + 1) / capacity for i in (0, 5, 10)],
    ]
    return F.struct(*[v.alias(n) for n, v in zip(_feature_names(grid), values)])


def largest_positive(values: str | Column) -> Column:
    """Label: largest finite value, NULL unless it is positive."""
    top = F.array_max(F.filter(values, value_finite))
    return F.when(top > 0, top)


def first_rate(protocol: str, field: str = "rate_in_C") -> Column:
    """First finite numeric rate among the steps of a protocol array."""
    rates = F.transform(protocol, lambda s: s[field].try_cast("double"))
    return F.get(F.filter(rates, value_finite), F.lit(0))


# Fixed value: charge window written into an identifier, such as "_10-90_".
SOC_PATTERN = r"_(\d{1,3})-(\d{1,3})_"


def soc_window(identifier: str, interval: str) -> list[Column]:
    """Lower and upper charge window, where it came from, and whether it is the full one."""
    low_id = F.regexp_extract(identifier, SOC_PATTERN, 1).try_cast("double") / 100.0
    high_id = F.regexp_extract(identifier, SOC_PATTERN, 2).try_cast("double") / 100.0
    low_meta, high_meta = F.get(interval, F.lit(0)), F.get(interval, F.lit(1))

    def valid(lo, hi):
        return F.coalesce((lo >= 0) & (lo < hi) & (hi <= 1), F.lit(False))

    by_id = valid(low_id, high_id)
    by_meta = valid(low_meta, high_meta) & (F.size(interval) == 2)
    low = F.when(by_id, low_id).when(by_meta, low_meta)
    high = F.when(by_id, high_id).when(by_meta, high_meta)
    source = F.when(by_id, "cell_id").when(by_meta, "metadata").otherwise("unresolved")
    full = F.coalesce((low <= 0.01) & (high >= 0.99), F.lit(False))
    return [
        low.alias("soc_lower"), high.alias("soc_upper"), source.alias("soc_source"),
        full.alias("full_window"),
    ]


def retention(
    df: DataFrame, keys: Keys, label: str, nominal: str | None = None, count: int = 5
) -> DataFrame:
    """Label divided by the median of the first five labels (and by a nominal value)."""
    reference = first_records(df, keys, count).groupBy(*keys.group).agg(
        F.percentile(label, 0.5).alias("reference")
    )
    joined = df.join(reference, keys.group)
    ratio = F.when(F.col("reference") > 0, F.col(label) / F.col("reference"))
    out = joined.withColumn("retention_initial", ratio)
    if nominal:
        out = out.withColumn("retention_nominal", F.try_divide(F.col(label), F.col(nominal)))
    return out


def anchor_coordinates(
    df: DataFrame, keys: Keys, features: list[str], *, count: int = 5, clip_at: float = 20.0,
    tolerance: float = 1e-12,
) -> DataFrame:
    """(x - median) / IQR of the first five records, clipped; zero and invalid otherwise."""
    aggs = [
        F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{c}")
        for c in features
    ]
    anchors = first_records(df, keys, count).groupBy(*keys.group).agg(*aggs)
    joined = df.join(anchors, keys.group, "left")
    columns = {}
    for c in features:
        q = F.col(f"_{c}")
        spread = F.abs(q[2] - q[0])
        valid = F.coalesce(is_finite(q[1]) & is_finite(spread) & (spread > tolerance), F.lit(False))
        z = F.when(valid, (F.col(c) - q[1]) / spread)
        z = F.when(is_finite(z), z).otherwise(0.0)
        columns[f"anchor_z__{c}"] = F.least(F.greatest(z, F.lit(-clip_at)), F.lit(clip_at))
        columns[f"anchor_valid__{c}"] = valid.cast("double")
    return joined.withColumns(columns).drop(*[f"_{c}" for c in features])


def anchor_coverage(df: DataFrame, keys: Keys, features: list[str]) -> DataFrame:
    """Per feature: units, units with a valid anchor and their share."""
    flags = df.groupBy(*keys.group).agg(
        *[F.max(f"anchor_valid__{c}").alias(c) for c in features]
    )
    totals = flags.agg(F.count(F.lit(1)).alias("units"), *[F.sum(c).alias(c) for c in features])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("valid_units")) for c in features]
    return totals.select("units", F.inline(F.array(*rows))).withColumn(
        "valid_fraction", F.col("valid_units") / F.col("units")
    )


def context_change(
    df: DataFrame, keys: Keys, features: list[str], *, count: int = 5, floor: float = 1e-6,
    clip_at: float = 5.0,
) -> DataFrame:
    """Commissioning context (first-five median), change from it and relative change."""
    context = first_records(df, keys, count).groupBy(*keys.group).agg(
        *[F.percentile(c, 0.5).alias(f"context__{c}") for c in features]
    )
    joined = df.join(context, keys.group, "left")
    columns = {}
    for c in features:
        change = F.col(c) - F.col(f"context__{c}")
        relative = change / F.greatest(F.abs(F.col(f"context__{c}")), F.lit(floor))
        columns[f"change__{c}"] = change
        columns[f"relative_change__{c}"] = F.least(
            F.greatest(relative, F.lit(-clip_at)), F.lit(clip_at)
        )
    return joined.withColumns(columns)


def features_from_rows(
    t, *, current: str, voltage: str, charge: str, time: str, nominal: float,
    window_seconds: float = 600.0, block: bool = False,
) -> DataFrame:
    """The same features from one row per measurement instead of nested arrays.

    Built from neighbour lookups, running sums and mergeable aggregates, so a cycle of
    any length is spread over tasks.  One row per unit with its features or a reason.
    Expects finite measurements in the unit's order.  ``block`` reports a short or
    uncovered block first, before its charge is looked at.
    """
    from railguard.operators.ordering import (
        elapsed_with_resets, trim_to_first, with_next, with_rank,
    )

    window = float(window_seconds)
    floor = max(1e-10, 1e-8 * nominal)
    sizes = t.frame.groupBy(*t.keys.group).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(time) - F.min(time)).alias("_span")
    )
    ahead = with_next(t, {"_q1": charge})
    trimmed = trim_to_first(ahead, F.coalesce(F.col("_q1") - F.col(charge) > floor, F.lit(False)))
    timed = with_rank(elapsed_with_resets(trimmed, time, "_e"), "_pos").frame
    grid = [g * window / 600.0 for g in GRID_SECONDS]
    e, inside = F.col("_e"), F.col("_e") <= window
    row = lambda pos: F.struct(
        e.alias("e"), pos.alias("pos"), F.col(voltage).alias("v"), F.col(current).alias("i"),
        F.col(charge).alias("q"),
    )
    aggs = [
        F.count(F.lit(1)).alias("_kept"),
        F.max("_e").alias("_end"),
        F.count_if(inside).alias("_in"),
        F.avg(F.when(inside, F.col(voltage))).alias("voltage_mean"),
        F.stddev_pop(F.when(inside, F.col(voltage))).alias("voltage_std"),
        F.avg(F.when(inside, F.col(current) / nominal)).alias("current_c_mean"),
        F.stddev_pop(F.when(inside, F.col(current) / nominal)).alias("current_c_std"),
        F.avg(F.when(inside, F.abs(F.col(current) / nominal))).alias("current_c_abs_mean"),
    ]
    for k, g in enumerate(grid):
        # Among equal times the earliest record counts on both sides of the grid point.
        aggs += [
            F.max(F.when(e <= g, row(-F.col("_pos")))).alias(f"_lo{k}"),
            F.min(F.when(e >= g, row(F.col("_pos")))).alias(f"_hi{k}"),
        ]
    units = sizes.join(timed.groupBy(*t.keys.group).agg(*aggs), t.keys.group, "left")

    def at(k: int, field: str):
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        slope = (hi[field] - lo[field]) / (hi["e"] - lo["e"])
        return F.when(hi["e"] == lo["e"], lo[field]).otherwise(
            slope * (F.lit(float(grid[k])) - lo["e"]) + lo[field]
        )

    gained = at(10, "q") - at(0, "q")
    short, uncovered = F.col("_n") < 3, F.lit(block) & (F.col("_span") < window)
    reason = (
        F.when(short, REJECTIONS[3] if block else REJECTIONS[0])
        .when(uncovered, REJECTIONS[4])
        .when(F.col("_kept").isNull(), REJECTIONS[2])
        .when(F.col("_kept") < 3, REJECTIONS[3])
        .when(F.col("_end") < window, REJECTIONS[4])
        .when(F.col("_in") < 3, REJECTIONS[6])
        .when(~is_finite(gained) | (gained <= 0), REJECTIONS[7])
    )
    values = [
        (gained / nominal).alias("delta_q_per_nominal"), F.col("voltage_mean"),
        F.col("voltage_std"),
        ((at(10, "v") - at(0, "v")) / (window / 3600.0)).alias("voltage_slope_per_hour"),
        F.col("current_c_mean"), F.col("current_c_std"), F.col("current_c_abs_mean"),
        F.col("_in").cast("double").alias("points"),
    ]
    values += [at(k, "v").alias(f"voltage_at_{int(g)}s") for k, g in enumerate(grid)]
    values += [(at(k, "i") / nominal).alias(f"current_c_at_{int(grid[k])}s") for k in (0, 5, 10)]
    judged = units.withColumn("reason", reason)
    return judged.select(
        *t.keys.group, "reason", F.when(F.col("reason").isNull(), F.struct(*values)).alias("features")
    )


def first_passing_block(
    t, *, cycle: str, current: str, voltage: str, time: str, nominal: float,
    threshold: float = 0.05, window_seconds: float = 600.0,
) -> DataFrame:
    """Features of the first active block of each cycle that passes, else the last reason.

    ``t``: units are (file, cycle) in file order.  Blocks are contiguous records whose
    current exceeds ``threshold``; inside a block records are ordered by time.
    """
    from dataclasses import replace

    from railguard.operators.layout import Trajectories
    from railguard.operators.ordering import cumulative_charge, with_block

    keys = t.keys
    blocks = with_block(t, F.col(current) > threshold).frame.filter(F.col("block").isNotNull())
    finite = blocks.filter(is_finite(time) & is_finite(current) & is_finite(voltage))
    named = finite.withColumn("_unit", F.concat_ws("#", F.col(keys.unit), F.col("block")))
    inner = replace(keys, unit="_unit", order=(time, *keys.order))
    runs = Trajectories(named, inner, t.longest, t.cut)
    if t.cut:
        # Blocks are new units with their own order: plan them afresh.
        runs = Trajectories.plan(named.drop("_piece"), inner)
    charged = cumulative_charge(runs, time, current, "_charge")
    feats = features_from_rows(
        charged, current=current, voltage=voltage, charge="_charge", time=time, nominal=nominal,
        window_seconds=window_seconds, block=True,
    )
    split = F.split("_unit", "#")
    feats = feats.select(
        keys.domain, split[0].alias(keys.unit), split[1].cast("bigint").alias("block"),
        "reason", "features",
    )
    # A cycle has few blocks; the choice is an aggregate over (block, features) pairs.
    ok = F.col("reason").isNull()
    chosen = feats.groupBy(keys.domain, keys.unit).agg(
        F.min_by(F.when(ok, F.col("features")), F.when(ok, F.col("block"))).alias("features"),
        F.min(F.when(ok, F.col("block"))).alias("block"),
        F.max_by("reason", "block").alias("_last"),
    )
    cycles = t.frame.select(keys.domain, keys.unit).distinct()
    out = cycles.join(chosen, [keys.domain, keys.unit], "left")
    reason = F.when(
        F.col("block").isNull(), F.coalesce("_last", F.lit("no_positive_charge_segment"))
    )
    return out.withColumn("reason", reason).drop("_last")


def negative_variation(t, current: str, cumulative: str, threshold: float = 0.05) -> DataFrame:
    """Label: total fall of a cumulative counter over records with negative current."""
    from railguard.operators.ordering import with_previous

    f = with_previous(t, {"_before": cumulative}).frame
    drop = F.col("_before") - F.col(cumulative)
    counts = is_finite("_before") & is_finite(cumulative) & (F.col(current) < -threshold) & (drop > 0)
    total = F.sum(F.when(counts, drop))
    return f.groupBy(*t.keys.group).agg(total.alias("label"))


def largest_discharge(df: DataFrame, group: list[str], current: str, capacity: str, threshold: float = 0.05) -> DataFrame:
    """Label: largest absolute capacity over records with negative current."""
    size = F.abs(F.col(capacity))
    valid = (F.col(current) < -threshold) & is_finite(capacity) & (size > 0)
    return df.groupBy(*group).agg(F.max(F.when(valid, size)).alias("label"))


def located_scalar(
    locators: DataFrame, objects: DataFrame, keys: list[str], kind: str, values: str, wanted: str
) -> DataFrame:
    """Label found by locator: exactly one finite positive value, else the reason why not.

    ``objects`` holds one row per locator with its kind and an array of values.
    """
    found = objects.select(*keys, kind, values, F.lit(True).alias("_found"))
    joined = locators.join(found, keys, "left")
    finite = F.filter(values, value_finite)
    reason = (
        F.when(F.col("_found").isNull(), "source_missing")
        .when(F.col(kind) != wanted, "locator_has_other_kind")
        .when(F.col(values).isNull(), "capacity_missing")
        .when((F.size(finite) != 1) | (F.get(finite, F.lit(0)) <= 0), "not_one_positive_scalar")
    )
    out = joined.withColumn("reason", reason).withColumn(
        "label", F.when(F.col("reason").isNull(), F.get(finite, F.lit(0)))
    )
    return out.drop("_found", values)
