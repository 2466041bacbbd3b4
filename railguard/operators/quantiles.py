"""Exact quantiles and weighted medians of groups too large for one task.

Values are first combined per distinct value (map-side), then bucketed by approximate
cuts.  Bucket totals locate the wanted ranks, and only the buckets that contain them
are ordered.  No task ever sees a whole group and no row is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from railguard.functions.arrays import count_below, with_coarse_cuts
from railguard.session import durable

BUCKETS = 256
#: Cells that a pass over whole columns tells apart, values of a cell that one task orders, and
#: passes that narrow a cell with more distinct ones.
CELLS, ORDERED, NARROWINGS = 4096, 1 << 20, 4


def _bucketed(df: DataFrame, group: list[str], value: str, weight: Column) -> DataFrame:
    # Written once: the input, however costly, is evaluated a single time.
    combined = durable(
        df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(weight.alias("_w"))
    )
    points = [i / BUCKETS for i in range(1, BUCKETS)]
    # Sketch merges depend on task order: fix the cuts once, both later steps read them.
    # Taken over distinct values, they balance exactly the rows that are bucketed.
    cuts = durable(
        combined.groupBy(*group).agg(
            with_coarse_cuts(F.percentile_approx(value, points, 10_000)).alias("_cuts")
        )
    )
    bucket = count_below("_cuts", F.col(value))
    # Groups here are domains, thresholds or methods: few by construction, one row each.
    return combined.join(cuts, group).withColumn("_bucket", bucket).drop("_cuts")


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probs: list[float]
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and probability."""
    df = df.select(*group, F.col(value).cast("double").alias(value))
    parts = _bucketed(df, group, value, F.count(F.lit(1)))
    by_bucket = Window.partitionBy(*group).orderBy("_bucket")
    totals = (
        parts.groupBy(*group, "_bucket")
        .agg(F.sum("_w").alias("_bw"))
        .withColumn("_upto", F.sum("_bw").over(by_bucket))
        .withColumn("_n", F.sum("_bw").over(Window.partitionBy(*group)))
    )
    place = F.col("_p") * (F.col("_n") - 1)
    ranks = (
        totals.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.floor(place) + F.when(place > F.floor(place), F.col("_side")).otherwise(0))
        .filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_bw")))
        .select(
            *group, "_bucket", "_p", "_side",
            (F.col("_rank") - (F.col("_upto") - F.col("_bw"))).alias("_local"),
            (place - F.floor(place)).alias("_fraction"),
        )
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(value)
    chosen = (
        parts.join(F.broadcast(ranks.select(*group, "_bucket").distinct()),
                   [*group, "_bucket"], "left_semi")
        .withColumn("_end", F.sum("_w").over(inside))
        .withColumn("_begin", F.col("_end") - F.col("_w"))
    )
    # ranks has two rows per group and probability, so broadcasting it is always cheap.
    found = chosen.join(F.broadcast(ranks), [*group, "_bucket"]).filter(
        (F.col("_local") >= F.col("_begin")) & (F.col("_local") < F.col("_end"))
    )
    low, high = F.max(F.when(F.col("_side") == 0, F.col(value))), F.max(
        F.when(F.col("_side") == 1, F.col(value))
    )
    return (
        found.groupBy(*group, F.col("_p").alias("prob"))
        .agg(low.alias("_lo"), high.alias("_hi"), F.max("_fraction").alias("_f"))
        .select(*group, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"))
    )


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Linear-interpolated quantiles of whole columns, all columns in the same few passes.

    A pass counts the values of equally wide cells; a cell's position never falls as the value
    rises, so counts locate the wanted ranks. Cells of one value are settled by that, those of at
    most ``ORDERED`` values are ordered, larger ones become columns of the next pass. A column
    without values has an empty list. NaN is the largest value, as in Spark's order.
    """
    frame = df.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)])
    counts = frame.agg(*[F.count(c).alias(c) for c in frame.columns], *[
        end(F.when(F.abs(c) < math.inf, F.col(c))).alias(f"{c}{k}") for c in frame.columns for k, end in enumerate((F.min, F.max))
    ]).first()
    places = {(i, k): p * (counts[f"_c{i}"] - 1) for i in range(len(columns)) for k, p in enumerate(probs) if counts[f"_c{i}"]}
    # Rank of a column -> value; a search is a column expression, its range and wanted local ranks.
    value: dict[tuple[int, int], float] = {}
    searches = []
    for i in range(len(columns)):
        ranks = {r: (i, r) for (c, _), x in places.items() if c == i for r in (math.floor(x), math.ceil(x))}
        if ranks:
            searches.append((F.col(f"_c{i}"), counts[f"_c{i}0"] or 0.0, counts[f"_c{i}1"] or 0.0, ranks))
    for left in reversed(range(NARROWINGS)):
        if not searches:
            break
        cells = [_cell(x, low, high) for x, low, high, _ in searches]
        found: dict[int, list] = {}
        for r in _counted(frame, searches, cells).collect():  # at most CELLS + 3 rows a search
            found.setdefault(r["search"], []).append(r)
        light, heavy = {}, []
        for s, (x, _, _, ranks) in enumerate(searches):
            before, rows = 0, iter(sorted(found[s], key=lambda r: r["cell"]))
            row, inside = next(rows), {}
            for rank in sorted(ranks):
                while rank >= before + row["n"]:
                    before, row = before + row["n"], next(rows)
                if row["low"] == row["high"] or math.isnan(row["low"]):
                    value[ranks[rank]] = row["low"]
                else:
                    inside.setdefault(row["cell"], (row, {}))[1][rank - before] = ranks[rank]
            for cell, (row, local) in inside.items():
                if left and row["n"] > ORDERED:
                    between = F.when(x.between(row["low"], row["high"]), x)
                    heavy.append((between, row["low"], row["high"], local))
                else:
                    light |= {(s, cell, rank): own for rank, own in local.items()}
        if light:
            value |= _picked(frame, searches, cells, light)
        searches = heavy
    out: dict[str, list[float]] = {c: [] for c in columns}
    for (i, _), x in places.items():
        low, high = value[i, math.floor(x)], value[i, math.ceil(x)]
        out[columns[i]].append(low if low == high else low + (high - low) * (x - math.floor(x)))
    return out


def _cell(x: Column, low: float, high: float) -> Column:
    """Cell of a value, in the order of values: halves keep the width of any range finite."""
    width = high / 2 - low / 2
    inside = F.floor((x / 2 - low / 2) / width * CELLS) if width > 0 else F.lit(0)
    return (
        F.when(F.isnan(x), CELLS + 1).when(x > high, CELLS).when(x < low, -1)
        .otherwise(F.least(inside, F.lit(CELLS - 1))).cast("int")
    )


def _long(frame: DataFrame, searches: list, cells: list[Column]) -> DataFrame:
    entries = [
        F.struct(F.lit(s).alias("search"), cell.alias("cell"), x.alias("value"))
        for s, ((x, *_), cell) in enumerate(zip(searches, cells))
    ]
    return frame.select(F.inline(F.array(*entries))).filter("value IS NOT NULL")


def _counted(frame: DataFrame, searches: list, cells: list[Column]) -> DataFrame:
    return _long(frame, searches, cells).groupBy("search", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _picked(frame: DataFrame, searches: list, cells: list[Column], wanted: dict) -> dict:
    """The values at the wanted (search, cell, rank inside it)."""
    ranks = frame.sparkSession.createDataFrame(list(wanted), "search int, cell int, rank bigint")
    held = F.broadcast(ranks.select("search", "cell").distinct())  # two a probability at most
    inside = _long(frame, searches, cells).join(held, ["search", "cell"], "left_semi")
    upto = F.sum("n").over(Window.partitionBy("search", "cell").orderBy("value"))
    ordered = inside.groupBy("search", "cell", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    hits = ordered.join(F.broadcast(ranks), ["search", "cell"]).filter("rank < upto AND rank >= upto - n")
    return {wanted[r["search"], r["cell"], r["rank"]]: r["value"] for r in hits.collect()}


def weighted_median(
    df: DataFrame, group: list[str], value: str, weight: str, tolerance: float = 1e-12
) -> DataFrame:
    """Lower weighted median: first value whose cumulative weight reaches half the total.

    Sums may be added in any order, so "reaches" allows a relative ``tolerance``.
    """
    df = df.select(*group, F.col(value).cast("double").alias(value), weight)
    parts = _bucketed(df, group, value, F.sum(weight))
    by_bucket = Window.partitionBy(*group).orderBy("_bucket")
    totals = (
        parts.groupBy(*group, "_bucket")
        .agg(F.sum("_w").alias("_bw"))
        .withColumn("_upto", F.sum("_bw").over(by_bucket))
        .withColumn("_half", F.sum("_bw").over(Window.partitionBy(*group)) * (0.5 - tolerance))
        .filter(F.col("_upto") >= F.col("_half"))
    )
    first = F.min_by(F.struct("_bucket", "_upto", "_bw", "_half"), "_bucket")
    hit = totals.groupBy(*group).agg(first.alias("_h")).select(*group, "_h.*")
    inside = Window.partitionBy(*group, "_bucket").orderBy(value)
    before = F.col("_upto") - F.col("_bw")
    return (
        parts.join(F.broadcast(hit), [*group, "_bucket"])
        .withColumn("_cum", before + F.sum("_w").over(inside))
        .withColumn("_last", F.max(value).over(Window.partitionBy(*group, "_bucket")))
        .groupBy(*group)
        .agg(
            F.coalesce(
                F.min(F.when(F.col("_cum") >= F.col("_half"), F.col(value))), F.max("_last")
            ).alias("weighted_median")
        )
    )
