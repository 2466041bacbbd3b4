"""How trajectories are laid out over the cluster.

A trajectory is all records of one ``(domain, unit)`` in a declared total order.
Most units are short and one hash partition per unit is the right plan: a single
shuffle feeds every ordered operator.  A unit that holds a large share of all
rows would make one task the bottleneck, so such units are cut into *pieces*
along the order key.  Ordered operators then work per piece and carry a small
per-piece summary forward; no result depends on where the cuts fall.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from railguard.functions.arrays import count_below, with_coarse_cuts
from railguard.session import durable

PIECE = "_piece"
# One task handles at most about this many records of one unit.
PIECE_ROWS = 4_000_000
# Cuts per unit are found two-level (64 x 64) so placing a row costs at most 126 comparisons.
_FAN = 64


@dataclass(frozen=True)
class Keys:
    """Names of the hierarchy and of the total order inside a unit."""

    domain: str = "domain"
    unit: str = "unit"
    order: tuple[str, ...] = ("order_key", "ordinal")

    @property
    def group(self) -> list[str]:
        return [self.domain, self.unit]

    @property
    def record(self) -> list[str]:
        return [*self.group, *self.order]


@dataclass(frozen=True)
class Trajectories:
    """A DataFrame plus what is known about its units."""

    frame: DataFrame
    keys: Keys = field(default_factory=Keys)
    longest: int = 0
    cut: bool = False

    @staticmethod
    def plan(
        df: DataFrame, keys: Keys = Keys(), piece_rows: int = PIECE_ROWS
    ) -> "Trajectories":
        """Measure unit lengths (key columns only, map-side combined) and cut long units."""
        lengths = df.groupBy(*keys.group).agg(F.count(F.lit(1)).alias("rows"))
        longest = lengths.agg(F.max("rows")).first()[0] or 0
        if longest <= piece_rows:
            return Trajectories(df, keys, longest, False)
        return Trajectories(
            _cut_long_units(df, keys, lengths, longest, piece_rows), keys, longest, True
        )

    def with_frame(self, frame: DataFrame) -> "Trajectories":
        return replace(self, frame=frame)

    @property
    def part(self) -> list[str]:
        """Columns that identify one ordered run of records inside one task."""
        return [*self.keys.group, PIECE] if self.cut else self.keys.group

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.keys.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def sorted_frame(self) -> DataFrame:
        """One shuffle on the unit (or piece), ordered inside each partition."""
        part = [F.col(c) for c in self.part]
        return self.frame.repartition(*part).sortWithinPartitions(
            *part, *[F.col(c) for c in self.keys.order]
        )

    def carry(self, summary: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
        """Per-piece ``summary`` aggregates turned into values known before the piece starts.

        ``carried`` expressions are evaluated over all earlier pieces of the unit.  Only
        pieces after the first are returned, so the table has at most about
        ``2 * records / piece_rows`` rows and is safe to broadcast.
        """
        pieces = self.frame.groupBy(*self.part).agg(
            *[c.alias(name) for name, c in summary.items()]
        )
        long_units = pieces.filter(F.col(PIECE) > 0).select(*self.keys.group).distinct()
        pieces = pieces.join(F.broadcast(long_units), self.keys.group, "left_semi")
        earlier = (
            Window.partitionBy(*self.keys.group)
            .orderBy(PIECE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return pieces.select(
            *self.part, *[c.over(earlier).alias(name) for name, c in carried.items()]
        ).filter(F.col(PIECE) > 0)

    def join_carry(self, frame: DataFrame, carried: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(carried), self.part, "left")


def _cut_long_units(
    df: DataFrame, keys: Keys, lengths: DataFrame, longest: int, piece_rows: int
) -> DataFrame:
    first = keys.order[0]
    wanted = min(-(-longest // piece_rows), _FAN * _FAN)
    points = [i / wanted for i in range(1, wanted)]
    # Number of long units is at most records / piece_rows: a proven bound for the broadcast.
    long_units = lengths.filter(F.col("rows") > piece_rows)
    stride = F.greatest(
        F.lit(1), F.floor(F.lit(float(longest)) / F.col("rows")).cast("int")
    )
    cuts = (
        df.select(*keys.group, first)
        .join(F.broadcast(long_units), keys.group)
        .groupBy(*keys.group, "rows")
        .agg(F.percentile_approx(first, points, F.lit(max(10_000, 20 * wanted))).alias("all_cuts"))
        .withColumn("stride", stride)
        .select(
            *keys.group,
            with_coarse_cuts(
                F.array_distinct(
                    F.filter("all_cuts", lambda _, i: (i + 1) % F.col("stride") == 0)
                ),
                _FAN,
            ).alias("cuts"),
        )
    )
    # Sketch merges depend on task order, so the cuts are fixed once before use.
    cuts = durable(cuts)
    piece = count_below("cuts", F.col(first), _FAN)
    return (
        df.join(F.broadcast(cuts), keys.group, "left")
        .withColumn(
            PIECE,
            F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(piece).cast("int"),
        )
        .drop("cuts")
    )
