"""Offline monotone projection: non-increasing isotonic regression per unit.

Retrospective only, because it sees the future.  Pooling a run of records never
changes the pooling of the whole unit, so pieces are pooled in parallel and only the
remaining blocks of a unit meet in one stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from railguard.functions.columns import Y_MAX, Y_MIN, clip
from railguard.operators.layout import Trajectories
from railguard.operators.ordering import with_running


def _pool(part: list[str], low: str, high: str, weight: str, total: str):
    """Streaming pool-adjacent-violators over sorted (part, low) rows."""
    names = [low, high, weight, total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, blocks, types = None, [], None

        def flush():
            columns = [pa.array([key[i]] * len(blocks), type=f.type) for i, f in enumerate(types)]
            values = [pa.array(list(c)) for c in zip(*blocks)]
            return pa.RecordBatch.from_arrays([*columns, *values], names=[*part, *names])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.schema.field(c) for c in part]
            keys = zip(*[batch.column(c).to_pylist() for c in part])
            rows = zip(*[batch.column(c).to_pylist() for c in names])
            for here, row in zip(keys, rows):
                if here != key:
                    if blocks:
                        yield flush()
                    key, blocks = here, []
                blocks.append(row)
                # A block that averages above its predecessor merges with it.
                while len(blocks) > 1 and (
                    blocks[-1][3] / blocks[-1][2] > blocks[-2][3] / blocks[-2][2]
                ):
                    a, b = blocks[-2], blocks.pop()
                    blocks[-1] = (a[0], b[1], a[2] + b[2], a[3] + b[3])
        if blocks:
            yield flush()

    return run


def monotone_projection(
    t: Trajectories, value: str, out: str = "isotonic", y_min: float = Y_MIN, y_max: float = Y_MAX
) -> DataFrame:
    """Least-squares non-increasing fit per unit, clipped; tied order keys share one value."""
    order = t.keys.order[0]
    ties = t.frame.groupBy(*t.part, order).agg(
        F.count(F.lit(1)).cast("double").alias("_w"), F.sum(value).alias("_s")
    )
    points = ties.select(*t.part, F.col(order).alias("_lo"), F.col(order).alias("_hi"), "_w", "_s")

    def pooled(df: DataFrame, part: list[str]) -> DataFrame:
        columns = [F.col(c) for c in part]
        fields = df.select(*part, "_lo", "_hi", "_w", "_s").schema
        ready = df.select(*part, "_lo", "_hi", "_w", "_s").repartition(*columns)
        return ready.sortWithinPartitions(*columns, "_lo").mapInArrow(
            _pool(part, "_lo", "_hi", "_w", "_s"), fields
        )

    blocks = pooled(points, t.part)
    if t.cut:
        blocks = pooled(blocks, t.keys.group)
    fitted = blocks.select(
        *t.keys.group, F.col("_lo").alias(order), clip(F.col("_s") / F.col("_w"), y_min, y_max).alias(out)
    )
    # Fits never rise along a unit and a block's value holds from its first record on,
    # so spreading it over the block is a running minimum.
    placed = t.frame.join(fitted, [*t.keys.group, order], "left")
    done = with_running(t.with_frame(placed), {"_fit": ("min", F.col(out))})
    return done.frame.drop(out).withColumnRenamed("_fit", out)
