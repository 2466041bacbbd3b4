"""The guard as a stateful stream: one published row per record, never revised.

Every input record gives exactly one row, or is still waiting for its reorder delay until its
unit goes on, is closed or has been silent for long enough: nothing is dropped.  Per unit the state is a handful of numbers: the last key, the protected state,
the last output, the commissioning values until the reference is frozen and, when a reorder
delay is asked for, the newest order key seen and the records still waiting.

Units are dealt into a fixed number of buckets by a hash, and the state that Spark keeps is one
row per bucket with a list per field: a call into Python costs about as much as hundreds of
records, and a unit often has only a few in a micro-batch.  A task holds the new records and
the unit states of one bucket at a time, so the batch size (files or rows per trigger) and the
number of buckets bound memory, not the length of a unit's history.
"""

from __future__ import annotations

import math
import statistics
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from railguard.functions.columns import TOLERANCE, Y_MAX, Y_MIN, ColumnOrNumber, as_column, check_alpha, is_finite
from railguard.operators.folds import GuardFold
from railguard.operators.layout import Keys
from railguard.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

PUBLISHED, LATE, INFEASIBLE, HALTED = "published", "late_rejected", "infeasible", "halted"
#: A record without a finite value, an order or a named unit: reported, and the state stays.
INVALID = "invalid"

#: Buckets that units are dealt into; a checkpoint keeps the number it was started with.
BUCKETS = 1024

_RECORD = ["order_key", "ordinal", "raw", "candidate", "down", "up"]


@dataclass(slots=True)
class _Unit:
    """State of one unit between micro-batches."""

    last: tuple[int, int] | None = None
    newest: int | None = None
    levels: tuple[float, float] | None = None
    n: int = 0
    halted: bool = False
    anchors: list[float] = field(default_factory=list)
    reference: float | None = None
    seen: int = 0
    waiting: list[tuple] = field(default_factory=list)


def _state_schema(domain: str, unit: str) -> str:
    """One row per bucket: an entry per unit in every list, waiting records with their unit's place."""
    whole = ["last_order", "last_ordinal", "newest", "n", "seen"]
    double = ["b", "p", "reference"]
    return ", ".join([
        f"domain array<{domain}>, unit array<{unit}>", *[f"{c} array<bigint>" for c in whole],
        *[f"{c} array<double>" for c in double], "halted array<boolean>, anchors array<array<double>>",
        "w_unit array<bigint>, w_order array<bigint>, w_ordinal array<bigint>, w_raw array<double>, "
        "w_candidate array<double>, w_down array<double>, w_up array<double>",
    ])


def _load(state: GroupState) -> dict[tuple, _Unit]:
    """The units of a bucket by (domain, unit)."""
    if not state.exists:
        return {}
    domain, unit, *columns = state.get
    units = {}
    for key, lo, lq, newest, n, seen, b, p, reference, halted, anchors in zip(zip(domain, unit), *columns[:10]):
        last, levels = (None, None) if lo is None else ((lo, lq), (b, p))
        units[key] = _Unit(last, newest, levels, n, halted, list(anchors), reference, seen)
    places = list(units.values())
    for place, *record in zip(*columns[10:]):
        places[place].waiting.append(tuple(record))
    return units


def _save(units: dict[tuple, _Unit], state: GroupState) -> None:
    none = (None, None)
    rows = [
        (*key, *(u.last or none), u.newest, u.n, u.seen, *(u.levels or none), u.reference, u.halted, u.anchors)
        for key, u in units.items()
    ]
    held = [(place, *r) for place, u in enumerate(units.values()) for r in u.waiting]
    columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(12)]
    state.update((*columns, *([list(c) for c in zip(*held)] if held else [[] for _ in range(7)])))


def _advance(unit: _Unit, fold: GuardFold, commissioning: int, record: tuple) -> tuple:
    """Publish, reject or halt on one record; returns the output row without the keys."""
    order, ordinal, raw, candidate, down, up = record
    blank = (None, None, None, None)
    if unit.halted:
        return (order, ordinal, *blank, HALTED)
    if unit.last is not None and (order, ordinal) <= unit.last:
        return (order, ordinal, *blank, LATE)
    b, p = fold.step(unit.levels, (raw, candidate, down, up))
    before = fold.y_max if unit.levels is None else unit.levels[1]
    if max(fold.y_min, b - down) > min(fold.y_max, b + up, before) + TOLERANCE:
        unit.halted = True
        return (order, ordinal, *blank, INFEASIBLE)
    unit.last, unit.levels, unit.n = (order, ordinal), (b, p), unit.n + 1
    if unit.n <= commissioning:
        unit.anchors.append(raw)
    # The reference is frozen once the window is complete; before that nothing is scored.
    if unit.reference is None and unit.n >= commissioning:
        unit.reference, unit.anchors = statistics.median(unit.anchors) if unit.anchors else math.nan, []
    return (order, ordinal, b, p, unit.n, unit.reference, PUBLISHED)


def guard_stream(
    stream: DataFrame,
    raw: str = "raw_baseline",
    candidate: str = "raw_candidate",
    *,
    alpha: float,
    budget: ColumnOrNumber,
    under_cost: ColumnOrNumber = 1.0,
    over_cost: ColumnOrNumber = 1.0,
    y_min: float = Y_MIN,
    y_max: float = Y_MAX,
    commissioning: int = 5,
    keys: Keys = Keys(),
    reorder_delay: str | None = None,
    closing: str | None = None,
    silence: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per input record with state, output, rank, frozen reference and status.

    A record at or below the last published key cannot change published rows and is
    reported as ``late_rejected``.  With ``reorder_delay`` (for example "10 seconds"; the
    order key must then be microseconds) a record waits until its unit has shown a key that
    is newer by the delay, which trades latency for fewer rejections.  The unit's own clock
    decides, not a global watermark, because Spark would discard rows behind a watermark
    before they could be reported.  Records without finite values, order or unit are
    reported as ``invalid``.

    Records that wait are published when their unit goes on, and for a unit that does not:
    on a marker, a row whose boolean column ``closing`` is true (see ``closing_markers``; the
    marker itself gives no row), or, in a stream that runs on, once the unit has been silent
    for the processing time ``silence``.  Spark looks for silent units with every batch,
    batches without data included.

    ``buckets`` must stay the same for all runs on one checkpoint.
    """
    check_alpha(alpha)
    order, ordinal = keys.order
    fold = GuardFold(
        inputs=tuple(_RECORD[2:]), state=("b", "p"), alpha=alpha, y_min=y_min, y_max=y_max
    )
    named = [F.coalesce(F.rlike(F.col(k).cast("string"), F.lit(r"\S")), F.lit(False)) for k in keys.group]
    place = {"order_key": F.col(order).cast("bigint"), "ordinal": F.col(ordinal).cast("bigint")}
    values = {
        "raw": F.col(raw), "candidate": F.col(candidate),
        "down": as_column(budget) / as_column(under_cost), "up": as_column(budget) / as_column(over_cost),
    }
    usable = [*named, *[c.isNotNull() for c in place.values()], *[is_finite(c.cast("double")) for c in values.values()]]
    columns = [
        F.pmod(F.xxhash64(*keys.group), F.lit(buckets)).cast("int").alias("bucket"),
        F.col(keys.domain).alias("domain"), F.col(keys.unit).alias("unit"),
        # Whole numbers without NULL stay whole in pandas.
        *[F.coalesce(c, F.lit(0)).alias(name) for name, c in place.items()],
        *[c.isNotNull().alias(f"has_{name}") for name, c in place.items()],
        *[c.cast("double").alias(name) for name, c in values.items()],
        (F.lit(False) if closing is None else F.coalesce(F.col(closing), F.lit(False))).alias("closing"),
        reduce(and_, named).alias("named"), F.coalesce(reduce(and_, usable), F.lit(False)).alias("valid"),
    ]
    patience = None if silence is None else pd.Timedelta(silence) // pd.Timedelta(milliseconds=1)
    delay = None if reorder_delay is None else pd.Timedelta(reorder_delay) // pd.Timedelta(microseconds=1)
    names = [keys.domain, keys.unit, "order_key", "ordinal", "protected_state", "guarded",
             "rank", "reference", "status"]

    def ready(unit: _Unit, fresh: list[tuple], release: bool) -> list[tuple]:
        """Records of a unit that wait no longer, in order; the others stay in its state."""
        records, unit.waiting = unit.waiting + fresh, []
        if delay is not None and records:
            newest = max(r[0] for r in records)
            unit.newest = newest if unit.newest is None else max(unit.newest, newest)
            if not release:
                limit = unit.newest - delay
                unit.waiting = [r for r in records if r[0] > limit]
                records = [r for r in records if r[0] <= limit]
        records.sort(key=lambda r: (r[0], r[1]))
        return records

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        units = _load(state)
        fresh, closed, rows = defaultdict(list), set(), []
        for pdf in batches:
            if pdf.empty:
                continue
            marks = pdf[pdf["closing"] & pdf["named"]]
            closed.update(zip(marks["domain"].tolist(), marks["unit"].tolist()))
            good = pdf[pdf["valid"] & ~pdf["closing"]]
            for domain, unit, *record in zip(*[good[c].tolist() for c in ["domain", "unit", *_RECORD]]):
                fresh[domain, unit].append(tuple(record))
            bad = pdf[~pdf["valid"] & ~pdf["closing"]]
            bad = bad.assign(**{c: bad[c].where(bad[f"has_{c}"], None) for c in _RECORD[:2]}).astype(object)
            rows += [(*r, *[None] * 4, INVALID) for r in zip(*[bad[c].tolist() for c in ["domain", "unit", *_RECORD[:2]]])]
        now = 0 if patience is None else state.getCurrentProcessingTimeMs()
        silent = {k for k, u in units.items() if patience is not None and u.waiting and u.seen + patience <= now}
        for key in dict.fromkeys([*fresh, *closed, *silent]):
            unit = units.setdefault(key, _Unit())
            if key in fresh:
                unit.seen = now
            release = key in closed or (key in silent and key not in fresh)
            rows += [(*key, *_advance(unit, fold, commissioning, r)) for r in ready(unit, fresh.get(key, []), release)]
        _save(units, state)
        if patience is not None:
            due = [u.seen + patience for u in units.values() if u.waiting]
            if due:
                state.setTimeoutDuration(max(1, min(due) - now))
        if rows:
            out = pd.DataFrame(rows, columns=names)
            for whole in ("order_key", "ordinal", "rank"):
                out[whole] = out[whole].astype("Int64")
            yield out

    types = dict(stream.select(keys.domain, keys.unit).dtypes)
    schema = (
        f"{keys.domain} {types[keys.domain]}, {keys.unit} {types[keys.unit]}, order_key bigint, "
        "ordinal bigint, protected_state double, guarded double, rank bigint, reference double, "
        "status string"
    )
    timeout = GroupStateTimeout.NoTimeout if patience is None else GroupStateTimeout.ProcessingTimeTimeout
    kept = _state_schema(types[keys.domain], types[keys.unit])
    return stream.select(*columns).groupBy("bucket").applyInPandasWithState(
        step, schema, kept, "append", timeout
    )


def closing_markers(records: DataFrame, closing: str = "closing", keys: Keys = Keys()) -> DataFrame:
    """One end-of-input row per unit in the columns of ``records``; all but the unit is NULL."""
    units = records.select(*keys.group).distinct().withColumn(closing, F.lit(True))
    types = {f.name: f.dataType for f in records.schema}
    return units.select(
        *[F.col(c) if c in units.columns else F.lit(None).cast(types[c]).alias(c) for c in [*types, *({closing} - set(types))]]
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> DataFrame:
    """Process everything that is available now into a Parquet table (exactly once) and stop.

    Waits as long as it takes, unless a ``timeout`` in seconds is given.

    State lives in RocksDB on local disk and is checkpointed to shared storage.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        run = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        if not _ended(run, timeout):
            run.stop()
            raise TimeoutError(f"stream did not finish in {timeout} s")
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(path)


def _ended(run, timeout: int | None) -> bool:
    if timeout is not None:
        return run.awaitTermination(timeout)
    run.awaitTermination()
    return True


def certificate_stream(published: DataFrame, domain: str = "domain") -> DataFrame:
    """Running certificate over published rows: records, largest displacement, rejections."""
    moved = F.abs(F.col("guarded") - F.col("protected_state"))
    return published.groupBy(domain).agg(
        F.count("guarded").alias("published"),
        F.max(moved).alias("maximum_displacement"),
        F.count_if(F.col("status") == LATE).alias("late_rejected"),
        F.count_if(F.col("status") == INFEASIBLE).alias("infeasible"),
    )


def latest_totals(stream: DataFrame, timeout: int | None = None) -> DataFrame:
    """Run an aggregating stream to the end and return its last complete result."""
    spark: SparkSession = stream.sparkSession
    path, checkpoint = scratch_path(spark, "totals"), scratch_path(spark, "totals-state")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if not _ended(run, timeout):
        run.stop()
        raise TimeoutError(f"stream did not finish in {timeout} s")
    return spark.read.schema(stream.schema).parquet(path)
