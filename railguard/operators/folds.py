"""Ordered folds over trajectories.

Some recursions (a state that absorbs a fraction of each downward innovation) have
no window form.  Two physical forms share one definition of the arithmetic:

* short units: ``aggregate`` over a sorted array, entirely inside the JVM;
* longer units: a streaming pass over sorted partitions with Arrow batches.  A task
  holds one batch and one state at a time, whatever the unit's length.

Grids of parameters step by rank: the first records of all units in a batch together,
then the second ones, so that one array operation serves many units and grid points.

Cut units run piece by piece.  The state entering each piece is found by repeating
"run all unsettled pieces in parallel, pass their end states on" until nothing
changes.  At that fixed point every piece started from exactly the state its
predecessor ended with, so the result is bit-identical to one sequential pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from railguard.functions.columns import Y_MAX, Y_MIN, is_finite, require_finite
from railguard.operators.layout import PIECE, Trajectories
from railguard.session import durable

_START = "_start_"


@dataclass(frozen=True)
class Fold:
    """A recursion over records: ``state`` columns are emitted for every record.

    ``step(previous, values)`` returns the new state tuple; ``previous`` is ``None`` for
    the first record of a unit.  ``values`` follow ``inputs``.  With ``arrays`` the state
    columns are ``array<double>`` (one entry per grid point) and a step takes one record
    each of many units: all values and states have a leading axis of units.
    """

    inputs: tuple[str, ...]
    state: tuple[str, ...]
    non_increasing: bool = False
    arrays: bool = False
    guess: float = Y_MAX

    def step(self, previous, values):
        raise NotImplementedError

    def resume(self, carried):
        """Full state at the start of a later piece from the carried state columns."""
        return carried

    @property
    def carried(self) -> tuple[str, ...]:
        """State columns that cross from one piece to the next."""
        return self.state

    @property
    def emitted(self) -> tuple[str, ...]:
        """State columns that leave the task."""
        return self.state

    @property
    def state_type(self) -> T.DataType:
        return T.ArrayType(T.DoubleType()) if self.arrays else T.DoubleType()


@dataclass(frozen=True)
class StateFold(Fold):
    """Protected state: absorb the share ``alpha`` of each downward innovation."""

    alpha: float = 1.0
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    def step(self, previous, values):
        raw = values[0]
        if previous is None:
            return (min(max(raw, self.y_min), self.y_max),)
        b = previous[0]
        b = b + self.alpha * min(raw - b, 0.0)
        return (min(max(b, self.y_min), self.y_max),)


@dataclass(frozen=True)
class GuardFold(StateFold):
    """Protected state and guarded output together (inputs: raw, candidate, widths)."""

    def step(self, previous, values):
        raw, candidate, width_down, width_up = values
        if previous is None:
            b, last = min(max(raw, self.y_min), self.y_max), self.y_max
        else:
            b, last = previous
            b = b + self.alpha * min(raw - b, 0.0)
            b = min(max(b, self.y_min), self.y_max)
        low = max(self.y_min, b - width_down)
        high = min(self.y_max, b + width_up)
        return b, min(last, min(max(candidate, low), high))


@dataclass(frozen=True)
class RecoveryFold(Fold):
    """State that may also rise, by at most the record's allowance, and its output.

    Inputs: raw, candidate, budget, allowance.
    """

    alpha: float = 1.0
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    def step(self, previous, values):
        raw, candidate, budget, allowance = values
        if previous is None:
            b, last = min(max(raw, self.y_min), self.y_max), self.y_max
        else:
            b, last = previous
            gap = raw - b
            b = b + (self.alpha * gap if gap <= 0.0 else min(gap, allowance))
            b = min(max(b, self.y_min), self.y_max)
        low = max(self.y_min, b - budget)
        high = max(low, min(self.y_max, b + budget, last + allowance))
        return b, min(max(candidate, low), high)


def _bounded(x, fold):
    return np.minimum(np.maximum(x, fold.y_min), fold.y_max)


def _by_pair(values: np.ndarray) -> np.ndarray:
    """(units, pairs, 1): a scalar column has one pair, an array column one per entry."""
    return values.reshape(len(values), -1, 1)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


@dataclass(frozen=True)
class StateGridFold(Fold):
    """The protected state for a whole grid of ``alphas`` in one pass.

    Inputs of this and the other grids may be array columns, one entry per pair-specific
    prediction of the record; the pair is then the slowest axis of the state.
    """

    arrays: bool = True
    alphas: tuple[float, ...] = (1.0,)
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    def absorb(self, previous, raw):
        """States (units, pairs, alphas) after one more record."""
        grid = np.asarray(self.alphas)
        if previous is None:
            return _bounded(np.repeat(raw, grid.size, axis=2), self)
        b = previous.reshape(len(raw), -1, grid.size)
        return _bounded(b + grid * np.minimum(raw - b, 0.0), self)

    def step(self, previous, values):
        b = self.absorb(None if previous is None else previous[0], _by_pair(values[0]))
        return (_flat(b),)


@dataclass(frozen=True)
class RecoveryGridFold(Fold):
    """Recovery outputs for parallel lists of (alpha, allowance) configurations.

    Inputs: raw, candidate.
    """

    arrays: bool = True
    alphas: tuple[float, ...] = (1.0,)
    allowances: tuple[float, ...] = (0.0,)
    budget: float = 0.01
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    def step(self, previous, values):
        raw, candidate = map(_by_pair, values)
        grid, rise = np.asarray(self.alphas), np.asarray(self.allowances)
        if previous is None:
            b = _bounded(np.repeat(raw, grid.size, axis=2), self)
            last = np.full(b.shape, self.y_max)
        else:
            b, last = (x.reshape(len(raw), -1, grid.size) for x in previous)
            gap = raw - b
            b = _bounded(b + np.where(gap <= 0.0, grid * gap, np.minimum(gap, rise)), self)
        low = np.maximum(self.y_min, b - self.budget)
        high = np.maximum(
            low, np.minimum(np.minimum(self.y_max, b + self.budget), last + rise)
        )
        return _flat(b), _flat(np.minimum(np.maximum(candidate, low), high))


@dataclass(frozen=True)
class GuardGridFold(StateGridFold):
    """State for every alpha and guarded output for every (alpha, budget), in one pass.

    Inputs: raw, candidate.  Output arrays are alpha-major.
    """

    budgets: tuple[float, ...] = (0.01,)

    def step(self, previous, values):
        raw, candidate = map(_by_pair, values)
        b = self.absorb(None if previous is None else previous[0], raw)
        width = np.asarray(self.budgets)
        low = np.maximum(self.y_min, b[..., None] - width)
        high = np.minimum(self.y_max, b[..., None] + width)
        p = np.minimum(np.maximum(candidate[..., None], low), high)
        if previous is not None:
            p = np.minimum(previous[1].reshape(p.shape), p)
        else:
            p = np.minimum(self.y_max, p)
        return _flat(b), _flat(p)


@dataclass(frozen=True)
class GridErrors(Fold):
    """Summed absolute errors of a whole parameter grid and scored records, one row per unit.

    Wraps a grid fold whose last state column is the grid output; inputs are those of
    ``inner`` plus the truth.  ``offsets`` scores shifted, clipped outputs instead.
    """

    arrays: bool = True
    inner: Fold | None = None
    offsets: tuple[float, ...] = ()
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    @property
    def carried(self) -> tuple[str, ...]:
        return self.inner.state

    @property
    def emitted(self) -> tuple[str, ...]:
        return self.state[-2:]

    def resume(self, carried):
        return (*carried, None, None)

    def step(self, previous, values):
        *inputs, truth = values
        total, scored = (None, None) if previous is None else previous[-2:]
        state = self.inner.step(None if previous is None else previous[:-2], inputs)
        output = state[-1]
        if self.offsets:
            output = _flat(_bounded(output[..., None] + np.asarray(self.offsets), self))
        known = np.isfinite(truth)[:, None]  # others are projected, but not scored
        error = np.where(known, np.abs(output - truth[:, None]), 0.0)
        if total is None:
            return (*state, error, known.astype(float))
        return (*state, total + error, scored + known)


def _column(column: pa.Array) -> np.ndarray:
    """A scalar column as (rows,), an array column of one length as (rows, length)."""
    if not pa.types.is_list(column.type):
        return column.to_numpy(zero_copy_only=False).astype(float)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or len({*np.diff(column.offsets.to_numpy()).tolist()}) > 1:
        raise ValueError("array inputs of a grid need one length in all records")
    return flat.reshape(len(column), -1)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


#: Records of which a task holds grid states at a time; a unit goes on over any number of them.
GRID_ROWS = 2_000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, GRID_ROWS):
            yield batch.slice(at, GRID_ROWS)


def _grid_batches(fold: Fold, part: list[str], starts: bool, last_only: bool):
    """Streaming kernel of grid folds: all units of a batch step together, rank by rank.

    Units are ordered by length inside the batch, so the units that still have records are
    always the first ones; the last unit of a batch stays open for the next one. A batch is a
    slice of ``GRID_ROWS`` records, so memory does not follow the size of what Spark hands over.
    """
    start_columns = [f"{_START}{s}" for s in fold.carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, fields = None, None, None
        for batch in sliced(batches):
            values = [_column(batch.column(n)) for n in fold.inputs]
            fields = [batch.schema.field(c) for c in part]
            names = list(zip(*[batch.column(c).to_pylist() for c in part]))
            first = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]]]
            lengths = np.diff([*first, len(names)])
            order = np.argsort(-lengths, kind="stable")
            at, sizes = np.asarray(first)[order], lengths[order]
            resumed = np.zeros(len(first), bool)
            if starts:
                begin = batch.column(start_columns[0])
                resumed = np.asarray(begin.take(pa.array(at)).is_valid())
            open_unit = names[0] == key
            if key is not None and not open_unit and last_only:
                yield _ends([key], state, fields)
            every: list[np.ndarray] | None = None
            for rank in range(int(sizes[0])):
                active = int(np.searchsorted(-sizes, -rank, "left"))
                rows = at[:active] + rank
                here = [v[rows] for v in values]
                if rank:
                    current = fold.step(tuple(x[:active] for x in current), here)
                else:
                    carried = open_unit & (order == 0)
                    groups = [(carried, state), (~carried & ~resumed, None)]
                    begun = np.flatnonzero(~carried & resumed)
                    if len(begun):
                        given = tuple(_column(batch.column(c).take(pa.array(at[begun]))) for c in start_columns)
                        groups.append((~carried & resumed, fold.resume(given)))
                    current = _joined(fold, groups, here)
                if every is None:
                    kept = len(first) if last_only else len(names)
                    every = [np.empty((kept, x.shape[1])) for x in current]
                for whole, x in zip(every, current):
                    whole[order[:active] if last_only else rows] = x
            last = -1 if last_only else int(first[-1] + lengths[-1] - 1)
            key = names[-1]
            state = tuple(x[last][None, :].copy() for x in every)
            if last_only:
                if len(first) > 1:
                    yield _ends([names[i] for i in first[:-1]], [x[:-1] for x in every], fields)
                continue
            kept = [n for n in batch.schema.names if n not in start_columns]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], *map(_lists, every)], names=[*kept, *fold.state]
            )
        if last_only and key is not None:
            yield _ends([key], state, fields)

    def _ends(keys: list[tuple], states, fields) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in keys], type=f.type) for i, f in enumerate(fields)]
        out = [_lists(x) for name, x in zip(fold.state, states) if name in fold.emitted]
        return pa.RecordBatch.from_arrays([*columns, *out], names=[*part, *fold.emitted])

    return run


def _joined(fold: Fold, groups: list, values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The first step of a batch: each group of units goes on from its own kind of state."""
    out: list[np.ndarray] | None = None
    for chosen, previous in groups:
        if not chosen.any():
            continue
        state = fold.step(previous, [v[chosen] for v in values])
        if out is None:
            out = [np.empty((len(chosen), x.shape[1])) for x in state]
        for whole, x in zip(out, state):
            whole[chosen] = x
    return tuple(out)


def _batches(fold: Fold, part: list[str], starts: bool, last_only: bool):
    """Streaming kernel for ``mapInArrow`` over sorted partitions."""
    if fold.arrays:
        return _grid_batches(fold, part, starts, last_only)
    start_columns = [f"{_START}{s}" for s in fold.carried]
    def values(batch: pa.RecordBatch, names: list[str]):
        return list(zip(*[batch.column(n).to_pylist() for n in names]))

    def state_columns(states: list[tuple]) -> list[pa.Array]:
        return [pa.array(list(column), type=pa.float64()) for column in zip(*states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, key_types = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = values(batch, list(fold.inputs))
            begin = values(batch, start_columns) if starts else None
            states, ends = [], []
            for i, here in enumerate(values(batch, part)):
                if here != key:
                    if key is not None:
                        ends.append((key, state))
                    key, state = here, None
                    if starts and begin[i][0] is not None:
                        state = fold.resume(begin[i])
                state = fold.step(state, rows[i])
                states.append(state)
            if last_only:
                key_types = [batch.schema.field(c) for c in part]
                if ends:
                    yield _ends(ends, key_types)
                continue
            kept = [n for n in batch.schema.names if n not in start_columns]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], *state_columns(states)],
                names=[*kept, *fold.state],
            )
        if last_only and key is not None:
            yield _ends([(key, state)], key_types)

    def _ends(ends: list[tuple], key_types: list[pa.Field]) -> pa.RecordBatch:
        keys = [
            pa.array([k[i] for k, _ in ends], type=f.type) for i, f in enumerate(key_types)
        ]
        return pa.RecordBatch.from_arrays(
            [*keys, *state_columns([s for _, s in ends])], names=[*part, *fold.state]
        )

    return run


def _schema(fold: Fold, base: T.StructType) -> T.StructType:
    fields = [f for f in base.fields if not f.name.startswith(_START)]
    return T.StructType([*fields, *[T.StructField(s, fold.state_type) for s in fold.state]])


def run_fold(t: Trajectories, fold: Fold) -> Trajectories:
    """Arrow form of the fold: one shuffle, sorted partitions, constant memory per task."""
    if not t.cut:
        frame = t.sorted_frame().mapInArrow(
            _batches(fold, t.part, False, False), _schema(fold, t.frame.schema)
        )
        return t.with_frame(frame)
    started = t.frame.join(F.broadcast(_settle(t, fold)), t.part, "left")
    ready = t.with_frame(started)
    frame = ready.sorted_frame().mapInArrow(
        _batches(fold, t.part, True, False), _schema(fold, started.schema)
    )
    return t.with_frame(frame)


def grid_unit_errors(
    t: Trajectories, grid: Fold, truth: str, offsets: tuple[float, ...] = ()
) -> DataFrame:
    """Unit MAE of every grid point as one array column ``errors`` with ``records``.

    Records without a truth are projected but not scored: ``records`` counts scored ones,
    and a unit without any has NULL errors. Missing predictions stop the job.

    Records leave the task only as one summed array per unit, so a grid of any size
    costs one shuffle of the input and none of the expanded grid.
    """
    fold = GridErrors(
        inputs=(*grid.inputs, truth), state=(*grid.state, "errors", "scored"), inner=grid, offsets=offsets
    )
    needed = [*t.part, *t.keys.order, *dict.fromkeys(fold.inputs)]
    checked = {c: require_finite_input(t.frame, c) for c in dict.fromkeys(grid.inputs)}
    work = t.with_frame(t.frame.select(*needed).withColumns(checked))
    if t.cut:
        work = work.with_frame(work.frame.join(F.broadcast(_settle(work, grid)), t.part, "left"))
    sums = work.sorted_frame().mapInArrow(
        _batches(fold, t.part, t.cut, True), _end_schema(fold, work.frame, t.part)
    )
    if t.cut:
        added = [
            F.aggregate(
                F.collect_list(c),
                F.array().cast("array<double>"),
                lambda a, x: F.when(F.size(a) == 0, x).otherwise(
                    F.zip_with(a, x, lambda p, q: p + q)
                ),
            ).alias(c)
            for c in fold.emitted
        ]
        sums = sums.groupBy(*t.keys.group).agg(*added)
    records = F.get("scored", F.lit(0)).cast("bigint")
    return sums.select(
        *t.keys.group,
        records.alias("records"),
        F.transform("errors", lambda e: F.try_divide(e, records)).alias("errors"),
    )


def require_finite_input(frame: DataFrame, column: str):
    """The column, or an error where it (or one entry of an array) is missing or not finite."""
    if not isinstance(frame.schema[column].dataType, T.ArrayType):
        return require_finite(column, column)
    values = F.col(column)
    broken = values.isNull() | F.exists(values, lambda v: ~F.coalesce(is_finite(v), F.lit(False)))
    message = F.lit(f"{column}: missing or non-finite entry")
    return F.when(broken, F.raise_error(message).cast(frame.schema[column].dataType)).otherwise(values)


def _end_schema(fold: Fold, frame: DataFrame, part: list[str]) -> T.StructType:
    keys = [f for f in frame.select(*part).schema.fields]
    return T.StructType([*keys, *[T.StructField(s, fold.state_type) for s in fold.emitted]])


def _settle(t: Trajectories, fold: Fold) -> DataFrame:
    """State entering every later piece of the cut units (small: one row per piece)."""
    part, group = t.part, t.keys.group
    pieces = t.frame.groupBy(*part).count().select(*part)
    long_units = pieces.filter(F.col(PIECE) > 0).select(*group).distinct()
    pieces = durable(pieces.join(F.broadcast(long_units), group, "left_semi"))
    records = t.frame.select(*part, *t.keys.order, *dict.fromkeys(fold.inputs))
    by_piece = Window.partitionBy(*group).orderBy(PIECE)
    names = [f"{_START}{s}" for s in fold.state]

    guess = F.lit(fold.guess) if fold.non_increasing else F.lit(None).cast(fold.state_type)
    starts = pieces.withColumns(
        {n: F.when(F.col(PIECE) > F.min(PIECE).over(by_piece), guess) for n in names}
    )
    ends = None
    unsettled = starts
    while True:
        work = t.with_frame(records.join(F.broadcast(unsettled), part))
        fresh = work.sorted_frame().mapInArrow(
            _batches(fold, part, True, True),
            _end_schema(fold, work.frame, part),
        )
        if ends is None:
            ends = durable(fresh)
        else:
            kept = ends.join(F.broadcast(unsettled.select(*part)), part, "left_anti")
            ends = durable(kept.unionByName(fresh))
        if fold.non_increasing:
            # A state that never rises is bounded by every earlier end, not just the last.
            earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
            handed = {n: F.min(s).over(earlier) for n, s in zip(names, fold.state)}
        else:
            handed = {n: F.lag(s).over(by_piece) for n, s in zip(names, fold.state)}
        proposed = ends.select(*part, *[c.alias(n) for n, c in handed.items()])
        same = F.lit(True)
        for n in names:
            same = same & F.col(f"new.{n}").eqNullSafe(F.col(f"old.{n}"))
        unsettled = durable(
            proposed.alias("new")
            .join(starts.alias("old"), part)
            .filter(~same)
            .select(*part, *[F.col(f"new.{n}").alias(n) for n in names])
        )
        starts = durable(proposed)
        if unsettled.isEmpty():
            return starts.filter(F.col(names[0]).isNotNull())


def state_by_array(
    t: Trajectories,
    raw: str,
    out: str,
    alpha: float,
    y_min: float = Y_MIN,
    y_max: float = Y_MAX,
) -> Trajectories:
    """JVM form of ``StateFold`` for short units: sort, fold and explode one array per unit."""
    record = F.struct(*t.keys.order, *[c for c in t.frame.columns if c not in t.keys.record])
    units = t.frame.groupBy(*t.keys.group).agg(F.sort_array(F.collect_list(record)).alias("recs"))

    def bounded(x):
        return F.least(F.greatest(x, F.lit(y_min)), F.lit(y_max))

    def absorb(done, rec):
        last = F.element_at(done, -1)
        new = F.when(F.size(done) == 0, bounded(rec[raw])).otherwise(
            bounded(last + F.lit(alpha) * F.least(rec[raw] - last, F.lit(0.0)))
        )
        return F.concat(done, F.array(new))

    states = F.aggregate("recs", F.array().cast("array<double>"), absorb)
    columns = [c for c in t.frame.columns if c not in t.keys.group]
    frame = (
        units.select(*t.keys.group, "recs", states.alias("states"))
        .select(*t.keys.group, F.explode(F.arrays_zip("recs", "states")).alias("z"))
        .select(
            *t.keys.group, *[F.col(f"z.recs.{c}") for c in columns], F.col("z.states").alias(out)
        )
    )
    return t.with_frame(frame)
