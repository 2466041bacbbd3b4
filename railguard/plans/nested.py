"""Nested leave-one-domain-out evaluation on predictions made for every pair of excluded domains.

Selecting parameters for an outer domain needs, for each other (inner) domain, predictions that
saw neither.  A record of domain ``d`` therefore carries one entry per other domain, sorted by
name, in array columns: entry ``j`` excludes ``d`` and the ``j``-th other domain.  Folds take the
arrays as an axis of their state, so no record is multiplied and one ordered pass scores every
pair and parameter.  Only sums per domain leave the tasks.

Records without a truth are projected but not scored.  At least three domains are needed; their
number is checked against ``MAX_DOMAINS`` before their names are listed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from railguard.functions.columns import Y_MAX, Y_MIN, clip, is_finite
from railguard.operators import inference, metrics
from railguard.operators.folds import (
    Fold,
    GuardGridFold,
    RecoveryGridFold,
    StateGridFold,
    grid_unit_errors,
    run_fold,
    sliced,
)
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.ordering import prefix_part, with_rank
from railguard.operators.reshape import top_one
from railguard.operators.selection import nested_selection
from railguard.session import durable

MAX_DOMAINS = 1_000
BASELINES, CANDIDATES = "raw_baselines", "raw_candidates"
#: Bits of a value that one round of the median search fixes; four rounds fix all 64.
DIGIT = 16
#: Cells (outer domain, alpha) whose sums a task of the median search holds (2^DIGIT doubles each).
CELLS_HELD = 256


@dataclass(frozen=True)
class Pairs:
    """Trajectories whose raw columns are arrays over the excluded other domains."""

    t: Trajectories
    names: tuple[str, ...]

    def others(self, domain: str) -> list[str]:
        return [n for n in self.names if n != domain]


def domain_names(df: DataFrame, domain: str = "domain") -> tuple[str, ...]:
    listed = df.select(domain).distinct().limit(MAX_DOMAINS + 1).collect()
    if not 3 <= len(listed) <= MAX_DOMAINS:
        raise ValueError(f"nested evaluation needs 3 to {MAX_DOMAINS} domains, found {len(listed)}")
    return tuple(sorted(r[0] for r in listed))


def calibrated_pairs(t: Trajectories, truth: str = "truth") -> tuple[Pairs, Trajectories]:
    """Pair-specific inner and leave-one-out outer predictions by domain-equal recalibration.

    Both raw columns are shifted by the mean residual of the source domains, each of which
    weighs the same: all but two for a pair, all but one for the outer predictions.
    """
    keys, columns = t.keys, ("raw_baseline", "raw_candidate")
    names = domain_names(t.frame, keys.domain)
    residuals = [F.avg(F.col(truth) - F.col(c)).alias(c) for c in columns]
    levels = {r[keys.domain]: r for r in t.frame.groupBy(keys.domain).agg(*residuals).collect()}
    rows = []
    for d in names:
        row = [d]
        for c in columns:
            total = sum(levels[n][c] for n in names)
            others = [n for n in names if n != d]
            row.append([(total - levels[o][c] - levels[d][c]) / (len(names) - 2) for o in others])
            row.append((total - levels[d][c]) / (len(names) - 1))
        rows.append(tuple(row))
    kind = t.frame.schema[keys.domain].dataType.simpleString()
    schema = f"`{keys.domain}` {kind}, pairs0 array<double>, own0 double, pairs1 array<double>, own1 double"
    shifts = F.broadcast(t.frame.sparkSession.createDataFrame(rows, schema))  # at most MAX_DOMAINS rows
    joined = t.frame.join(shifts, keys.domain)
    added = {
        name: _shifted(f"pairs{i}", c) for i, (c, name) in enumerate(zip(columns, (BASELINES, CANDIDATES)))
    }
    own = {c: F.col(c) + F.col(f"own{i}") for i, c in enumerate(columns)}
    helpers = ["pairs0", "own0", "pairs1", "own1"]
    inner = joined.withColumns(added).drop(*helpers, *columns)
    return Pairs(t.with_frame(inner), names), t.with_frame(joined.withColumns(own).drop(*helpers))


def _shifted(shifts: str, column: str) -> Column:
    return F.transform(shifts, lambda s: F.col(column) + s)


def _field(structs: str | Column, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def gathered_pairs(long: DataFrame, keys: Keys, values: list[str], truth: str = "truth") -> Pairs:
    """Pair predictions kept as rows (outer_domain, record, values) as arrays, every pair present.

    The arrays are named after ``values`` with an s; rows of one record meet in one exchange.
    """
    names = domain_names(long, keys.domain)
    packed = F.array_sort(F.collect_list(F.struct("outer_domain", *values)))
    records = long.groupBy(*keys.record).agg(F.max(truth).alias(truth), packed.alias("_p"))
    complete = F.when(F.size("_p") == len(names) - 1, F.col("_p")).otherwise(
        F.raise_error(F.lit("a record lacks predictions for some pair")).cast(records.schema["_p"].dataType)
    )
    arrays = [_field(complete, v).alias(f"{v}s") for v in values]
    return Pairs(Trajectories.plan(records.select(*keys.record, truth, *arrays), keys), names)


def _summed(df: DataFrame, columns: list[str], size: int, step: Callable) -> DataFrame:
    """Arrays of ``size`` doubles added up per domain: (domain, pos, total).

    ``step(batch)`` yields (domain, array). Each task emits one array a domain.
    """

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            for name, values in step(batch):
                sums[name] = sums[name] + values if name in sums else values
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["name", "sums"]
            )

    parts = df.select(*columns).mapInArrow(run, "name string, sums array<double>")
    return (
        parts.select("name", F.posexplode("sums").alias("pos", "part"))
        .groupBy("name", "pos")
        .agg(F.sum("part").alias("total"))
    )


def pair_scores(
    pairs: Pairs, fold: Fold, points: list[dict[str, float]], truth: str = "truth",
    offsets: tuple[float, ...] = (), score: str = "mae",
) -> DataFrame:
    """Unit-macro error of every grid point on every (outer, inner) pair."""
    units = grid_unit_errors(pairs.t, fold, truth, offsets).filter("records > 0")
    size, domain = (len(pairs.names) - 1) * len(points), pairs.t.keys.domain

    def step(batch):
        errors = batch.column("errors").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        found = np.asarray(batch.column(domain).to_pylist())
        records = batch.column("records").to_numpy()
        for name in np.unique(found):
            here = found == name
            yield str(name), np.concatenate(([here.sum(), records[here].sum()], errors[here].sum(0)))

    sums = _summed(units, [domain, "records", "errors"], size + 2, step)
    counts = sums.filter("pos < 2").groupBy("name").pivot("pos", [0, 1]).agg(F.first("total"))
    place = F.col("pos") - 2
    # One row per domain and grid point: short lists, so these tables are small.
    spark = units.sparkSession
    listed = spark.createDataFrame(
        [(d, j, o) for d in pairs.names for j, o in enumerate(pairs.others(d))],
        "inner_domain string, pair bigint, outer_domain string",
    )
    grid = spark.createDataFrame(
        [(g, *map(float, p.values())) for g, p in enumerate(points)],
        "point bigint, " + ", ".join(f"`{k}` double" for k in points[0]),
    )
    return (
        sums.filter("pos >= 2")
        .select(
            F.col("name").alias("inner_domain"),
            F.floor(place / len(points)).alias("pair"),
            (place % len(points)).cast("bigint").alias("point"),
            "total",
        )
        .join(counts.select(F.col("name").alias("inner_domain"), F.col("0").alias("units"), F.col("1").alias("records")), "inner_domain")
        .join(F.broadcast(listed), ["inner_domain", "pair"])
        .join(F.broadcast(grid), "point")
        .select(
            "outer_domain", "inner_domain", *points[0],
            F.col("units").cast("bigint").alias("units"), F.col("records").cast("bigint").alias("records"),
            (F.col("total") / F.col("units")).alias(score),
        )
    )


# --- outer runs with a setting per domain ----------------------------------------------------


@dataclass(frozen=True)
class ChosenGuardsFold(Fold):
    """Guard and control states for settings that come with the record.

    Inputs: raw, candidate, and arrays of equal length: guard alphas, budgets, control alphas.
    ``rises``: the largest increase so far of guarded outputs, guard states, control states.
    """

    arrays: bool = True
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    def step(self, previous, values):
        raw, candidate, alphas, budgets, control = (v.reshape(len(v), -1) for v in values)
        shape, bound = alphas.shape, lambda x: np.minimum(np.maximum(x, self.y_min), self.y_max)
        if previous is None:
            b = c = bound(np.broadcast_to(raw, shape))
            last, rises = np.full(shape, self.y_max), np.full((shape[0], 3 * shape[1]), -np.inf)
        else:
            old_b, last, old_c, rises = previous
            b = bound(old_b + alphas * np.minimum(raw - old_b, 0.0))
            c = bound(old_c + control * np.minimum(raw - old_c, 0.0))
        low, high = np.maximum(self.y_min, b - budgets), np.minimum(self.y_max, b + budgets)
        p = np.minimum(last, np.minimum(np.maximum(candidate, low), high))
        if previous is not None:
            rises = np.maximum(rises, np.concatenate((p - last, b - old_b, c - old_c), axis=1))
        return b, p, c, rises


@dataclass(frozen=True)
class ChosenRecoveryFold(Fold):
    """Bounded recovery, its strict form and the plain guard for settings of the record.

    Inputs: raw, candidate, alpha, allowance, strict alpha. Columns: ``states`` and ``outputs``
    (recovery, strict), ``plain`` (state and output of the guard without recovery, by its own
    recursion), ``rises`` (largest increases so far of the recovery state and output).
    """

    arrays: bool = True
    budget: float = 0.01
    y_min: float = Y_MIN
    y_max: float = Y_MAX

    def step(self, previous, values):
        raw, candidate, alpha, allowance, strict = (v.reshape(len(v), 1) for v in values)
        bound = lambda x: np.minimum(np.maximum(x, self.y_min), self.y_max)
        grid, rise = np.concatenate((alpha, strict), 1), np.concatenate((allowance, 0 * allowance), 1)
        if previous is None:
            b = bound(np.repeat(raw, 2, axis=1))
            last, plain_b, plain_last = np.full(b.shape, self.y_max), bound(raw), np.full(raw.shape, self.y_max)
            rises = np.full(b.shape, -np.inf)
        else:
            old, last, plain, rises = previous
            gap = raw - old
            b = bound(old + np.where(gap <= 0.0, grid * gap, np.minimum(gap, rise)))
            plain_b, plain_last = plain[:, :1], plain[:, 1:]
            plain_b = bound(plain_b + strict * np.minimum(raw - plain_b, 0.0))
        low = np.maximum(self.y_min, b - self.budget)
        high = np.maximum(low, np.minimum(np.minimum(self.y_max, b + self.budget), last + rise))
        p = np.minimum(np.maximum(candidate, low), high)
        plain_p = np.minimum(
            plain_last,
            np.minimum(np.maximum(candidate, np.maximum(self.y_min, plain_b - self.budget)), np.minimum(self.y_max, plain_b + self.budget)),
        )
        if previous is not None:
            rises = np.maximum(rises, np.concatenate((b[:, :1] - old[:, :1], p[:, :1] - last[:, :1]), 1))
        return b, p, np.concatenate((plain_b, plain_p), 1), rises


def with_settings(outer: Trajectories, settings: DataFrame) -> Trajectories:
    """Every record with the settings of its (outer) domain: one row per domain, broadcast."""
    named = settings.withColumnRenamed("outer_domain", outer.keys.domain)
    return outer.with_frame(outer.frame.join(F.broadcast(named), outer.keys.domain))


# --- candidate-free control ------------------------------------------------------------------


def select_guard(pairs: Pairs, alphas: list[float], budget: float, truth: str = "truth") -> DataFrame:
    fold = GuardGridFold(inputs=(BASELINES, CANDIDATES), state=("b", "p"), alphas=tuple(alphas), budgets=(budget,))
    scores = pair_scores(pairs, fold, [{"alpha": a} for a in alphas], truth)
    return nested_selection(scores, ["alpha"], [F.desc("alpha")])


def select_control(pairs: Pairs, alphas: list[float], offsets: list[float], truth: str = "truth") -> DataFrame:
    """Best (alpha, offset) of clip(state + offset) per outer domain; ties to small offsets."""
    fold = StateGridFold(inputs=(BASELINES,), state=("b",), alphas=tuple(alphas))
    points = [{"alpha": a, "offset": o} for a in alphas for o in offsets]
    scores = pair_scores(pairs, fold, points, truth, tuple(offsets))
    order = [F.asc(F.abs("offset")), F.desc("alpha"), F.desc("offset")]
    return nested_selection(scores, ["alpha", "offset"], order)


def control_predictions(
    t: Trajectories, alphas: list[float], offsets: list[float], budget: float, truth: str = "truth"
) -> DataFrame:
    """Outer predictions of the guard and of the candidate-free control, settings included."""
    pairs, outer = calibrated_pairs(t, truth)
    guard = select_guard(pairs, alphas, budget, truth).select("outer_domain", F.col("alpha").alias("guard_alpha"))
    control = select_control(pairs, alphas, offsets, truth).select(
        "outer_domain", F.col("alpha").alias("control_alpha"), F.col("offset").alias("control_offset")
    )
    chosen = with_settings(outer, durable(guard.join(control, "outer_domain")))
    frame = chosen.frame.withColumns(
        {"ga": F.array("guard_alpha"), "gw": F.array(F.lit(float(budget))), "ca": F.array("control_alpha")}
    )
    fold = ChosenGuardsFold(
        inputs=("raw_baseline", "raw_candidate", "ga", "gw", "ca"), state=("b", "p", "c", "rises")
    )
    done = run_fold(chosen.with_frame(frame), fold).frame
    first = lambda c: F.get(c, F.lit(0))
    return done.select(
        *t.keys.record, truth, "guard_alpha", "control_alpha", "control_offset",
        first("b").alias("guard_state"), first("p").alias("guarded"), first("c").alias("control_state"),
        clip(first("c") + F.col("control_offset"), Y_MIN, Y_MAX).alias("control"),
    )


def arm_scores(predictions: DataFrame, arms: list[str], truth: str = "truth", keys: Keys = Keys()) -> DataFrame:
    """Unit-macro error of several arms per domain, with units and scored records."""
    scored = predictions.filter(is_finite(truth))
    units = scored.groupBy(*keys.group).agg(
        *[F.avg(F.abs(F.col(a) - F.col(truth))).alias(a) for a in arms], F.count(F.lit(1)).alias("records")
    )
    return units.groupBy(keys.domain).agg(
        *[F.avg(a).alias(a) for a in arms],
        F.count(F.lit(1)).alias("units"),
        F.sum("records").alias("records"),
    )


def arm_contrast(
    domains: DataFrame, arm: str, reference: str, reps: int, seed: int, keys: Keys = Keys()
) -> DataFrame:
    """Domain-equal means of two arms, their difference with its interval, counts and the gate."""
    contrast = domains.select(
        F.lit(f"{arm}-{reference}").alias("contrast_id"), F.col(keys.domain).alias("domain"),
        (F.col(arm) - F.col(reference)).alias("difference"), arm, reference,
    )
    means = contrast.groupBy("contrast_id").agg(F.avg(arm).alias(arm), F.avg(reference).alias(reference))
    summary = metrics.contrast_summary(contrast, ["contrast_id"]).join(means, "contrast_id")
    interval = inference.cluster_bootstrap(contrast, reps, seed).select("contrast_id", "low", "high")
    gate = (F.col("mean_difference") < 0) & (F.col("high") < 0)
    return summary.join(interval, "contrast_id").withColumn("gate_passed", gate)


# --- budget path -----------------------------------------------------------------------------


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = (values + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63))).view(np.uint64)


def _double(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _residuals(pairs: Pairs, size: int, truth: str):
    """(outer, weights, states, residuals) of a batch of states, by inner domain and pair.

    States that do not depend on the pair are given once.
    """
    domain = pairs.t.keys.domain
    others = {d: pairs.others(d) for d in pairs.names}

    def split(batch):
        states = batch.column("states").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, size)
        residual = batch.column(truth).to_numpy()[:, None, None] - states
        weight = batch.column("weight").to_numpy()
        found = np.asarray(batch.column(domain).to_pylist())
        for name in np.unique(found):
            here = found == name
            for j, outer in enumerate(others[str(name)]):
                j = min(j, states.shape[1] - 1)
                yield outer, weight[here], states[here, j], residual[here, j]

    return split


def pair_medians(
    pairs: Pairs, states: DataFrame, alphas: list[float], truth: str = "truth", tolerance: float = 1e-12
) -> dict[tuple[str, float], float]:
    """Weighted median residual per (outer domain, alpha) over all its inner domains.

    Radix selection: each of four rounds sums the weights of the next 16 bits of the ordered
    values inside the prefix found so far, so a task holds 2^16 sums a cell however many
    records there are, and the result is a residual itself, exact in all its bits.
    """
    size, domain = len(alphas), pairs.t.keys.domain
    split = _residuals(pairs, size, truth)
    prefix: dict[tuple[str, int], int] = {}
    before: dict[tuple[str, int], float] = {}
    half: dict[tuple[str, int], float] = {}

    def emitted(sums: dict[tuple[str, int], np.ndarray]):
        for (outer, a), found in sums.items():
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([outer] * len(at), pa.string()), pa.array(np.full(len(at), a, np.int32)), pa.array(at), pa.array(found[at])],
                ["outer_domain", "cell", "digit", "weight"],
            )

    for depth in range(64 // DIGIT):
        shift = np.uint64(64 - DIGIT * (depth + 1))
        known = dict(prefix)

        def run(batches, shift=shift, known=known, depth=depth):
            sums: dict[tuple[str, int], np.ndarray] = {}
            for batch in sliced(batches):
                for outer, weight, _, residual in split(batch):
                    for a in range(size):
                        digits = _ordered(np.ascontiguousarray(residual[:, a])) >> shift
                        inside = np.full(len(digits), True)
                        if depth:
                            inside = digits >> np.uint64(DIGIT) == np.uint64(known[outer, a])
                        at = (digits[inside] & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
                        if not len(at):
                            continue
                        found = np.bincount(at, weight[inside], 1 << DIGIT)
                        sums[outer, a] = sums[outer, a] + found if (outer, a) in sums else found
                    if len(sums) > CELLS_HELD:
                        yield from emitted(sums)
                        sums.clear()
            yield from emitted(sums)

        rows = states.select(domain, truth, "weight", "states").mapInArrow(
            run, "outer_domain string, cell int, digit bigint, weight double"
        )
        summed = rows.groupBy("outer_domain", "cell", "digit").agg(F.sum("weight").alias("weight"))
        cells = Window.partitionBy("outer_domain", "cell")
        upto = F.sum("weight").over(cells.orderBy("digit"))
        ranked = summed.withColumns({"upto": upto, "total": F.sum("weight").over(cells)})
        if depth:
            spark = rows.sparkSession
            earlier = [(*k, float(before[k]), float(half[k])) for k in prefix]
            table = spark.createDataFrame(earlier, "outer_domain string, cell int, passed double, half double")
            ranked = ranked.join(F.broadcast(table), ["outer_domain", "cell"])
        else:
            ranked = ranked.withColumns({"passed": F.lit(0.0), "half": F.col("total") * (0.5 - tolerance)})
        # Rounded sums may end just below one half: then the last digit is the one.
        reach = (F.col("passed") + F.col("upto") >= F.col("half")) | (F.col("upto") >= F.col("total"))
        hit = ranked.filter(reach).groupBy("outer_domain", "cell").agg(
            F.min_by(F.struct("digit", "weight", "upto", "passed", "half"), "digit").alias("h")
        )
        for r in hit.select("outer_domain", "cell", "h.*").collect():  # domains x alphas rows
            k = r["outer_domain"], r["cell"]
            prefix[k] = prefix.get(k, 0) << DIGIT | r["digit"]
            before[k], half[k] = r["passed"] + r["upto"] - r["weight"], r["half"]
    return {(o, alphas[a]): _double(key) for (o, a), key in prefix.items()}


def shift_scores(
    pairs: Pairs, states: DataFrame, alphas: list[float], budgets: list[float], truth: str = "truth"
) -> DataFrame:
    """(outer_domain, alpha, budget, offset, score): the median residual of the inner domains,
    clipped to the budget, and the weighted inner error with that shift."""
    size, domain, spark = len(alphas), pairs.t.keys.domain, states.sparkSession
    medians = pair_medians(pairs, states, alphas, truth)
    offsets = {k: np.clip(m, -np.asarray(budgets), np.asarray(budgets)) for k, m in medians.items()}
    split, width = _residuals(pairs, size, truth), len(budgets)

    def step(batch):
        for outer, weight, _, residual in split(batch):
            grid = np.array([offsets[outer, a] for a in alphas])
            moved = np.abs(residual[:, :, None] - grid).reshape(len(weight), -1)
            yield outer, np.concatenate(([weight.sum()], weight @ moved))

    columns = [domain, truth, "weight", "states"]
    sums = _summed(states, columns, size * width + 1, step)
    totals = sums.filter("pos = 0").select("name", F.col("total").alias("weights"))
    plan = spark.createDataFrame(
        [(o, float(a), float(b), float(offsets[o, a][k]), i * width + k + 1)
         for o, i, a in ((o, i, a) for o in pairs.names for i, a in enumerate(alphas) if (o, a) in medians) for k, b in enumerate(budgets)],
        "outer_domain string, alpha double, budget double, `offset` double, pos int",
    )
    return (
        sums.withColumnRenamed("name", "outer_domain")
        .join(F.broadcast(plan), ["outer_domain", "pos"])
        .join(totals.withColumnRenamed("name", "outer_domain"), "outer_domain")
        .withColumn("score", F.col("total") / F.col("weights"))
    )


def select_exact_shift(
    pairs: Pairs, alphas: list[float], budgets: list[float], truth: str = "truth"
) -> DataFrame:
    """Per outer domain and budget: the exact-shift control with the smallest inner error.

    The shift is the median residual of all inner records (domains, units and records
    weighted equally in turn), clipped to the budget.
    """
    t, size, domain = pairs.t, len(alphas), pairs.t.keys.domain
    fold = StateGridFold(inputs=(BASELINES,), state=("states",), alphas=tuple(alphas))
    done = run_fold(t, fold).frame.filter(is_finite(truth)).select(*t.keys.group, truth, "states")
    # Five rounds read the states; the ordered pass behind them runs once.
    states = durable(metrics.row_weights(done, t.keys).select(domain, truth, "weight", "states"))
    scored = shift_scores(pairs, states, alphas, budgets, truth)
    margins = states.select(
        domain, F.explode(F.transform("states", lambda s, i: F.struct(i.alias("i"), F.least(s, Y_MAX - s).alias("m")))).alias("z")
    ).groupBy(domain, F.col("z.i").alias("i")).agg(F.min("z.m").alias("margin"))
    spark = states.sparkSession
    named = spark.createDataFrame(
        [(d, j * size + a, o, float(alpha)) for d in pairs.names for j, o in enumerate(pairs.others(d)) for a, alpha in enumerate(alphas)],
        f"`{domain}` string, i int, outer_domain string, alpha double",
    )
    margins = margins.join(F.broadcast(named), [domain, "i"]).groupBy("outer_domain", "alpha").agg(F.min("margin").alias("margin"))
    # Only equal scores are ties; sums are added in any order, so they are compared rounded.
    order = [F.asc(F.round("score", 13)), F.asc(F.abs("offset")), F.desc("alpha"), F.desc("offset")]
    best = top_one(scored, ["outer_domain", "budget"], order)
    return best.join(margins, ["outer_domain", "alpha"]).select(
        "outer_domain", "budget", F.col("alpha").alias("control_alpha"), F.col("offset").alias("control_offset"),
        F.col("score").alias("control_inner_mae"), F.col("margin").alias("boundary_margin"),
    )


def path_selections(pairs: Pairs, alphas: list[float], budgets: list[float], truth: str = "truth") -> DataFrame:
    """Guard alpha and exact-shift control per outer domain and budget, from inner domains only."""
    fold = GuardGridFold(
        inputs=(BASELINES, CANDIDATES), state=("b", "p"), alphas=tuple(alphas), budgets=tuple(budgets)
    )
    points = [{"alpha": a, "budget": b} for a in alphas for b in budgets]
    scores = pair_scores(pairs, fold, points, truth)
    means = scores.groupBy("outer_domain", "budget", "alpha").agg(F.avg("mae").alias("mae"))
    near = F.col("mae") <= F.min("mae").over(Window.partitionBy("outer_domain", "budget")) + 1e-12
    best = top_one(means.withColumn("near", near).filter("near"), ["outer_domain", "budget"], [F.desc("alpha")])
    guard = best.select("outer_domain", "budget", F.col("alpha").alias("guard_alpha"), F.col("mae").alias("guard_inner_mae"))
    return guard.join(select_exact_shift(pairs, alphas, budgets, truth), ["outer_domain", "budget"])


def path_outer_scores(
    t: Trajectories, alphas: list[float], budgets: list[float], truth: str = "truth"
) -> DataFrame:
    """The whole path on the outer domains: errors, differences and certificates per budget."""
    pairs, outer = calibrated_pairs(t, truth)
    chosen = durable(path_selections(pairs, alphas, budgets, truth))
    entry = F.struct("budget", "guard_alpha", "control_alpha", "control_offset")
    plan = chosen.groupBy("outer_domain").agg(F.array_sort(F.collect_list(entry)).alias("plan"))
    work = with_settings(outer, plan)
    picked = {"ga": "guard_alpha", "gw": "budget", "ca": "control_alpha"}
    frame = work.frame.withColumns({name: _field("plan", c) for name, c in picked.items()})
    fold = ChosenGuardsFold(
        inputs=("raw_baseline", "raw_candidate", "ga", "gw", "ca"), state=("b", "p", "c", "rises")
    )
    done = run_fold(work.with_frame(frame), fold).frame.filter(is_finite(truth))
    return _path_metrics(done, chosen, len(budgets), truth, t.keys)


def _path_metrics(done: DataFrame, chosen: DataFrame, size: int, truth: str, keys: Keys) -> DataFrame:
    at = lambda c, k: F.get(c, F.lit(k))
    aggs = [F.count(F.lit(1)).alias("records")]
    for k in range(size):
        off = F.get("plan", F.lit(k))["control_offset"]
        base, guard = F.abs(at("b", k) - F.col(truth)), F.abs(at("p", k) - F.col(truth))
        control = F.abs(clip(at("c", k) + off, Y_MIN, Y_MAX) - F.col(truth))
        aggs.append(
            F.struct(
                F.max(F.get("plan", F.lit(k))["budget"]).alias("budget"),
                F.avg(base).alias("baseline_mae"), F.avg(guard).alias("guard_mae"), F.avg(control).alias("control_mae"),
                F.max(F.abs(at("p", k) - at("b", k))).alias("displacement"), F.max(guard - base).alias("regret"),
                *[F.max(at("rises", j * size + k)).alias(n) for j, n in enumerate(("guard_rise", "baseline_rise", "control_rise"))],
            ).alias(f"k{k}")
        )
    units = done.groupBy(*keys.group).agg(*aggs)
    rows = units.select(*keys.group, "records", F.inline(F.array(*[f"k{k}" for k in range(size)])))
    domains = rows.groupBy(keys.domain, "budget").agg(
        F.count(F.lit(1)).alias("units"), F.sum("records").alias("records"),
        *[F.avg(c).alias(c) for c in ("baseline_mae", "guard_mae", "control_mae")],
        F.max("displacement").alias("maximum_displacement"), F.max("regret").alias("maximum_regret"),
        F.max(F.col("guard_mae") - F.col("baseline_mae")).alias("maximum_unit_harm"),
        *[(F.max(f"{n}_rise") <= 1e-12).alias(f"{n}_nonincreasing") for n in ("guard", "baseline", "control")],
    )
    settings = chosen.withColumnRenamed("outer_domain", keys.domain)
    return domains.join(settings, [keys.domain, "budget"]).withColumns(
        {
            "guard_minus_baseline": F.col("guard_mae") - F.col("baseline_mae"),
            "guard_minus_control": F.col("guard_mae") - F.col("control_mae"),
        }
    )


def path_budget_summary(path: DataFrame, reps: int, seed: int) -> DataFrame:
    """Per budget: domain-equal errors and differences, interval, wins, largest harms."""
    contrast = path.select(
        F.col("budget").cast("string").alias("contrast_id"), "domain", F.col("guard_minus_control").alias("difference")
    )
    interval = inference.cluster_bootstrap(contrast, reps, seed).select("contrast_id", "low", "high")
    summary = path.groupBy("budget").agg(
        F.count(F.lit(1)).alias("domains"),
        *[F.avg(c).alias(c) for c in ("baseline_mae", "guard_mae", "control_mae", "guard_minus_baseline", "guard_minus_control")],
        *metrics.win_tie_loss("guard_minus_control"),
        *[F.max(c).alias(c) for c in ("maximum_displacement", "maximum_regret")],
        F.max("guard_minus_baseline").alias("maximum_domain_harm"),
    )
    return summary.withColumn("contrast_id", F.col("budget").cast("string")).join(interval, "contrast_id").drop("contrast_id")


def path_area_summary(path: DataFrame, reps: int, seed: int, keys: Keys = Keys()) -> DataFrame:
    """Normalised areas under the difference path: mean over domains, interval, wins, sign test."""
    areas = metrics.path_area(path, [keys.domain], "budget", "guard_minus_control")
    contrast = areas.select(
        F.lit("guard-control").alias("contrast_id"), F.col(keys.domain).alias("domain"),
        F.col("normalised_area").alias("difference"),
    )
    return (
        metrics.contrast_summary(contrast, ["contrast_id"])
        .join(inference.cluster_bootstrap(contrast, reps, seed).select("contrast_id", "low", "high"), "contrast_id")
        .join(inference.sign_test(contrast).select("contrast_id", F.col("sign_p")), "contrast_id")
    )


# --- bounded recovery ------------------------------------------------------------------------


def select_recovery(
    pairs: Pairs, alphas: list[float], allowances: list[float], budget: float, truth: str = "truth"
) -> DataFrame:
    """Per outer domain: best (alpha, allowance), and the best without recovery."""
    points = [{"alpha": a, "recovery": r} for a in alphas for r in allowances]
    fold = RecoveryGridFold(
        inputs=(BASELINES, CANDIDATES), state=("b", "p"), budget=budget,
        alphas=tuple(p["alpha"] for p in points), allowances=tuple(p["recovery"] for p in points),
    )
    scores = pair_scores(pairs, fold, points, truth)
    order = [F.asc("recovery"), F.desc("alpha")]
    best = nested_selection(scores, ["alpha", "recovery"], order)
    strict = nested_selection(scores.filter("recovery = 0"), ["alpha", "recovery"], order)
    return best.join(
        strict.select("outer_domain", F.col("alpha").alias("strict_alpha"), F.col("mae").alias("strict_mae")),
        "outer_domain",
    )


RECOVERY_ARMS = ["recovery_state", "recovery_output", "strict_state", "strict_output"]


def recovery_predictions(outer: Trajectories, selected: DataFrame, budget: float, truth: str = "truth") -> Trajectories:
    """Recovery, strict and plain guard on the outer domains, each with its selected setting.

    ``state_rise`` and ``output_rise`` are the largest increases of a unit so far (NULL before
    its second record).
    """
    settings = selected.select("outer_domain", "alpha", "recovery", "strict_alpha")
    return _run_recovery(with_settings(outer, settings), budget)


def _run_recovery(work: Trajectories, budget: float) -> Trajectories:
    fold = ChosenRecoveryFold(
        inputs=("raw_baseline", "raw_candidate", "alpha", "recovery", "strict_alpha"),
        state=("_b", "_p", "_plain", "_rises"), budget=budget,
    )
    done = run_fold(work, fold)
    at = lambda c, k: F.get(c, F.lit(k))
    met = lambda k: F.when(at("_rises", k) > F.lit(float("-inf")), at("_rises", k))
    columns = {
        "recovery_state": at("_b", 0), "recovery_output": at("_p", 0),
        "strict_state": at("_b", 1), "strict_output": at("_p", 1),
        "plain_state": at("_plain", 0), "plain_output": at("_plain", 1),
        "state_rise": met(0), "output_rise": met(1),
    }
    return done.with_frame(done.frame.withColumns(columns).drop("_b", "_p", "_plain", "_rises"))


def recovery_certificates(done: Trajectories, budget: float, truth: str = "truth") -> DataFrame:
    """Eight certificates of the outer run in one row, the replay of each unit's first half included.

    The replay runs on the prefix records themselves, which carry the full run's columns along,
    so nothing is joined.
    """
    frame, moved = done.frame, lambda a, b: F.abs(F.col(a) - F.col(b))
    error = lambda c: F.abs(F.col(c) - F.col(truth))
    main = frame.agg(
        F.max(moved("recovery_output", "recovery_state")).alias("maximum_displacement"),
        F.max(F.when(is_finite(truth), error("recovery_output") - error("recovery_state"))).alias("maximum_regret"),
        F.max(F.col("state_rise") - F.col("recovery")).alias("maximum_state_recovery_excess"),
        F.max(F.col("output_rise") - F.col("recovery")).alias("maximum_output_recovery_excess"),
        F.max(F.greatest(moved("strict_state", "plain_state"), moved("strict_output", "plain_output"))).alias(
            "maximum_zero_recovery_difference"
        ),
        F.min("recovery_output").alias("minimum_prediction"),
        F.max("recovery_output").alias("maximum_prediction"),
    )
    full = {"recovery_state": "_full_state", "recovery_output": "_full_output"}
    kept = [*done.part, *done.keys.order, "raw_baseline", "raw_candidate", "alpha", "recovery", "strict_alpha"]
    carried = frame.select(*kept, *[F.col(c).alias(n) for c, n in full.items()])
    replay = _run_recovery(prefix_part(with_rank(done.with_frame(carried))), budget).frame
    gap = F.greatest(*[moved(c, n) for c, n in full.items()])
    replayed = replay.agg(F.max(gap).alias("maximum_prefix_replay_difference"))
    both = main.unionByName(replayed, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
