"""Nested evaluation on pair-specific predictions against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from railguard.operators import audits, folds
from railguard.operators.folds import GuardGridFold, RecoveryGridFold, StateGridFold, grid_unit_errors, run_fold
from railguard.operators.layout import Keys, Trajectories
from railguard.plans import nested, workflows

KEYS = Keys(order=("order_key",))
SCHEMA = "domain string, unit string, order_key bigint, truth double, raw_baseline double, raw_candidate double"


def rows(seed=3, domains="abcd", units=5, longest=40):
    draw = random.Random(seed)
    out = []
    for d in domains:
        for u in range(units):
            for k in range(draw.randrange(1, longest)):
                truth = draw.choice([1.1 - k / 50 + draw.random() / 30] * 9 + [None])
                out.append((d, f"{d}{u}", k, truth, 1.05 - k / 45 + draw.random() / 9, 1.1 - k / 55 + draw.random() / 20))
    return out


@pytest.fixture(scope="module")
def given():
    return rows()


def trajectories(spark, data, piece_rows=10**6):
    return Trajectories.plan(spark.createDataFrame(data, SCHEMA).repartition(4), KEYS, piece_rows)


def by_unit(data):
    units = {}
    for d, u, k, *v in sorted(data):
        units.setdefault((d, u), []).append(v)
    return units


def shifts(data):
    """Levels of both raw columns by domain."""
    out = {}
    for d in sorted({r[0] for r in data}):
        known = [r for r in data if r[0] == d and r[3] is not None]
        out[d] = [sum(r[3] - r[4 + i] for r in known) / len(known) for i in range(2)]
    return out


def clip(x):
    return min(max(x, 0.0), 1.3)


def states(raw, alpha):
    out = []
    for x in raw:
        out.append(clip(x) if not out else clip(out[-1] + alpha * min(x - out[-1], 0.0)))
    return out


def recovered(raw, cand, alpha, rise, w=0.01):
    b, p = [], []
    for x, c in zip(raw, cand):
        if not b:
            b.append(clip(x))
            last = 1.3
        else:
            gap = x - b[-1]
            b.append(clip(b[-1] + (alpha * gap if gap <= 0 else min(gap, rise))))
            last = p[-1]
        low = max(0.0, b[-1] - w)
        p.append(min(max(c, low), max(low, min(1.3, b[-1] + w, last + rise))))
    return b, p


@pytest.mark.parametrize("piece_rows", [10**6, 7])
def test_vectorised_grids_equal_the_scalar_recursion(spark, given, piece_rows):
    t = trajectories(spark, given, piece_rows)
    alphas = (1.0, 0.3, 0.05)
    done = run_fold(t, StateGridFold(inputs=("raw_baseline",), state=("s",), alphas=alphas)).frame.collect()
    found = {(r["unit"], r["order_key"]): r["s"] for r in done}
    for (_, u), values in by_unit(given).items():
        for i, a in enumerate(alphas):
            assert [found[u, k][i] for k in range(len(values))] == states([v[1] for v in values], a)
    fold = RecoveryGridFold(inputs=("raw_baseline", "raw_candidate"), state=("b", "p"), alphas=(0.3, 1.0), allowances=(0.002, 0.01))
    for r in grid_unit_errors(t, fold, "truth").collect():
        values = by_unit(given)[r["domain"], r["unit"]]
        scored = [v[0] for v in values if v[0] is not None]
        assert r["records"] == len(scored)
        for i, (a, rise) in enumerate(((0.3, 0.002), (1.0, 0.01))):
            _, p = recovered([v[1] for v in values], [v[2] for v in values], a, rise)
            errors = [abs(x - v[0]) for x, v in zip(p, values) if v[0] is not None]
            assert r["errors"][i] == (pytest.approx(sum(errors) / len(errors), abs=1e-14) if errors else None)


@pytest.mark.parametrize("piece_rows", [10**6, 9])
def test_pair_scores_use_the_pair_that_excludes_both(spark, given, piece_rows):
    pairs, outer = nested.calibrated_pairs(trajectories(spark, given, piece_rows))
    levels, units = shifts(given), by_unit(given)
    fold = GuardGridFold(inputs=(nested.BASELINES, nested.CANDIDATES), state=("b", "p"), alphas=(0.5, 0.1), budgets=(0.02,))
    found = nested.pair_scores(pairs, fold, [{"alpha": 0.5}, {"alpha": 0.1}]).collect()
    assert len(found) == 4 * 3 * 2
    for r in found:
        source = [d for d in "abcd" if d not in (r["outer_domain"], r["inner_domain"])]
        sb, sc = (sum(levels[d][i] for d in source) / 2 for i in range(2))
        means, records = [], 0
        for (d, _), values in units.items():
            if d != r["inner_domain"]:
                continue
            b, last, errors = states([v[1] + sb for v in values], r["alpha"]), 1.3, []
            for s, v in zip(b, values):
                last = min(last, min(max(v[2] + sc, max(0.0, s - 0.02)), min(1.3, s + 0.02)))
                if v[0] is not None:
                    errors.append(abs(last - v[0]))
            if errors:
                means.append(sum(errors) / len(errors))
                records += len(errors)
        assert (r["units"], r["records"]) == (len(means), records)
        assert r["mae"] == pytest.approx(sum(means) / len(means), abs=1e-12)
    own = {(r["unit"], r["order_key"]): r["raw_candidate"] for r in outer.frame.collect()}
    for (d, u), values in units.items():
        rest = sum(levels[o][1] for o in "abcd" if o != d) / 3
        assert all(own[u, k] == pytest.approx(v[2] + rest, abs=1e-12) for k, v in enumerate(values))


def test_pairs_from_rows_equal_pairs_from_arrays(spark, given):
    t = trajectories(spark, given)
    pairs, _ = nested.calibrated_pairs(t)
    names = list(pairs.names)
    entries = [F.struct(F.lit(o).alias("outer_domain"), F.lit(i).alias("all")) for i, o in enumerate(names)]
    long = pairs.t.frame.select("*", F.inline(F.array(*entries))).filter("outer_domain <> domain")
    place = F.col("all") - (F.col("outer_domain") > F.col("domain")).cast("int")
    long = long.withColumns({c: F.get(f"{c}s", place) for c in ("raw_baseline", "raw_candidate")})
    again = nested.gathered_pairs(long, KEYS, ["raw_baseline", "raw_candidate"])
    columns = [*KEYS.record, "truth", nested.BASELINES, nested.CANDIDATES]
    both = [sorted(map(str, p.t.frame.select(*columns).collect())) for p in (pairs, again)]
    assert both[0] == both[1]
    short = nested.gathered_pairs(long.filter("NOT (unit = 'a0' AND outer_domain = 'b')"), KEYS, ["raw_baseline"])
    with pytest.raises(Exception, match="lacks predictions"):
        short.t.frame.collect()


def test_radix_medians_are_exact(spark, given):
    pairs, _ = nested.calibrated_pairs(trajectories(spark, given))
    draw = random.Random(5)
    names, alphas = list(pairs.names), [0.5, 0.2]
    pool = [0.0, -0.0, 1e-310, -1e-310, 0.25, -0.25, 1.0, 1e300]
    data = []
    for i in range(400):
        d = names[draw.choice([0, 0, 0, 1, 2, 3])]
        s = [draw.choice([*pool, draw.gauss(0, 1)]) for _ in range(6)]
        data.append((d, 0.0, draw.random(), [float(x) for x in s]))
    df = spark.createDataFrame(data, "domain string, truth double, weight double, states array<double>").repartition(40)
    found = nested.pair_medians(pairs, df, alphas)
    for o in names:
        for a in range(2):
            cells = []
            for d, truth, w, s in data:
                if d != o:
                    cells.append((truth - s[2 * pairs.others(d).index(o) + a], w))
            cells.sort()
            half, total = sum(w for _, w in cells) / 2, 0.0
            for value, w in cells:
                total += w
                if total >= half * (1 - 2e-12):
                    break
            assert found[o, alphas[a]] == value


def test_ordered_keys_keep_the_order_of_doubles():
    values = np.array([-math.inf, -1e300, -2.0, -1e-310, 0.0, 1e-310, 0.5, 3.0, 1e300, math.inf])
    keys = nested._ordered(values)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [nested._double(int(k)) for k in keys] == values.tolist()
    assert nested._ordered(np.array([-0.0]))[0] == nested._ordered(np.array([0.0]))[0]


@pytest.mark.parametrize("piece_rows", [10**6, 6])
def test_recovery_outer_run_and_certificates(spark, given, piece_rows):
    pairs, outer = nested.calibrated_pairs(trajectories(spark, given, piece_rows))
    selected = nested.durable(nested.select_recovery(pairs, [1.0, 0.1], [0.0, 0.002, 0.01], 0.01))
    choice = {r["outer_domain"]: r for r in selected.collect()}
    done = nested.recovery_predictions(outer, selected, 0.01)
    found = {(r["unit"], r["order_key"]): r for r in done.frame.collect()}
    moved = 0.0
    for (d, u), values in by_unit([(r["domain"], r["unit"], r["order_key"], r["truth"], r["raw_baseline"], r["raw_candidate"]) for r in found.values()]).items():
        raw, cand = [v[1] for v in values], [v[2] for v in values]
        b, p = recovered(raw, cand, choice[d]["alpha"], choice[d]["recovery"])
        sb, sp = recovered(raw, cand, choice[d]["strict_alpha"], 0.0)
        for k in range(len(values)):
            r = found[u, k]
            assert [r[c] for c in nested.RECOVERY_ARMS] == [b[k], p[k], sb[k], sp[k]]
            assert (r["plain_state"], r["plain_output"]) == (sb[k], sp[k])
            moved = max(moved, abs(p[k] - b[k]))
    c = nested.recovery_certificates(done, 0.01).first()
    assert c["maximum_prefix_replay_difference"] == c["maximum_zero_recovery_difference"] == 0.0
    assert c["maximum_displacement"] == moved <= 0.01 + 1e-12 and c["maximum_regret"] <= 0.01 + 1e-12
    assert c["maximum_state_recovery_excess"] <= 1e-12 and c["maximum_output_recovery_excess"] <= 1e-12
    assert 0 <= c["minimum_prediction"] <= c["maximum_prediction"] <= 1.3


def test_path_does_not_depend_on_the_cuts(spark, given):
    whole, cut = (
        sorted(nested.path_outer_scores(trajectories(spark, given, n), [1.0, 0.2], [0.0, 0.01]).collect(), key=str)
        for n in (10**6, 8)
    )
    for a, b in zip(whole, cut, strict=True):
        for x, y in zip(a, b):
            assert x == (pytest.approx(y, abs=1e-12) if isinstance(x, float) else y)


def test_refusals(spark, given):
    with pytest.raises(ValueError, match="3 to"):
        nested.calibrated_pairs(trajectories(spark, [r for r in given if r[0] in "ab"]))
    pairs, _ = nested.calibrated_pairs(trajectories(spark, given))
    hole = F.when(F.col("order_key") == 0, F.array(F.lit(1.0), F.lit(math.nan), F.lit(0.0)))
    bad = pairs.t.with_frame(pairs.t.frame.withColumn(nested.BASELINES, hole.otherwise(F.col(nested.BASELINES))))
    fold = StateGridFold(inputs=(nested.BASELINES,), state=("b",), alphas=(0.5,))
    with pytest.raises(Exception, match="non-finite"):
        grid_unit_errors(bad, fold, "truth").collect()


def test_exact_sums_do_not_depend_on_the_cuts(spark):
    from railguard.operators.ordering import cumulative_charge, elapsed_with_resets

    draw = random.Random(11)
    clock, data = 0.0, []
    for k in range(800):
        clock = draw.random() * 5 if draw.random() < 0.02 else clock + draw.random() * 700 / 7
        data.append(("a", "u", k, clock, draw.gauss(0, 1.3)))
    df = spark.createDataFrame(data, "domain string, unit string, order_key bigint, clock double, amps double")
    results = []
    for piece_rows in (10**6, 40, 7):
        t = Trajectories.plan(df, KEYS, piece_rows)
        done = cumulative_charge(elapsed_with_resets(t, "clock"), "elapsed", "amps").frame
        results.append([tuple(r) for r in done.orderBy("order_key").select("elapsed", "charge").collect()])
    assert results[0] == results[1] == results[2]
    total = charge = 0.0
    for (_, _, _, c0, i0), (_, _, _, c1, i1), (e, q) in zip(data, data[1:], results[0][1:]):
        step = min(max(c1 - c0 if c1 >= c0 else max(c1, 0.0), 0.0), 3600.0)
        total += step
        charge += 0.5 * (i0 + i1) * step / 3600.0
        assert e == pytest.approx(total, abs=1e-9) and q == pytest.approx(charge, abs=1e-9)


def test_grid_states_of_a_task_do_not_follow_the_batch(monkeypatch):
    n, seen = 500, []
    draw = np.random.default_rng(7)
    units = np.sort(draw.integers(0, 60, n))
    data = {"unit": [f"u{u:02}" for u in units], "raw": draw.random(n), "truth": draw.random(n)}

    class Counted(StateGridFold):
        def step(self, previous, values):
            seen.append(len(values[0]))
            return super().step(previous, values)

    def errors(fold, rows):
        monkeypatch.setattr(folds, "GRID_ROWS", rows)
        grid = folds.GridErrors(inputs=("raw", "truth"), state=("s", "errors", "scored"), inner=fold)
        parts = folds._grid_batches(grid, ["unit"], False, True)(iter([pa.RecordBatch.from_pydict(data)]))
        return pa.Table.from_batches(list(parts)).to_pydict()

    fold = Counted(inputs=("raw",), state=("s",), alphas=(1.0, 0.3))
    whole = errors(fold, n)
    assert max(seen) > 7
    seen.clear()
    assert errors(fold, 7) == whole and max(seen) <= 7
    assert whole["unit"] == sorted(set(data["unit"]))


@pytest.mark.parametrize("held", [nested.CELLS_HELD, 1])
def test_shifts_of_states_that_serve_all_pairs(spark, monkeypatch, held):
    """One state per alpha and record, not one per pair: median and error against a plain loop."""
    monkeypatch.setattr(nested, "CELLS_HELD", held)
    draw = random.Random(5)
    data = [(d, draw.random(), draw.randrange(1, 5) / 4, [draw.random(), draw.random()]) for d in "abcd" for _ in range(31)]
    states = spark.createDataFrame(data, "domain string, truth double, weight double, states array<double>")
    pairs = nested.Pairs(Trajectories(states, KEYS), tuple("abcd"))
    got = {(r["outer_domain"], r["alpha"], r["budget"]): r for r in
           nested.shift_scores(pairs, states, [1.0, 0.5], [0.05, 2.0]).collect()}
    assert len(got) == 16
    for (outer, alpha, budget), r in got.items():
        a = [1.0, 0.5].index(alpha)
        inner = sorted((t - s[a], w) for d, t, w, s in data if d != outer)
        total, upto = sum(w for _, w in inner), 0.0
        for median, w in inner:
            upto += w
            if upto >= total / 2:
                break
        shift = min(max(median, -budget), budget)
        assert r["offset"] == shift
        assert r["score"] == pytest.approx(sum(w * abs(x - shift) for x, w in inner) / total, abs=1e-12)


def test_decision_replays_against_the_run_at_hand(spark, given, monkeypatch):
    """The guard runs once over all records and once over the first halves, cut or not."""
    runs = []
    kept = audits.guard
    monkeypatch.setattr(audits, "guard", lambda *a, **k: runs.append(1) or kept(*a, **k))
    scored = [r for r in given if r[3] is not None]
    for piece_rows in (10**6, 7):
        row = workflows.mechanism_decision(
            trajectories(spark, scored, piece_rows), alpha=0.3, budget=0.02, shift=0.01, minimum_wins=1, reps=200
        ).first()
        assert row["replay_difference"] == 0.0 and row["records"] == len(scored)
        assert row["maximum_displacement"] <= 0.02 + 1e-12
    assert len(runs) == 2
