"""State and guard on small vectors, properties on random trajectories, cut units."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from railguard.operators import ordering
from railguard.operators.folds import GuardGridFold, grid_unit_errors
from railguard.operators.guard import (
    causal_state, guard, project, project_with_status, recover, schedule_feasibility, state_grid,
)
from railguard.operators.isotonic import monotone_projection
from railguard.operators.layout import PIECE, Trajectories

FORMS = ["array", "arrow"]


def ledger(spark, units):
    """units: {name: [(raw, candidate), ...]} or lists of raw values."""
    rows = []
    for name, values in units.items():
        for i, v in enumerate(values):
            raw, cand = v if isinstance(v, tuple) else (v, v)
            rows.append(("d", name, float(i // 2), i, float(raw), float(cand), float(raw)))
    schema = ("domain string, unit string, order_key double, ordinal bigint, raw_baseline double, "
              "raw_candidate double, truth double")
    return spark.createDataFrame(rows, schema)


def column(t, name, unit="u"):
    frame = t.frame if isinstance(t, Trajectories) else t
    rows = frame.filter(f"unit = '{unit}'").orderBy("order_key", "ordinal").select(name).collect()
    return [r[0] for r in rows]


def plan(spark, units, **kw):
    return Trajectories.plan(ledger(spark, units), **kw)


def wave(n, seed=0):
    """A falling, oscillating series; other seeds give other phases."""
    return [round(1.15 - 0.011 * i + 0.07 * np.sin(1.7 * i + seed), 6) for i in range(n)]


def absorbed(raws, alpha):
    """The state by its defining recursion."""
    out = []
    for raw in raws:
        inside = lambda x: min(max(x, 0.0), 1.3)
        out.append(inside(raw) if not out else inside(out[-1] + alpha * min(raw - out[-1], 0.0)))
    return out


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("alpha", [1.0, 0.6, 0.15])
def test_state_follows_its_recursion_and_only_falls(spark, form, alpha):
    raws = wave(23)
    got = column(causal_state(plan(spark, {"u": raws}), alpha=alpha, form=form), "protected_state")
    assert got == absorbed(raws, alpha)
    assert got == sorted(got, reverse=True)


def test_window_form_is_the_running_minimum(spark):
    raws = wave(17, 2)
    got = column(causal_state(plan(spark, {"u": raws}), alpha=1.0, form="window"), "protected_state")
    assert got == np.minimum.accumulate(raws).tolist()


@pytest.mark.parametrize("kept", [1, 6, 13])
def test_published_records_do_not_depend_on_what_follows(spark, kept):
    units = {"u": list(zip(wave(14, 1), wave(14, 4)))}
    early = guard(plan(spark, {"u": units["u"][:kept]}), alpha=0.35, budget=0.03)
    whole = guard(plan(spark, units), alpha=0.35, budget=0.03)
    for name in ("protected_state", "guarded"):
        assert column(early, name) == column(whole, name)[:kept]


@pytest.mark.parametrize("budget", [0.0, 0.004, 0.06, 2.0])
@pytest.mark.parametrize("costs", [(1.0, 1.0), (3.0, 0.5)])
def test_output_falls_and_stays_within_the_budgeted_loss(spark, budget, costs):
    state = absorbed(wave(19), 0.5)
    records = list(zip(state, wave(19, 5)))
    under, over = costs
    t = project(plan(spark, {"u": records}), "raw_baseline", budget=budget, under_cost=under, over_cost=over)
    out = column(t, "guarded")
    assert out == sorted(out, reverse=True)
    for b, p in zip(state, out):
        assert max(under * (b - p), over * (p - b)) <= budget + 1e-12
    if budget == 0.0:
        assert out == state
    if budget == 2.0:  # wide enough for any candidate: its running minimum
        assert out == np.minimum.accumulate(wave(19, 5)).tolist()


def test_schedule_that_shrinks_too_fast_stops_the_unit(spark):
    state = [1.0, 0.99, 0.98, 0.97, 0.96]
    t = plan(spark, {"u": [(b, 0.3) for b in state]})
    widths = "array(0.25D, 0.26D, 0.05D, 0.5D, 0.5D)[ordinal]"
    t = t.with_frame(t.frame.selectExpr("*", f"{widths} AS eta"))
    done = project_with_status(t, "raw_baseline", budget="eta")
    # 0.99 - 0.26 is published; 0.98 - 0.05 is above it, and nothing after that is defined.
    assert column(done, "feasible") == [True, True, False, False, False]
    assert column(done, "guarded") == [pytest.approx(0.75), pytest.approx(0.73), None, None, None]
    assert not schedule_feasibility(t, "raw_baseline", "eta").first()["universally_feasible"]


def test_units_are_independent_and_input_order_is_irrelevant(spark):
    units = {name: list(zip(wave(9, i), wave(9, i + 3))) for i, name in enumerate("abc")}
    mixed = Trajectories.plan(ledger(spark, units).orderBy("raw_candidate").repartition(3))
    together = guard(mixed, alpha=0.4, budget=0.02)
    for name, records in units.items():
        alone = guard(plan(spark, {name: records}), alpha=0.4, budget=0.02)
        assert column(together, "guarded", name) == column(alone, "guarded", name)


@pytest.mark.parametrize("form", ["array", "arrow"])
@pytest.mark.parametrize("broken", [float("nan"), float("inf"), None])
def test_missing_predictions_stop_every_form(spark, form, broken):
    df = ledger(spark, {"u": wave(5)})
    for name in ("raw_baseline", "raw_candidate"):
        value = "CAST(NULL AS DOUBLE)" if broken is None else f"DOUBLE('{broken}')"
        bad = df.withColumn(name, F.expr(f"CASE WHEN ordinal = 2 THEN {value} ELSE {name} END"))
        with pytest.raises(Exception, match=f"{name} has a missing"):
            guard(Trajectories.plan(bad), alpha=0.5, budget=0.1, form=form).frame.collect()
    with pytest.raises(Exception, match="raw_baseline has a missing"):
        bad = df.withColumn("raw_baseline", F.lit(None).cast("double"))
        causal_state(Trajectories.plan(bad), alpha=1.0).frame.collect()


def test_unnamed_units_stop_the_guard(spark):
    for name in ("''", "'  '", "CAST(NULL AS STRING)"):
        bad = ledger(spark, {"u": wave(3)}).withColumn("unit", F.expr(name))
        with pytest.raises(Exception, match="unit is missing or blank"):
            guard(Trajectories.plan(bad), alpha=0.5, budget=0.1).frame.collect()


def test_records_without_truth_are_projected_but_not_scored(spark):
    df = ledger(spark, {"u": wave(8), "v": wave(4, 1)})
    partly = df.withColumn("truth", F.expr("CASE WHEN unit = 'u' AND ordinal NOT IN (1, 5) THEN truth + 0.1 END"))
    fold = GuardGridFold(inputs=("raw_baseline", "raw_candidate"), state=("b", "p"), alphas=(0.5,), budgets=(0.02,))
    rows = {r["unit"]: r for r in grid_unit_errors(Trajectories.plan(partly), fold, "truth").collect()}
    out = column(guard(Trajectories.plan(partly), alpha=0.5, budget=0.02), "guarded")
    scored = [abs(p - y - 0.1) for i, (p, y) in enumerate(zip(out, wave(8))) if i not in (1, 5)]
    assert rows["u"]["records"] == 6 and rows["u"]["errors"] == [pytest.approx(np.mean(scored))]
    assert rows["v"]["records"] == 0 and rows["v"]["errors"] == [None]


def test_bad_parameters(spark):
    t = plan(spark, {"u": [1.0]})
    for kw in ({"alpha": 0.0}, {"alpha": 1.5}, {"alpha": float("nan")}):
        with pytest.raises(ValueError):
            causal_state(t, **kw)
    with pytest.raises(ValueError):
        project(t, "raw_baseline", budget=-1.0)
    with pytest.raises(ValueError):
        project(t, "raw_baseline", budget=0.1, under_cost=0.0)
    with pytest.raises(ValueError):
        recover(t, alpha=0.5, budget=0.1, allowance=0.0, y_min=1.0, y_max=1.0)


def test_empty_input_gives_empty_output(spark):
    df = ledger(spark, {"u": [1.0]}).filter("false")
    assert guard(Trajectories.plan(df), alpha=0.5, budget=0.01).frame.count() == 0


def random_units(seed, sizes):
    rng = np.random.default_rng(seed)
    out = {}
    for i, n in enumerate(sizes):
        trend = np.linspace(1.0, 0.6, n)
        raw = trend + rng.normal(0, 0.05, n)
        out[f"u{i}"] = list(zip(raw.tolist(), (raw + rng.normal(0, 0.03, n)).tolist()))
    return out


def reference_guard(records, alpha, budget):
    b, last, out = None, 1.3, []
    for raw, cand in records:
        b = min(max(raw, 0.0), 1.3) if b is None else min(max(b + alpha * min(raw - b, 0.0), 0.0), 1.3)
        low, high = max(0.0, b - budget), min(1.3, b + budget, last)
        last = min(max(cand, min(low, high)), high)
        out.append((b, last))
    return out


@pytest.mark.parametrize("form", FORMS)
def test_random_trajectories_match_sequential_recursion(spark, form):
    units = random_units(1, [1, 2, 7, 40])
    t = guard(plan(spark, units), alpha=0.3, budget=0.02, form=form)
    for name, records in units.items():
        got = list(zip(column(t, "protected_state", name), column(t, "guarded", name)))
        assert got == reference_guard(records, 0.3, 0.02)


def test_recovery_with_zero_allowance_equals_guard(spark):
    units = random_units(2, [5, 30])
    strict = guard(plan(spark, units), alpha=0.2, budget=0.02)
    loose = recover(plan(spark, units), alpha=0.2, budget=0.02, allowance=0.0)
    for name in units:
        assert column(loose, "recovered", name) == column(strict, "guarded", name)


def test_state_grid_entries_equal_single_runs(spark):
    units = random_units(3, [20])
    grid = column(state_grid(plan(spark, units), [1.0, 0.3]), "states", "u0")
    for i, alpha in enumerate((1.0, 0.3)):
        single = causal_state(plan(spark, units), alpha=alpha, form="arrow")
        assert [g[i] for g in grid] == column(single, "protected_state", "u0")


# --- cut units: a unit spread over many tasks gives the same bits ---------------------------


@pytest.fixture(scope="module")
def cut(spark):
    units = random_units(4, [60, 3])
    whole, pieces = plan(spark, units), plan(spark, units, piece_rows=12)
    assert not whole.cut and pieces.cut
    assert pieces.frame.filter("unit = 'u0'").select(PIECE).distinct().count() >= 4
    assert pieces.frame.filter("unit = 'u1'").select(PIECE).distinct().count() == 1
    return units, whole, pieces


def same(whole, pieces, *columns):
    keys = ["domain", "unit", "ordinal", *columns]
    a, b = whole.frame.select(*keys), pieces.frame.select(*keys)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_cut_guard(cut):
    _, whole, pieces = cut
    same(guard(whole, alpha=0.1, budget=0.02), guard(pieces, alpha=0.1, budget=0.02),
         "protected_state", "guarded")


def test_cut_recovery(cut):
    _, whole, pieces = cut
    kw = {"alpha": 0.3, "budget": 0.02, "allowance": 0.01}
    same(recover(whole, **kw), recover(pieces, **kw), "recovery_state", "recovered")


def test_cut_windows(cut):
    _, whole, pieces = cut
    for step in (
        lambda t: ordering.with_rank(t, "x"),
        lambda t: ordering.with_previous(t, {"x": "raw_baseline"}),
        lambda t: ordering.with_next(t, {"x": "raw_baseline"}),
        lambda t: ordering.with_running(t, {"x": ("min", F.col("raw_baseline"))}),
        lambda t: ordering.with_running(t, {"x": ("sum", F.col("ordinal"))}),
        lambda t: ordering.with_block(t, F.col("raw_baseline") > 0.8, "x"),
        lambda t: ordering.with_unit_rows(t, "x"),
    ):
        same(step(whole), step(pieces), "x")


def test_cut_grid_errors(cut):
    _, whole, pieces = cut
    fold = GuardGridFold(inputs=("raw_baseline", "raw_candidate"), state=("b", "p"),
                         alphas=(1.0, 0.2), budgets=(0.01, 0.05))
    a, b = (
        {r["unit"]: r["errors"] for r in grid_unit_errors(t, fold, "truth").collect()}
        for t in (whole, pieces)
    )
    for unit in a:
        assert a[unit] == pytest.approx(b[unit], abs=1e-12)


def test_cut_isotonic(cut):
    _, whole, pieces = cut
    a = monotone_projection(whole, "raw_baseline")
    b = monotone_projection(pieces, "raw_baseline")
    for unit in ("u0", "u1"):
        assert column(a, "isotonic", unit) == pytest.approx(column(b, "isotonic", unit), abs=1e-12)
        fit = column(a, "isotonic", unit)
        assert all(y <= x + 1e-15 for x, y in zip(fit, fit[1:]))
