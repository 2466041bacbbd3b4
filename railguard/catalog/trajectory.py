"""Trajectory operators on the driver tables (T1-T26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import (
    ALPHA,
    BUDGET,
    ORACLES,
    SUPPLIER_SQL,
    guarded,
    guarded_sql,
    query,
    state_sql,
    supplier_trajectories,
    trajectories,
    with_guarded,
    with_ledger,
)
from railguard.functions.columns import (
    minimum_budget,
    observed_regret,
    regret_cap,
    squared_harm,
    tube_lower,
    tube_upper,
    worst_case_loss,
)
from railguard.operators import audits
from railguard.operators.folds import GuardGridFold, RecoveryGridFold, grid_unit_errors
from railguard.operators.guard import (
    causal_state,
    guard,
    pointwise_tube,
    project,
    project_squared,
    project_with_status,
    recover,
    recovered_output,
    schedule_feasibility,
    state_grid,
)
from railguard.operators.isotonic import monotone_projection

KEYS = ["domain", "unit", "ordinal"]
# Schedules that vary by record; the drop every seventh record makes some units infeasible.
SCHEDULE = "CASE WHEN ordinal % 7 = 0 THEN 0.005e0 ELSE 0.03e0 END"
UNDER = "CASE WHEN ordinal % 2 = 0 THEN 2e0 ELSE 1e0 END"
OVER = "CASE WHEN ordinal % 3 = 0 THEN 8e0 ELSE 1e0 END"
GRID_ALPHAS = [1.0, 0.5, 0.2, 0.1, 0.05, 0.02]
GRID_BUDGETS = [0.005, 0.01, 0.02, 0.05]


@query(
    "T1_causal_state",
    with_ledger(
        " SELECT l.domain, l.unit, l.ordinal, s.b AS protected_state"
        " FROM led l JOIN st s USING (domain, unit, rn)",
        state_sql("st", "led", "raw_baseline", f"{ALPHA}e0"),
    ),
)
def t1(spark, d):
    return causal_state(trajectories(spark, d), alpha=ALPHA).frame.select(*KEYS, "protected_state")


@query("T1_causal_state_array_form", ORACLES["T1_causal_state"])
def t1_array(spark, d):
    t = causal_state(trajectories(spark, d), alpha=ALPHA, form="array")
    return t.frame.select(*KEYS, "protected_state")


@query(
    "T1_long_units",
    "WITH RECURSIVE "
    + SUPPLIER_SQL
    + ","
    + guarded_sql("gd", "sup", 0.02, 0.01)
    + " SELECT domain, unit, rn, protected_state, guarded FROM gd",
)
def t1_long(spark, d):
    from railguard.operators.ordering import with_rank

    t = guard(with_rank(supplier_trajectories(spark, d), "rn"), alpha=0.02, budget=0.01)
    return t.frame.select("domain", "unit", "rn", "protected_state", "guarded")


@query(
    "T2_symmetric_projection",
    with_guarded(" SELECT domain, unit, ordinal, guarded FROM gd"),
)
def t2(spark, d):
    t = causal_state(trajectories(spark, d), alpha=ALPHA)
    return project(t, budget=BUDGET).frame.select(*KEYS, "guarded")


@query(
    "T3_asymmetric_projection",
    with_guarded(
        """ SELECT domain, unit, ordinal,
          min(least(greatest(raw_candidate, greatest(0e0, protected_state - 0.08e0 / 2e0)),
                    least(1.3e0, protected_state + 0.08e0 / 8e0)))
            OVER (PARTITION BY domain, unit ORDER BY rn) AS guarded FROM gd"""
    ),
)
def t3(spark, d):
    t = causal_state(trajectories(spark, d), alpha=ALPHA)
    return project(t, budget=0.08, under_cost=2.0, over_cost=8.0).frame.select(*KEYS, "guarded")


_TUBE = f""", tube AS (
  SELECT *, greatest(0e0, protected_state - ({SCHEDULE}) / ({UNDER})) AS lo,
         least(1.3e0, protected_state + ({SCHEDULE}) / ({OVER})) AS hi FROM gd)"""
_STATUS = (
    _TUBE
    + """, p AS (
  SELECT *, min(least(greatest(raw_candidate, lo), hi))
    OVER (PARTITION BY domain, unit ORDER BY rn) AS p FROM tube
), q AS (
  SELECT *, coalesce(lag(p) OVER (PARTITION BY domain, unit ORDER BY rn), 1.3e0) AS prev FROM p
), r AS (
  SELECT *, max(CASE WHEN lo > least(hi, prev) + 1e-12 THEN 1 ELSE 0 END)
    OVER (PARTITION BY domain, unit ORDER BY rn) AS failed FROM q
)"""
)


def _scheduled(spark, d):
    t = causal_state(trajectories(spark, d), alpha=ALPHA)
    return t.with_frame(
        t.frame.withColumns(
            {"budget": F.expr(SCHEDULE), "under": F.expr(UNDER), "over": F.expr(OVER)}
        )
    )


@query(
    "T4_time_varying_projection",
    with_guarded(_STATUS + """
 SELECT domain, unit, ordinal, failed = 0 AS feasible,
        CASE WHEN failed = 0 THEN p END AS guarded FROM r"""),
)
def t4(spark, d):
    t = project_with_status(
        _scheduled(spark, d), budget="budget", under_cost="under", over_cost="over"
    )
    return t.frame.select(*KEYS, "feasible", "guarded")


@query(
    "T4_first_infeasible_record",
    with_guarded(_STATUS + """
 SELECT domain, unit, min(rn) - 1 AS first_bad_index, count(*) AS void_records
 FROM r WHERE failed = 1 GROUP BY ALL"""),
)
def t4_first(spark, d):
    from railguard.operators.ordering import with_rank

    t = project_with_status(
        with_rank(_scheduled(spark, d)), budget="budget", under_cost="under", over_cost="over"
    )
    return (
        t.frame.filter(~F.col("feasible"))
        .groupBy("domain", "unit")
        .agg(
            (F.min("rank") - 1).alias("first_bad_index"),
            F.count(F.lit(1)).alias("void_records"),
        )
    )


@query(
    "T5_tube_ends",
    with_guarded(_TUBE + " SELECT domain, unit, ordinal, lo AS low, hi AS high FROM tube"),
)
def t5(spark, d):
    f = _scheduled(spark, d).frame
    return f.select(
        *KEYS,
        tube_lower("protected_state", "budget", "under").alias("low"),
        tube_upper("protected_state", "budget", "over").alias("high"),
    )


@query(
    "T6_minimum_budget",
    with_guarded(f""", x AS (SELECT *, lag(guarded) OVER (PARTITION BY domain, unit ORDER BY rn) AS prev FROM gd)
 SELECT domain, unit, ordinal, ({UNDER}) * greatest(protected_state - prev, 0e0) AS minimum_budget
 FROM x WHERE prev IS NOT NULL"""),
)
def t6(spark, d):
    from railguard.operators.ordering import with_previous

    f = with_previous(guarded(spark, d), {"prev": "guarded"}).frame.filter("prev IS NOT NULL")
    return f.select(
        *KEYS, minimum_budget("protected_state", "prev", F.expr(UNDER)).alias("minimum_budget")
    )


@query(
    "T7_schedule_feasibility",
    with_guarded(_TUBE + """, x AS (
  SELECT *, coalesce(lo - lag(lo) OVER (PARTITION BY domain, unit ORDER BY rn), 0e0) AS rise FROM tube)
 SELECT domain, unit, count(*) AS records, max(greatest(rise, 0e0)) AS maximum_lower_increase,
        bool_and(rise <= 1e-12) AS universally_feasible FROM x GROUP BY ALL"""),
)
def t7(spark, d):
    return schedule_feasibility(_scheduled(spark, d), "protected_state", "budget", "under")


@query(
    "T8_worst_case_loss",
    with_guarded("""
 SELECT domain, unit, ordinal,
   CASE WHEN guarded - protected_state >= 0 THEN 8e0 * (guarded - protected_state)
        ELSE 2e0 * (protected_state - guarded) END + 0e0 AS asymmetric,
   abs(guarded - protected_state) AS symmetric FROM gd"""),
)
def t8(spark, d):
    f = guarded(spark, d).frame
    return f.select(
        *KEYS,
        (worst_case_loss("protected_state", "guarded", 2.0, 8.0) + F.lit(0.0)).alias("asymmetric"),
        F.abs(worst_case_loss("protected_state", "guarded")).alias("symmetric"),
    )


@query(
    "T9_guard",
    with_guarded(" SELECT domain, unit, ordinal, protected_state, guarded FROM gd"),
)
def t9(spark, d):
    t = guard(trajectories(spark, d), alpha=ALPHA, budget=BUDGET)
    return t.frame.select(*KEYS, "protected_state", "guarded")


@query(
    "T10_regret_cap",
    with_guarded(f""" SELECT domain, unit, ordinal, protected_state
      + least(greatest(raw_candidate - protected_state, -{BUDGET}e0), {BUDGET}e0) AS capped FROM gd"""),
)
def t10(spark, d):
    f = guarded(spark, d).frame
    return f.select(*KEYS, regret_cap("protected_state", "raw_candidate", BUDGET).alias("capped"))


@query(
    "T11_pointwise_tube",
    with_guarded(f""" SELECT domain, unit, ordinal,
      least(greatest(raw_candidate, greatest(0e0, protected_state - {BUDGET}e0)),
            least(1.3e0, protected_state + {BUDGET}e0)) AS pointwise FROM gd"""),
)
def t11(spark, d):
    f = guarded(spark, d).frame
    return f.select(*KEYS, pointwise_tube("protected_state", "raw_candidate", BUDGET).alias("pointwise"))


@query(
    "T12_regret_verification",
    with_guarded(f""" SELECT domain, count(*) AS records,
      max(abs(guarded - truth) - abs(protected_state - truth)) AS maximum_regret,
      bool_and(abs(guarded - truth) - abs(protected_state - truth) <= {BUDGET}e0 + 1e-12) AS within_budget
      FROM gd GROUP BY domain"""),
)
def t12(spark, d):
    regret = observed_regret("protected_state", "guarded", "truth")
    return (
        guarded(spark, d)
        .frame.groupBy("domain")
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.max(regret).alias("maximum_regret"),
            F.bool_and(regret <= BUDGET + 1e-12).alias("within_budget"),
        )
    )


_RISE = "CASE WHEN ordinal % 5 = 0 THEN 0.01e0 ELSE 0.002e0 END"
def recovery_sql(rise: str) -> str:
    """CTE ``rs`` with the recovery state b and output p for an allowance expression."""
    later = rise.replace("ordinal", "l.ordinal")
    return f"""
rs AS (
  SELECT domain, unit, rn, least(greatest(raw_baseline, 0e0), 1.3e0) AS b,
         least(greatest(raw_candidate,
                        greatest(0e0, least(greatest(raw_baseline, 0e0), 1.3e0) - {BUDGET}e0)),
               greatest(greatest(0e0, least(greatest(raw_baseline, 0e0), 1.3e0) - {BUDGET}e0),
                        least(1.3e0, least(greatest(raw_baseline, 0e0), 1.3e0) + {BUDGET}e0,
                              1.3e0 + ({rise})))) AS p
  FROM led WHERE rn = 1
  UNION ALL
  SELECT domain, unit, rn, b,
         least(greatest(c, greatest(0e0, b - {BUDGET}e0)),
               greatest(greatest(0e0, b - {BUDGET}e0), least(1.3e0, b + {BUDGET}e0, p0 + rise))) AS p
  FROM (
    SELECT l.domain, l.unit, l.rn, l.raw_candidate AS c, s.p AS p0, ({later}) AS rise,
      least(greatest(s.b + CASE WHEN l.raw_baseline - s.b <= 0 THEN {ALPHA}e0 * (l.raw_baseline - s.b)
            ELSE least(l.raw_baseline - s.b, {later}) END, 0e0), 1.3e0) AS b
    FROM rs s JOIN led l ON l.domain = s.domain AND l.unit = s.unit AND l.rn = s.rn + 1
  )
)"""


_RECOVERY = recovery_sql(_RISE)


def _recovered(spark, d):
    return recover(trajectories(spark, d), alpha=ALPHA, budget=BUDGET, allowance=F.expr(_RISE))


@query(
    "T13_recovery_state",
    with_ledger(
        " SELECT l.domain, l.unit, l.ordinal, rs.b AS recovery_state"
        " FROM led l JOIN rs USING (domain, unit, rn)",
        _RECOVERY,
    ),
)
def t13(spark, d):
    return _recovered(spark, d).frame.select(*KEYS, "recovery_state")


@query(
    "T14_recovery_projection",
    with_ledger(
        " SELECT l.domain, l.unit, l.ordinal, rs.b AS recovery_state, rs.p AS recovered"
        " FROM led l JOIN rs USING (domain, unit, rn)",
        _RECOVERY,
    ),
)
def t14(spark, d):
    return _recovered(spark, d).frame.select(*KEYS, "recovery_state", "recovered")


@query(
    "T14_recovery_window_form",
    with_ledger(
        " SELECT l.domain, l.unit, l.ordinal, round(rs.p, 9) AS recovered"
        " FROM led l JOIN rs USING (domain, unit, rn)",
        _RECOVERY,
    ),
)
def t14_window(spark, d):
    t = _recovered(spark, d)
    t = t.with_frame(t.frame.drop("recovered"))
    t = recovered_output(t, budget=BUDGET, allowance=F.expr(_RISE))
    return t.frame.select(*KEYS, F.round("recovered", 9).alias("recovered"))


def isotonic_sql(name: str, source: str, column: str) -> str:
    """CTE ``name`` (domain, unit, rn, f): min over starts of max over ends of segment means."""
    return f"""
{name}_c AS (SELECT *, sum({column}) OVER (PARTITION BY domain, unit ORDER BY rn) AS cs FROM {source}),
{name}_s AS (
  SELECT e.domain, e.unit, s.rn AS s, e.rn AS e, (e.cs - s.cs + s.{column}) / (e.rn - s.rn + 1) AS mean
  FROM {name}_c s JOIN {name}_c e ON s.domain = e.domain AND s.unit = e.unit AND e.rn >= s.rn),
{name}_b AS (SELECT *, max(mean) OVER (PARTITION BY domain, unit, s ORDER BY e DESC) AS far FROM {name}_s),
{name} AS (SELECT domain, unit, e AS rn, least(greatest(min(far), 0e0), 1.3e0) AS f FROM {name}_b GROUP BY ALL)"""


@query(
    "T15_monotone_projection",
    with_ledger(
        " SELECT l.domain, l.unit, l.ordinal, round(f, 9) AS isotonic FROM led l JOIN iso USING (domain, unit, rn)",
        isotonic_sql("iso", "led", "raw_baseline"),
    ),
)
def t15(spark, d):
    f = monotone_projection(trajectories(spark, d), "raw_baseline")
    return f.select(*KEYS, F.round("isotonic", 9).alias("isotonic"))


@query(
    "T16_smoothed_candidate",
    with_ledger(
        " SELECT l.domain, l.unit, l.ordinal, s.b AS smoothed"
        " FROM led l JOIN st s USING (domain, unit, rn)",
        state_sql("st", "led", "raw_candidate", "0.05e0"),
    ),
)
def t16(spark, d):
    t = causal_state(trajectories(spark, d), "raw_candidate", "smoothed", alpha=0.05)
    return t.frame.select(*KEYS, "smoothed")


_ALPHA_ROWS = ", ".join(f"({i}, {a}e0)" for i, a in enumerate(GRID_ALPHAS))
_GRID = f"""
grid AS (SELECT l.*, g.alpha, g.ai FROM led l, (VALUES {_ALPHA_ROWS}) g(ai, alpha)),
{state_sql('gs', 'grid', 'raw_baseline', 'l.alpha', 'domain, unit, ai').strip()}"""


@query(
    "T17_state_grid",
    with_ledger(
        """ SELECT domain, unit, ordinal, alpha, b AS state
        FROM grid JOIN gs USING (domain, unit, ai, rn)""",
        _GRID,
    ),
)
def t17(spark, d):
    t = state_grid(trajectories(spark, d), GRID_ALPHAS)
    alphas = F.array(*[F.lit(a) for a in GRID_ALPHAS])
    return t.frame.select(*KEYS, F.inline(F.arrays_zip(alphas.alias("alpha"), F.col("states").alias("state"))))


_BUDGET_ROWS = ", ".join(f"({b}e0)" for b in GRID_BUDGETS)
_GRID_ERRORS = f"""
, out AS (
  SELECT grid.domain, grid.unit, alpha, budget, truth,
    min(least(greatest(raw_candidate, greatest(0e0, b - budget)), least(1.3e0, b + budget)))
      OVER (PARTITION BY grid.domain, grid.unit, ai, budget ORDER BY rn) AS p
  FROM grid JOIN gs USING (domain, unit, ai, rn), (VALUES {_BUDGET_ROWS}) v(budget)
)"""


@query(
    "T18_unlabelled_records",
    with_ledger(
        _GRID_ERRORS.replace("budget, truth,", "budget, CASE WHEN grid.ordinal % 3 > 0 THEN truth END AS truth,")
        + """ SELECT domain, unit, count(truth) AS records, round(max(e), 9) AS mae
           FROM (SELECT domain, unit, alpha, budget, truth, avg(abs(p - truth)) OVER (PARTITION BY domain, unit, alpha, budget) AS e FROM out)
           WHERE alpha = """ + f"{GRID_ALPHAS[0]} AND budget = {GRID_BUDGETS[0]} GROUP BY ALL",
        _GRID,
    ),
)
def t18_unlabelled(spark, d):
    """A third of the records has no truth: projected, but not scored."""
    t = trajectories(spark, d)
    t = t.with_frame(t.frame.withColumn("truth", F.when(F.col("ordinal") % 3 > 0, F.col("truth"))))
    fold = GuardGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"),
        alphas=(GRID_ALPHAS[0],), budgets=(GRID_BUDGETS[0],),
    )
    units = grid_unit_errors(t, fold, "truth")
    return units.select("domain", "unit", "records", F.round(F.get("errors", F.lit(0)), 9).alias("mae"))


@query(
    "T18_budget_grid",
    with_ledger(
        _GRID_ERRORS
        + """ SELECT domain, unit, alpha, budget, count(*) AS records,
           round(avg(abs(p - truth)), 9) AS mae FROM out GROUP BY ALL""",
        _GRID,
    ),
)
def t18(spark, d):
    fold = GuardGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"),
        alphas=tuple(GRID_ALPHAS), budgets=tuple(GRID_BUDGETS),
    )
    units = grid_unit_errors(trajectories(spark, d), fold, "truth")
    points = F.array(
        *[
            F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("budget"))
            for a in GRID_ALPHAS
            for b in GRID_BUDGETS
        ]
    )
    return units.select(
        "domain", "unit", "records", F.explode(F.arrays_zip(points.alias("point"), "errors")).alias("z")
    ).select("domain", "unit", "z.point.alpha", "z.point.budget", "records",
             F.round("z.errors", 9).alias("mae"))


RECOVERY_GRID = [(a, r) for a in (1.0, 0.2, 0.05) for r in (0.0, 0.002, 0.01)]
_CONFIGS = ", ".join(f"({i}, {a}e0, {r}e0)" for i, (a, r) in enumerate(RECOVERY_GRID))
_RECOVERY_GRID = f"""
cfg AS (SELECT l.*, g.alpha, g.recovery, g.ci FROM led l, (VALUES {_CONFIGS}) g(ci, alpha, recovery)),
rg AS (
  SELECT domain, unit, ci, rn, least(greatest(raw_baseline, 0e0), 1.3e0) AS b,
    least(greatest(raw_candidate, greatest(0e0, least(greatest(raw_baseline, 0e0), 1.3e0) - 0.01e0)),
          greatest(greatest(0e0, least(greatest(raw_baseline, 0e0), 1.3e0) - 0.01e0),
                   least(1.3e0, least(greatest(raw_baseline, 0e0), 1.3e0) + 0.01e0))) AS p
  FROM cfg WHERE rn = 1
  UNION ALL
  SELECT domain, unit, ci, rn, b,
    least(greatest(c, greatest(0e0, b - 0.01e0)),
          greatest(greatest(0e0, b - 0.01e0), least(1.3e0, b + 0.01e0, p0 + recovery))) AS p
  FROM (
    SELECT l.domain, l.unit, l.ci, l.rn, l.raw_candidate AS c, s.p AS p0, l.recovery,
      least(greatest(s.b + CASE WHEN l.raw_baseline - s.b <= 0 THEN l.alpha * (l.raw_baseline - s.b)
            ELSE least(l.raw_baseline - s.b, l.recovery) END, 0e0), 1.3e0) AS b
    FROM rg s JOIN cfg l ON l.domain = s.domain AND l.unit = s.unit AND l.ci = s.ci AND l.rn = s.rn + 1
  )
)"""


@query(
    "T19_recovery_grid",
    with_ledger(
        """ SELECT domain, alpha, recovery, count(*) AS units, round(avg(mae), 9) AS mae FROM (
          SELECT domain, unit, alpha, recovery, avg(abs(p - truth)) AS mae
          FROM cfg JOIN rg USING (domain, unit, ci, rn) GROUP BY ALL) GROUP BY ALL""",
        _RECOVERY_GRID,
    ),
)
def t19(spark, d):
    from railguard.operators.selection import grid_scores

    t = trajectories(spark, d)
    units = grid_unit_errors(t, recovery_grid_fold(), "truth")
    points = [{"alpha": a, "recovery": r} for a, r in RECOVERY_GRID]
    scores = grid_scores(units, t.keys, points)
    return scores.select("domain", "alpha", "recovery", "units", F.round("mae", 9).alias("mae"))


def recovery_grid_fold() -> RecoveryGridFold:
    return RecoveryGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"),
        alphas=tuple(a for a, _ in RECOVERY_GRID), allowances=tuple(r for _, r in RECOVERY_GRID),
    )


@query(
    "T20_single_pass_baseline",
    with_ledger(
        " SELECT domain, unit, ordinal, min(least(greatest(raw_baseline, 0e0), 1.3e0))"
        " OVER (PARTITION BY domain, unit ORDER BY rn) AS baseline FROM led"
    ),
)
def t20(spark, d):
    t = causal_state(trajectories(spark, d), out="baseline", alpha=1.0)
    return t.frame.select(*KEYS, "baseline")


@query(
    "T21_squared_loss_projection",
    with_guarded("""
 , sq AS (SELECT *, greatest(0e0, 1.3e0 - sqrt((1.3e0 - protected_state) * (1.3e0 - protected_state) + 0.02e0)) AS lo,
                 least(1.3e0, 0e0 + sqrt((protected_state - 0e0) * (protected_state - 0e0) + 0.02e0)) AS hi FROM gd),
 pr AS (SELECT *, min(least(greatest(raw_candidate, lo), hi)) OVER (PARTITION BY domain, unit ORDER BY rn) AS p FROM sq)
 SELECT domain, unit, ordinal, round(p, 9) AS guarded,
   round(greatest(p * p - protected_state * protected_state,
     (p - 1.3e0) * (p - 1.3e0) - (protected_state - 1.3e0) * (protected_state - 1.3e0)), 9) + 0e0 AS harm FROM pr"""),
)
def t21(spark, d):
    t = causal_state(trajectories(spark, d), alpha=ALPHA)
    f = project_squared(t, budget=0.02).frame
    harm = F.round(squared_harm("guarded", "protected_state"), 9) + F.lit(0.0)
    return f.select(*KEYS, F.round("guarded", 9).alias("guarded"), harm.alias("harm"))


@query(
    "T22_prefix_replay",
    with_ledger(
        """ SELECT sum(greatest(1, n // 2))::BIGINT AS replayed_records, 0e0 AS maximum_difference
        FROM (SELECT count(*) AS n FROM led GROUP BY domain, unit)"""
    ),
)
def t22(spark, d):
    return audits.prefix_replay(trajectories(spark, d), alpha=ALPHA, budget=BUDGET)


_FRACTIONS = (0.25, 0.5, 0.75)
_PREFIXES = ",".join(
    f"""
pf{i} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY domain, unit) AS n FROM led) WHERE rn <= greatest(1, floor(n * {f}e0))),
{isotonic_sql(f'pi{i}', f'pf{i}', 'raw_candidate').strip()}"""
    for i, f in enumerate(_FRACTIONS)
)


@query(
    "T23_future_revision",
    with_ledger(
        ", u AS ("
        + " UNION ALL ".join(
            f"SELECT {f}e0 AS prefix_fraction, domain, unit, max(abs(p.f - a.f)) AS gap FROM pi{i} p JOIN pa a USING (domain, unit, rn) GROUP BY ALL"
            for i, f in enumerate(_FRACTIONS)
        )
        + """) SELECT domain, prefix_fraction, count(*) AS units, 0e0 AS causal_revised, round(avg((gap > 1e-4)::INT), 9) AS offline_revised FROM u GROUP BY ALL""",
        isotonic_sql("pa", "led", "raw_candidate"), _PREFIXES,
    ),
)
def t23(spark, d):
    f = audits.future_revision(trajectories(spark, d), "raw_candidate", alpha=ALPHA, budget=BUDGET)
    return f.select(
        "domain", "prefix_fraction", "units",
        F.round("causal_revised", 9).alias("causal_revised"),
        F.round("offline_revised", 9).alias("offline_revised"),
    )


_SHOCK = """
sc AS (
  SELECT l.domain, l.unit || '|' || v.place || '|' || v.shock AS unit, l.rn, v.place, v.shock,
         l.raw_baseline + CASE WHEN l.rn = greatest(1, ceil(n * v.place)) THEN v.shock ELSE 0e0 END AS raw,
         l.rn = greatest(1, ceil(n * v.place)) AS here
  FROM (SELECT *, count(*) OVER (PARTITION BY domain, unit) AS n FROM led) l,
       (SELECT p AS place, s AS shock FROM (VALUES (0.25e0), (0.5e0), (0.75e0)) a(p), (VALUES (-0.05e0), (0.05e0)) b(s)) v
),
base AS (
  SELECT l.domain, l.unit || '|' || v.place || '|' || v.shock AS unit, l.rn, l.raw_baseline AS raw
  FROM led l, (SELECT p AS place, s AS shock FROM (VALUES (0.25e0), (0.5e0), (0.75e0)) a(p), (VALUES (-0.05e0), (0.05e0)) b(s)) v
),"""


@query(
    "T24_shock_response",
    with_ledger(
        """, allv AS (
  SELECT 1.0e0 AS alpha, h.domain, h.unit, h.rn, abs(h.b - c.b) AS gap FROM h1 h JOIN c1 c USING (domain, unit, rn)
  UNION ALL
  SELECT 0.02e0, h.domain, h.unit, h.rn, abs(h.b - c.b) FROM h2 h JOIN c2 c USING (domain, unit, rn)
)
 SELECT sc.domain, place, shock, alpha, count(*) FILTER (here) AS shocks,
        round(sum(gap), 9) AS cumulative_disturbance
 FROM allv JOIN sc USING (domain, unit, rn) GROUP BY ALL""",
        _SHOCK + ",".join(
            [
                state_sql("h1", "sc", "raw", "1e0"),
                state_sql("c1", "base", "raw", "1e0"),
                state_sql("h2", "sc", "raw", "0.02e0"),
                state_sql("c2", "base", "raw", "0.02e0"),
            ]
        ),
    ),
)
def t24(spark, d):
    f = audits.shock_response(trajectories(spark, d), "raw_baseline", alphas=(1.0, 0.02))
    return f.select(
        "domain", "place", "shock", "alpha", "shocks",
        F.round("cumulative_disturbance", 9).alias("cumulative_disturbance"),
    )


CAPS = [1.0, 1.1, 1.3, 1.5]


def _cap_sql(cap: float) -> str:
    i = str(cap).replace(".", "_")
    return f"""
s{i} AS (
  SELECT domain, unit, rn, least(greatest(raw_baseline, 0e0), {cap}e0) AS b FROM led WHERE rn = 1
  UNION ALL
  SELECT l.domain, l.unit, l.rn, least(greatest(s.b + {ALPHA}e0 * least(l.raw_baseline - s.b, 0e0), 0e0), {cap}e0)
  FROM s{i} s JOIN led l ON l.domain = s.domain AND l.unit = s.unit AND l.rn = s.rn + 1
),
o{i} AS (
  SELECT {cap}e0 AS cap, l.domain, l.unit, l.rn, truth,
    min(least(greatest(raw_candidate, greatest(0e0, b - {BUDGET}e0)), least({cap}e0, b + {BUDGET}e0)))
      OVER (PARTITION BY l.domain, l.unit ORDER BY l.rn) AS p
  FROM led l JOIN s{i} USING (domain, unit, rn)
)"""


@query(
    "T25_cap_sensitivity",
    with_ledger(
        ", u AS ("
        + " UNION ALL ".join(f"SELECT * FROM o{str(c).replace('.', '_')}" for c in CAPS)
        + """), j AS (
  SELECT u.cap, u.domain, u.unit, u.p, u.truth, o1_3.p AS base FROM u JOIN o1_3 USING (domain, unit, rn)
)
 SELECT cap, domain, sum(n)::BIGINT AS records, sum(changed)::BIGINT AS changed_records,
        max(gap) AS maximum_change, round(avg(mae), 9) AS unit_macro_mae
 FROM (SELECT cap, domain, unit, count(*) AS n, count(*) FILTER (p <> base) AS changed,
              max(abs(p - base)) AS gap, avg(abs(p - truth)) AS mae FROM j GROUP BY ALL) GROUP BY ALL""",
        ",".join(_cap_sql(c) for c in CAPS),
    ),
)
def t25(spark, d):
    f = audits.cap_sensitivity(trajectories(spark, d), CAPS, alpha=ALPHA, budget=BUDGET)
    return f.withColumn("unit_macro_mae", F.round("unit_macro_mae", 9))


_NOISE = "0.01e0 * ((ordinal * 31) % 11 - 5) / 5e0"


@query(
    "T26_nonexpansive",
    with_ledger(f"""
 SELECT domain, count(*) AS records, round(max(abs((raw_baseline + {_NOISE}) - raw_baseline)), 12) AS maximum_input_change,
        true AS nonexpansive FROM led GROUP BY domain"""),
)
def t26(spark, d):
    f = audits.nonexpansive_check(
        trajectories(spark, d), F.expr(_NOISE), alpha=ALPHA, budget=BUDGET
    )
    # The candidate moves by the same amounts, up to rounding in the other direction.
    return f.select(
        "domain", "records", F.round("maximum_input_change", 12).alias("maximum_input_change"),
        "nonexpansive",
    )
