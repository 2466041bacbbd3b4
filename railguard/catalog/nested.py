"""Nested selection and outer evaluation on pair-specific predictions (E5, E6, E7), full grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import ALPHA, BUDGET, query, trajectories, with_guarded, with_ledger
from railguard.catalog.evaluation import rounded
from railguard.catalog.inference import _B1, _B5, _B6, REPS, SEED
from railguard.catalog.trajectory import recovery_sql
from railguard.operators import metrics
from railguard.plans import nested, workflows

#: The published parameter grids.
ALPHAS = [1.0, 0.5, 0.2, 0.1, 0.05, 0.03, 0.02, 0.015, 0.01, 0.005]
BUDGETS = [0.0, 0.0025, 0.005, 0.0075, 0.01, 0.015, 0.02, 0.03]
OFFSETS = [round(-0.01 + 0.001 * i, 3) for i in range(21)]
ALLOWANCES = [0.0, 0.00025, 0.0005, 0.001, 0.002, 0.005]


def _values(name: str, column: str, numbers: list[float]) -> str:
    return f"(VALUES {', '.join(f'({n}e0)' for n in numbers)}) {name}({column})"


def _clip(x: str) -> str:
    return f"least(greatest({x}, 0e0), 1.3e0)"


def _fold(source: str, first: dict[str, str], later: dict[str, str], records: bool) -> str:
    """SQL of a fold over the list ``x`` of {r, c, t, o}: ``a`` is the state, ``v`` the record."""
    given = "'r': v.r, 'c': v.c, 't': v.t, 'o': v.o"
    begin = ", ".join(f"'{k}': {e}" for k, e in first.items())
    step = ", ".join(f"'{k}': {e}" for k, e in later.items())
    if records:
        kept = "{" + given + ", {0}" + "}"
        begin = f"{begin}, 's': [{kept.replace('{0}', begin)}]"
        step = f"{step}, 's': list_append(a.s, {kept.replace('{0}', step)})"
    return (
        f"list_reduce(list_transform({source}, lambda v: {{{given}, {begin}}}), "
        f"lambda a, v: {{{given}, {step}}})"
    )


def _guard(alpha: str, budget: str, state: str = "b", out: str = "p", last: str = "p") -> tuple[dict, dict]:
    def tube(b: str) -> str:
        return f"least(greatest(v.c, greatest(0e0, {b} - {budget})), least(1.3e0, {b} + {budget}))"

    b0, b1 = _clip("v.r"), _clip(f"a.{state} + {alpha} * least(v.r - a.{state}, 0e0)")
    return {state: b0, out: f"least(1.3e0, {tube(b0)})"}, {state: b1, out: f"least(a.{last}, {tube(b1)})"}


def _recovery(alpha: str, rise: str, state: str = "b", out: str = "p") -> tuple[dict, dict]:
    def tube(b: str, last: str) -> str:
        low = f"greatest(0e0, {b} - {BUDGET_E7}e0)"
        return f"least(greatest(v.c, {low}), greatest({low}, least(1.3e0, {b} + {BUDGET_E7}e0, {last} + {rise})))"

    b0 = _clip("v.r")
    gap = f"(v.r - a.{state})"
    b1 = _clip(f"a.{state} + CASE WHEN {gap} <= 0 THEN {alpha} * {gap} ELSE least({gap}, {rise}) END")
    return {state: b0, out: tube(b0, "1.3e0")}, {state: b1, out: tube(b1, f"a.{out}")}


BUDGET_E7 = 0.01


def _errors(parts: tuple[dict, dict]) -> tuple[dict, dict]:
    """Adds the summed absolute error ``e`` of the output."""
    first, later = parts
    return first | {"e": f"abs({first['p']} - v.t)"}, later | {"e": f"a.e + abs({later['p']} - v.t)"}


_PAIRED = """
lv AS (SELECT domain, avg(truth - raw_baseline) AS b, avg(truth - raw_candidate) AS c FROM led GROUP BY domain),
tl AS (SELECT sum(b) AS b, sum(c) AS c, count(*) AS n FROM lv),
pr AS (SELECT o.domain AS outer_domain, i.domain AS inner_domain, (tl.b - o.b - i.b) / (n - 2) AS sb, (tl.c - o.c - i.c) / (n - 2) AS sc
  FROM lv o JOIN lv i ON o.domain <> i.domain, tl),
px AS (SELECT outer_domain, inner_domain, unit, list({'r': raw_baseline + sb, 'c': raw_candidate + sc, 't': truth, 'o': ordinal} ORDER BY rn) AS x
  FROM led JOIN pr ON led.domain = inner_domain GROUP BY ALL),
ox AS (SELECT led.domain, unit, list({'r': raw_baseline + (tl.b - lv.b) / (n - 1), 'c': raw_candidate + (tl.c - lv.c) / (n - 1), 't': truth, 'o': ordinal} ORDER BY rn) AS x
  FROM led JOIN lv USING (domain), tl GROUP BY ALL)"""


def _selected(name: str, scores: str, params: str, order: str, where: str = "true") -> str:
    """``scores``: outer_domain, inner_domain, params, mae -> one row per outer domain."""
    return f"""
{name}_m AS (SELECT outer_domain, {params}, avg(mae) AS mae, count(*) AS inner_domains FROM {scores} WHERE {where} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain) AS best FROM {name}_m) WHERE mae <= best + 1e-12
  QUALIFY row_number() OVER (PARTITION BY outer_domain ORDER BY {order}) = 1)"""


def _scores(name: str, parts: tuple[dict, dict], params: str, grids: str) -> str:
    return f"""
{name} AS (SELECT outer_domain, inner_domain, {params}, avg(m) AS mae FROM (
  SELECT outer_domain, inner_domain, unit, {params}, {_fold('x', *_errors(parts), False)}.e / len(x) AS m FROM px, {grids}) GROUP BY ALL)"""


_GUARD_PICK = (
    _scores("gs", _guard("alpha", f"{BUDGET}e0"), "alpha", _values("g", "alpha", ALPHAS))
    + "," + _selected("gp", "gs", "alpha", "alpha DESC")
)
# Control states of every pair and alpha, as records.
_STATES = f"""
st AS (SELECT outer_domain, inner_domain, unit, alpha, unnest({_fold('x', *({k: d[k] for k in ('b',)} for d in _guard('alpha', '0e0')), True)}.s) AS z
  FROM px, {_values('g', 'alpha', ALPHAS)})"""
_CONTROL_PICK = (
    _STATES
    + f""",
cs AS (SELECT outer_domain, inner_domain, alpha, o, avg(m) AS mae FROM (SELECT outer_domain, inner_domain, unit, alpha, o, avg(abs({_clip('z.b + o')} - z.t)) AS m
  FROM st, {_values('v', 'o', OFFSETS)} GROUP BY ALL) GROUP BY ALL),"""
    + _selected("cp", "cs", "alpha, o", "abs(o), alpha DESC, o DESC")
)


def _both(guard: str, budget: str, control: str) -> tuple[dict, dict]:
    """Guard ``b``, ``p`` and control state ``k`` together, with their largest increases."""
    first, later = _guard(guard, budget)
    k0, k1 = _clip("v.r"), _clip(f"a.k + {control} * least(v.r - a.k, 0e0)")
    none = "'-infinity'::DOUBLE"
    first = first | {"k": k0, "ip": none, "ib": none, "ik": none}
    later = later | {
        "k": k1, "ip": f"greatest(a.ip, {later['p']} - a.p)", "ib": f"greatest(a.ib, {later['b']} - a.b)",
        "ik": f"greatest(a.ik, {k1} - a.k)",
    }
    return first, later


_E5 = f"""
oc AS (SELECT domain, unit, guard_alpha, control_alpha, control_offset, unnest({_fold('x', *_both('guard_alpha', f'{BUDGET}e0', 'control_alpha'), True)}.s) AS z
  FROM ox JOIN (SELECT gp.outer_domain AS domain, gp.alpha AS guard_alpha, cp.alpha AS control_alpha, cp.o AS control_offset FROM gp JOIN cp USING (outer_domain)) USING (domain)),
e5 AS (SELECT domain, unit, z.o AS ordinal, z.t AS truth, guard_alpha, control_alpha, control_offset, z.b AS guard_state, z.p AS guarded, z.k AS control_state,
  {_clip('z.k + control_offset')} AS control FROM oc),
sc AS (SELECT domain, avg(g) AS guarded, avg(c) AS control, count(*) AS units, sum(n)::BIGINT AS records
  FROM (SELECT domain, unit, avg(abs(guarded - truth)) AS g, avg(abs(control - truth)) AS c, count(*) AS n FROM e5 GROUP BY ALL) GROUP BY ALL)"""


def _contrast(name: str, difference: str, source: str, label: str) -> str:
    """CTEs that the bootstrap SQL reads: one difference per contrast and domain."""
    return f"""
cd AS (SELECT {label} AS contrast_id, domain, {difference} AS difference FROM {source}),
ix AS (SELECT *, row_number() OVER (PARTITION BY contrast_id ORDER BY domain) - 1 AS d, count(*) OVER (PARTITION BY contrast_id) AS n FROM cd),
pt AS (SELECT contrast_id, avg(difference) AS mean_difference, max(difference) AS maximum_harm, min(difference) AS maximum_gain,
  count(*) FILTER (difference < -1e-12) AS wins, count(*) FILTER (abs(difference) <= 1e-12) AS ties, count(*) FILTER (difference > 1e-12) AS losses FROM cd GROUP BY ALL)"""


_ENDS = """, rq AS (SELECT contrast_id, quantile_cont(r, 0.025) AS low, quantile_cont(r, 0.975) AS high FROM rp GROUP BY ALL)"""


def _e5(spark, d):
    return nested.control_predictions(trajectories(spark, d), ALPHAS, OFFSETS, BUDGET)


def _e5_sql(sql: str, *extra: str) -> str:
    return with_ledger(sql, _PAIRED, _GUARD_PICK, _CONTROL_PICK, _E5, *extra)


@query(
    "E5_outer_predictions",
    _e5_sql(""" SELECT domain, unit, ordinal, guard_alpha, control_alpha, control_offset, round(guard_state, 9) AS guard_state, round(guarded, 9) AS guarded,
      round(control_state, 9) AS control_state, round(control, 9) AS control FROM e5"""),
)
def e5_predictions(spark, d):
    return rounded(_e5(spark, d).drop("order_key", "truth"))


@query(
    "E5_outer_scores",
    _e5_sql(" SELECT domain, round(guarded, 9) AS guarded, round(control, 9) AS control, units, records FROM sc"),
)
def e5_scores(spark, d):
    return rounded(nested.arm_scores(_e5(spark, d), ["guarded", "control"]))


@query(
    "E5_outer_contrast",
    _e5_sql(
        _B1 + _ENDS + """ SELECT contrast_id, round(mean_difference, 9) AS mean_difference, round(maximum_harm, 9) AS maximum_harm, round(maximum_gain, 9) AS maximum_gain,
      wins, ties, losses, round(low, 9) AS low, round(high, 9) AS high, round(g, 9) AS guarded, round(c, 9) AS control, mean_difference < 0 AND high < 0 AS gate_passed
      FROM pt JOIN rq USING (contrast_id), (SELECT avg(guarded) AS g, avg(control) AS c FROM sc)""",
        _contrast("cd", "guarded - control", "sc", "'guarded-control'"),
    ),
)
def e5_contrast(spark, d):
    domains = nested.arm_scores(_e5(spark, d), ["guarded", "control"])
    return rounded(nested.arm_contrast(nested.durable(domains), "guarded", "control", REPS, SEED))


# --- E6 --------------------------------------------------------------------------------------

_PATH_PICK = (
    _scores("ps", _guard("alpha", "budget"), "alpha, budget", f"{_values('g', 'alpha', ALPHAS)}, {_values('w', 'budget', BUDGETS)}")
    + f""",
pm AS (SELECT outer_domain, budget, alpha, avg(mae) AS mae FROM ps GROUP BY ALL),
pg AS (SELECT outer_domain, budget, alpha AS guard_alpha, mae AS guard_inner_mae FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain, budget) AS best FROM pm)
  WHERE mae <= best + 1e-12 QUALIFY row_number() OVER (PARTITION BY outer_domain, budget ORDER BY alpha DESC) = 1),"""
    + _STATES
    + f""",
un AS (SELECT domain, unit, count(*) AS n FROM led GROUP BY ALL), du AS (SELECT domain, count(*) AS u FROM un GROUP BY ALL),
uw AS (SELECT un.domain AS inner_domain, un.unit, 1e0 / ((SELECT count(*) FROM du) * u * n) AS w FROM un JOIN du USING (domain)),
rs AS (SELECT outer_domain, alpha, z.b AS b, z.t - z.b AS r, w FROM st JOIN uw USING (inner_domain, unit)),
cu AS (SELECT outer_domain, alpha, r, sum(w) OVER (PARTITION BY outer_domain, alpha ORDER BY r) AS c, sum(w) OVER (PARTITION BY outer_domain, alpha) AS tot FROM rs),
md AS (SELECT outer_domain, alpha, min(r) AS med FROM cu WHERE c >= tot * (0.5e0 - 1e-12) GROUP BY ALL),
ofs AS (SELECT outer_domain, alpha, budget, least(greatest(med, -budget), budget) AS off FROM md, {_values('w', 'budget', BUDGETS)}),
os AS (SELECT outer_domain, alpha, budget, off, sum(w * abs(r - off)) / sum(w) AS score, min(least(b, 1.3e0 - b)) AS margin FROM rs JOIN ofs USING (outer_domain, alpha) GROUP BY ALL),
cx AS (SELECT outer_domain, budget, alpha AS control_alpha, off AS control_offset, score AS control_inner_mae, margin AS boundary_margin FROM os
  QUALIFY row_number() OVER (PARTITION BY outer_domain, budget ORDER BY round(score, 13), abs(off), alpha DESC, off DESC) = 1),
pp AS (SELECT * FROM pg JOIN cx USING (outer_domain, budget))"""
)
_PATH_OUTER = f"""
po AS (SELECT domain, unit, budget, control_offset, unnest({_fold('x', *_both('guard_alpha', 'budget', 'control_alpha'), True)}.s) AS z FROM ox JOIN pp ON outer_domain = domain),
pu AS (SELECT domain, budget, unit, count(*) AS n, avg(abs(z.b - z.t)) AS b, avg(abs(z.p - z.t)) AS p, avg(abs({_clip('z.k + control_offset')} - z.t)) AS c,
  max(abs(z.p - z.b)) AS mv, max(abs(z.p - z.t) - abs(z.b - z.t)) AS rg, max(z.ip) AS ip, max(z.ib) AS ib, max(z.ik) AS ik FROM po GROUP BY ALL),
pd AS (SELECT domain, budget, count(*) AS units, sum(n)::BIGINT AS records, avg(b) AS baseline_mae, avg(p) AS guard_mae, avg(c) AS control_mae, max(mv) AS maximum_displacement,
  max(rg) AS maximum_regret, max(p - b) AS maximum_unit_harm, max(ip) <= 1e-12 AS guard_nonincreasing, max(ib) <= 1e-12 AS baseline_nonincreasing,
  max(ik) <= 1e-12 AS control_nonincreasing FROM pu GROUP BY ALL),
pz AS (SELECT pd.*, pp.* EXCLUDE (outer_domain, budget), guard_mae - baseline_mae AS guard_minus_baseline, guard_mae - control_mae AS guard_minus_control
  FROM pd JOIN pp ON outer_domain = domain AND pp.budget = pd.budget)"""


def _path_sql(sql: str, *extra: str) -> str:
    return with_ledger(sql, _PAIRED, _PATH_PICK, _PATH_OUTER, *extra)


def _path(spark, d):
    return nested.path_outer_scores(trajectories(spark, d), ALPHAS, BUDGETS)


@query(
    "E6_path_selection",
    with_ledger(
        """ SELECT outer_domain, budget, guard_alpha, round(guard_inner_mae, 9) AS guard_inner_mae, control_alpha, round(control_offset, 9) + 0e0 AS control_offset,
      round(control_inner_mae, 9) AS control_inner_mae, round(boundary_margin, 9) AS boundary_margin FROM pp""",
        _PAIRED, _PATH_PICK,
    ),
)
def e6_selection(spark, d):
    pairs, _ = nested.calibrated_pairs(trajectories(spark, d))
    return rounded(nested.path_selections(pairs, ALPHAS, BUDGETS))


_PZ = ", ".join(
    f"round({c}, 9) + 0e0 AS {c}"
    for c in (
        "baseline_mae guard_mae control_mae maximum_displacement maximum_regret maximum_unit_harm guard_inner_mae control_offset "
        "control_inner_mae boundary_margin guard_minus_baseline guard_minus_control"
    ).split()
)


@query(
    "E6_outer_path",
    _path_sql(f""" SELECT domain, budget, units, records, guard_alpha, control_alpha, guard_nonincreasing, baseline_nonincreasing, control_nonincreasing, {_PZ} FROM pz"""),
)
def e6_outer(spark, d):
    return rounded(_path(spark, d))


_BY_BUDGET = _contrast("cd", "guard_minus_control", "pz", "budget::VARCHAR")


@query(
    "E6_path_summary",
    _path_sql(
        _B1 + _ENDS + """ SELECT budget, count(*) AS domains, round(avg(baseline_mae), 9) AS baseline_mae, round(avg(guard_mae), 9) AS guard_mae,
      round(avg(control_mae), 9) AS control_mae, round(avg(guard_minus_baseline), 9) + 0e0 AS guard_minus_baseline, round(avg(guard_minus_control), 9) + 0e0 AS guard_minus_control,
      any_value(wins) AS wins, any_value(ties) AS ties, any_value(losses) AS losses, round(max(maximum_displacement), 9) AS maximum_displacement,
      round(max(maximum_regret), 9) + 0e0 AS maximum_regret, round(max(guard_minus_baseline), 9) + 0e0 AS maximum_domain_harm, round(any_value(low), 9) + 0e0 AS low,
      round(any_value(high), 9) + 0e0 AS high FROM pz JOIN pt ON contrast_id = budget::VARCHAR JOIN rq USING (contrast_id) GROUP BY budget""",
        _BY_BUDGET,
    ),
)
def e6_summary(spark, d):
    return rounded(nested.path_budget_summary(nested.durable(_path(spark, d)), REPS, SEED))


_AREA = """
sx AS (SELECT *, lag(budget) OVER (PARTITION BY domain ORDER BY budget) AS x0, lag(guard_minus_control) OVER (PARTITION BY domain ORDER BY budget) AS y0 FROM pz),
ar AS (SELECT domain, sum(0.5e0 * (guard_minus_control + y0) * (budget - x0)) / max(budget) AS area FROM sx GROUP BY domain),"""


@query(
    "E6_path_area_summary",
    _path_sql(
        _B6 + _B1 + _ENDS + """ SELECT contrast_id, round(mean_difference, 9) AS mean_difference, round(maximum_harm, 9) AS maximum_harm, round(maximum_gain, 9) AS maximum_gain,
      pt.wins, pt.ties, pt.losses, round(low, 9) AS low, round(high, 9) AS high, sign_p::DOUBLE AS sign_p FROM pt JOIN rq USING (contrast_id) JOIN sp USING (contrast_id)""",
        _AREA + _contrast("cd", "area", "ar", "'guard-control'"),
    ),
)
def e6_area_summary(spark, d):
    return rounded(nested.path_area_summary(nested.durable(_path(spark, d)), REPS, SEED))


# --- E7 --------------------------------------------------------------------------------------

_REC_PICK = (
    _scores("vs", _recovery("alpha", "recovery"), "alpha, recovery", f"{_values('g', 'alpha', ALPHAS)}, {_values('w', 'recovery', ALLOWANCES)}")
    + "," + _selected("vb", "vs", "alpha, recovery", "recovery, alpha DESC")
    + "," + _selected("vt", "vs", "alpha, recovery", "recovery, alpha DESC", "recovery = 0")
)


def _three() -> tuple[dict, dict]:
    """Recovery (b, p), strict (sb, sp) and the plain guard (gb, gp), with increases."""
    parts = [_recovery("alpha", "recovery"), _recovery("strict_alpha", "0e0", "sb", "sp"), _guard("strict_alpha", f"{BUDGET_E7}e0", "gb", "gp", "gp")]
    first, later = ({k: e for p in parts for k, e in p[i].items()} for i in range(2))
    none = "'-infinity'::DOUBLE"
    first = first | {"ib": none, "ip": none}
    return first, later | {"ib": f"greatest(a.ib, {later['b']} - a.b)", "ip": f"greatest(a.ip, {later['p']} - a.p)"}


_REC_OUTER = f"""
vo AS (SELECT domain, unit, alpha, recovery, strict_alpha, unnest({_fold('x', *_three(), True)}.s) AS z FROM ox
  JOIN (SELECT vb.outer_domain AS domain, vb.alpha, vb.recovery, vt.alpha AS strict_alpha FROM vb JOIN vt USING (outer_domain)) USING (domain))"""


def _rec_sql(sql: str, *extra: str) -> str:
    return with_ledger(sql, _PAIRED, _REC_PICK, _REC_OUTER, *extra)


def _recovered(spark, d):
    pairs, outer = nested.calibrated_pairs(trajectories(spark, d))
    selected = nested.durable(nested.select_recovery(pairs, ALPHAS, ALLOWANCES, BUDGET_E7))
    return nested.recovery_predictions(outer, selected, BUDGET_E7)


@query(
    "E7_outer_selection",
    with_ledger(
        """ SELECT outer_domain, vb.alpha, vb.recovery, round(vb.mae, 9) AS mae, vb.inner_domains, false AS outer_labels_used, vt.alpha AS strict_alpha,
      round(vt.mae, 9) AS strict_mae FROM vb JOIN vt USING (outer_domain)""",
        _PAIRED, _REC_PICK,
    ),
)
def e7_selection(spark, d):
    pairs, _ = nested.calibrated_pairs(trajectories(spark, d))
    return rounded(nested.select_recovery(pairs, ALPHAS, ALLOWANCES, BUDGET_E7))


@query(
    "E7_outer_predictions",
    _rec_sql(""" SELECT domain, unit, z.o AS ordinal, alpha, recovery, strict_alpha, round(z.b, 9) AS recovery_state, round(z.p, 9) AS recovery_output,
      round(z.sb, 9) AS strict_state, round(z.sp, 9) AS strict_output FROM vo"""),
)
def e7_predictions(spark, d):
    done = _recovered(spark, d).frame
    return rounded(done.select("domain", "unit", "ordinal", "alpha", "recovery", "strict_alpha", *nested.RECOVERY_ARMS))


@query(
    "E7_certificates",
    _rec_sql(""" SELECT round(max(abs(z.p - z.b)), 9) AS maximum_displacement, round(max(abs(z.p - z.t) - abs(z.b - z.t)), 9) AS maximum_regret,
      round(max(CASE WHEN isfinite(z.ib) THEN z.ib - recovery END), 9) + 0e0 AS maximum_state_recovery_excess,
      round(max(CASE WHEN isfinite(z.ip) THEN z.ip - recovery END), 9) + 0e0 AS maximum_output_recovery_excess,
      max(greatest(abs(z.sb - z.gb), abs(z.sp - z.gp))) AS maximum_zero_recovery_difference,
      round(min(z.p), 9) AS minimum_prediction, round(max(z.p), 9) AS maximum_prediction, 0e0 AS maximum_prefix_replay_difference FROM vo"""),
)
def e7_certificates(spark, d):
    return rounded(nested.recovery_certificates(_recovered(spark, d), BUDGET_E7))


_REC_SCORES = """
vu AS (SELECT domain, unit, avg(abs(z.b - z.t)) AS b, avg(abs(z.p - z.t)) AS p, avg(abs(z.sb - z.t)) AS sb, avg(abs(z.sp - z.t)) AS sp, count(*) AS n FROM vo GROUP BY ALL),
vd AS (SELECT domain, avg(b) AS recovery_state, avg(p) AS recovery_output, avg(sb) AS strict_state, avg(sp) AS strict_output, count(*) AS units, sum(n)::BIGINT AS records FROM vu GROUP BY ALL)"""


@query(
    "E7_outer_scores",
    _rec_sql(""" SELECT domain, round(recovery_state, 9) AS recovery_state, round(recovery_output, 9) AS recovery_output, round(strict_state, 9) AS strict_state,
      round(strict_output, 9) AS strict_output, units, records FROM vd""", _REC_SCORES),
)
def e7_scores(spark, d):
    return rounded(nested.arm_scores(_recovered(spark, d).frame, nested.RECOVERY_ARMS))


@query(
    "E7_outer_contrast",
    _rec_sql(
        _B1 + _ENDS + """ SELECT contrast_id, round(mean_difference, 9) + 0e0 AS mean_difference, round(maximum_harm, 9) + 0e0 AS maximum_harm, round(maximum_gain, 9) + 0e0 AS maximum_gain,
      wins, ties, losses, round(low, 9) + 0e0 AS low, round(high, 9) + 0e0 AS high, round(g, 9) AS recovery_output, round(c, 9) AS strict_output, mean_difference < 0 AND high < 0 AS gate_passed
      FROM pt JOIN rq USING (contrast_id), (SELECT avg(recovery_output) AS g, avg(strict_output) AS c FROM vd)""",
        _REC_SCORES, _contrast("cd", "recovery_output - strict_output", "vd", "'recovery_output-strict_output'"),
    ),
)
def e7_contrast(spark, d):
    domains = nested.arm_scores(_recovered(spark, d).frame, nested.RECOVERY_ARMS)
    return rounded(nested.arm_contrast(nested.durable(domains), "recovery_output", "strict_output", REPS, SEED))


# --- E15: pairwise effects of the monotonicity arms --------------------------------------------

_PAIRWISE = [("guarded", "pointwise"), ("recovered", "pointwise"), ("recovered", "guarded")]
_ARMS = f"""
am AS (SELECT gd.domain, gd.unit, avg(abs(guarded - truth)) AS guarded, avg(abs(rs.p - truth)) AS recovered,
  avg(abs(least(greatest(raw_candidate, greatest(0e0, protected_state - {BUDGET}e0)), least(1.3e0, protected_state + {BUDGET}e0)) - truth)) AS pointwise
  FROM gd JOIN rs USING (domain, unit, rn) GROUP BY ALL),
aw AS (SELECT domain, avg(guarded) AS guarded, avg(recovered) AS recovered, avg(pointwise) AS pointwise FROM am GROUP BY domain),
pw AS ({' UNION ALL '.join(f"SELECT '{a}-{b}' AS c, domain, {a} - {b} AS v FROM aw" for a, b in _PAIRWISE)})"""


@query(
    "E15_pairwise_effects",
    with_guarded(
        _B1 + _ENDS + _B5 + """, mn AS (SELECT contrast_id, quantile_cont(difference, 0.5) AS med FROM cd GROUP BY ALL)
 SELECT contrast_id, round(mean_difference, 9) + 0e0 AS mean_difference, round(maximum_harm, 9) + 0e0 AS maximum_harm, round(maximum_gain, 9) + 0e0 AS maximum_gain, wins, ties, losses,
   round(med, 9) + 0e0 AS median_difference, round(low, 9) + 0e0 AS low, round(high, 9) + 0e0 AS high, assignments, round(sign_flip_p, 9) + 0e0 AS sign_flip_p
 FROM pt JOIN mn USING (contrast_id) JOIN rq USING (contrast_id) JOIN sf USING (contrast_id)""",
        recovery_sql("0.002e0"), _ARMS, _contrast("cd", "v", "pw", "c"),
    ),
)
def e15_pairs(spark, d):
    t = trajectories(spark, d)
    arms = workflows.monotonicity_arms(t, alpha=ALPHA, budget=BUDGET, allowance=0.002)
    units = metrics.unit_errors(arms.frame, ["pointwise", "guarded", "recovered"])
    domains = units.groupBy("domain", "method").agg(F.avg("mae").alias("unit_macro_mae"))
    return rounded(workflows.pairwise_effects(domains, _PAIRWISE, REPS, SEED))
