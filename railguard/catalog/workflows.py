"""Evaluation workflows (E1-E18) and the pair cache (S12) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import (
    ALPHA, BUDGET, LEDGER_SQL, SHIFT, guarded, ledger, query, trajectories, with_guarded,
    with_ledger,
)
from railguard.catalog.evaluation import domain_table, rounded, with_metrics
from railguard.catalog.inference import _B2, _B5, _UNITS, REPS, SEED, unit_contrasts
from railguard.catalog.trajectory import (
    RECOVERY_GRID, _RECOVERY_GRID, isotonic_sql, recovery_sql,
)
from railguard.operators import metrics
from railguard.plans import workflows

MINIMUM_WINS = 3
ALPHAS = [1.0, 0.5, 0.2, 0.05]
BUDGETS = [0.01, 0.02, 0.05]
OFFSETS = [round(-0.02 + 0.01 * i, 2) for i in range(5)]
_A = ", ".join(f"({a}e0)" for a in ALPHAS)
_B = ", ".join(f"({b}e0)" for b in BUDGETS)

# State for every alpha, then the guard for every (alpha, budget).
GRID_SQL = f"""
ga AS (SELECT l.*, alpha FROM led l, (VALUES {_A}) g(alpha)),
gs AS (
  SELECT domain, unit, alpha, rn, least(greatest(raw_baseline, 0e0), 1.3e0) AS b FROM ga WHERE rn = 1
  UNION ALL
  SELECT l.domain, l.unit, l.alpha, l.rn, least(greatest(s.b + l.alpha * least(l.raw_baseline - s.b, 0e0), 0e0), 1.3e0)
  FROM gs s JOIN ga l ON l.domain = s.domain AND l.unit = s.unit AND l.alpha = s.alpha AND l.rn = s.rn + 1),
gb AS (SELECT ga.*, b FROM ga JOIN gs USING (domain, unit, alpha, rn)),
go AS (SELECT domain, unit, alpha, budget, rn, truth, b,
   min(least(greatest(raw_candidate, greatest(0e0, b - budget)), least(1.3e0, b + budget))) OVER (PARTITION BY domain, unit, alpha, budget ORDER BY rn) AS p
  FROM gb, (VALUES {_B}) v(budget)),
sc AS (SELECT domain, alpha, budget, avg(m) AS mae FROM (SELECT domain, unit, alpha, budget, avg(abs(p - truth)) AS m FROM go GROUP BY ALL) GROUP BY ALL),
dn AS (SELECT DISTINCT domain FROM led),
pr AS (SELECT a.domain AS outer_domain, b.domain AS inner_domain FROM dn a JOIN dn b ON a.domain <> b.domain)"""


def with_grid(sql: str, *extra: str) -> str:
    return with_ledger(sql, GRID_SQL, *extra)


@query(
    "E1_mechanism_decision",
    with_metrics(_B2 + f""", x AS (SELECT *, abs(guarded - protected_state) AS moved, abs(guarded - truth) - abs(protected_state - truth) AS regret,
   guarded - lag(guarded) OVER w AS inc, protected_state - lag(protected_state) OVER w AS sinc FROM gd WINDOW w AS (PARTITION BY domain, unit ORDER BY rn)),
 c AS (SELECT max(moved) AS md, max(regret) AS mr, coalesce(max(inc), 0e0) AS mi, coalesce(max(sinc), 0e0) AS ms, min(guarded) AS lo, max(guarded) AS hi FROM x),
 o AS (SELECT avg(difference) AS mf, count(*) FILTER (difference < -1e-12) AS wf FROM cd WHERE contrast_id = 'guarded-fixed_shift'),
 u AS (SELECT quantile_cont(r, 0.975) AS up FROM rp WHERE contrast_id = 'guarded-fixed_shift'),
 g AS (SELECT *, md <= {BUDGET}e0 + 1e-12 AND mr <= {BUDGET}e0 + 1e-12 AND ms <= 1e-12 AND mi <= 1e-12 AND lo >= -1e-12 AND hi <= 1.3e0 + 1e-12 AS kept FROM c, o, u)
 SELECT round(mf, 9) AS minus_fixed_shift, round(up, 9) AS high, wf AS wins, md AS maximum_displacement, 0e0 AS replay_difference,
   CASE WHEN NOT kept THEN 'REJECT' WHEN mf < 0 AND up < 0 AND wf >= {MINIMUM_WINS} THEN 'RETAIN' ELSE 'NARROW' END AS verdict FROM g""", _UNITS),
)
def e1(spark, d):
    out = workflows.mechanism_decision(
        trajectories(spark, d), alpha=ALPHA, budget=BUDGET, shift=SHIFT, minimum_wins=MINIMUM_WINS,
        reps=REPS, seed=SEED,
    )
    return out.select(
        F.round("minus_fixed_shift", 9).alias("minus_fixed_shift"), F.round("high", 9).alias("high"),
        "wins", "maximum_displacement", "replay_difference", "verdict",
    )


_HOLD = """
lv AS (SELECT domain, avg(truth - raw_candidate) AS level FROM led GROUP BY domain),
sh AS (SELECT outer_domain, inner_domain, ((SELECT sum(level) FROM lv) - o.level - i.level) / ((SELECT count(*) FROM lv) - 2) AS shift
  FROM pr JOIN lv o ON o.domain = outer_domain JOIN lv i ON i.domain = inner_domain),
ho AS (SELECT outer_domain, inner_domain, l.unit, l.rn, l.ordinal, l.truth, l.raw_candidate + shift AS c FROM led l JOIN sh ON l.domain = inner_domain)"""
_PAIRS = """
dn AS (SELECT DISTINCT domain FROM led),
pr AS (SELECT a.domain AS outer_domain, b.domain AS inner_domain FROM dn a JOIN dn b ON a.domain <> b.domain)"""


@query(
    "S12_double_holdout_cache",
    with_ledger(
        " SELECT outer_domain AS excluded_a, inner_domain AS excluded_b, unit, ordinal, round(c, 9) AS raw_candidate FROM ho",
        _PAIRS, _HOLD,
    ),
)
def s12(spark, d):
    from railguard.session import scratch_path
    from railguard.sources.tables import read_pair_cache, write_pair_cache

    pairs = workflows.double_holdout(ledger(spark, d)).select(
        F.col("outer_domain").alias("excluded_a"), F.col("inner_domain").alias("excluded_b"),
        "unit", "ordinal", "raw_candidate",
    )
    path = scratch_path(spark, "pairs")
    write_pair_cache(pairs, path)
    keys = ["excluded_a", "excluded_b", "unit", "ordinal"]
    cached = read_pair_cache(spark, path, [*keys, "raw_candidate"], keys)
    return cached.withColumn("raw_candidate", F.round("raw_candidate", 9))


_NESTED = f"""
np AS (SELECT ho.outer_domain, ho.inner_domain, ho.unit, gb.alpha, gb.rn, gb.truth,
   min(least(greatest(ho.c, greatest(0e0, b - {BUDGET}e0)), least(1.3e0, b + {BUDGET}e0))) OVER (PARTITION BY ho.outer_domain, ho.unit, gb.alpha ORDER BY gb.rn) AS p
  FROM ho JOIN gb ON gb.domain = ho.inner_domain AND gb.unit = ho.unit AND gb.rn = ho.rn),
nn AS (SELECT outer_domain, inner_domain, alpha, avg(m) AS mae, count(*) AS units, sum(n)::BIGINT AS records
  FROM (SELECT outer_domain, inner_domain, unit, alpha, avg(abs(p - truth)) AS m, count(*) AS n FROM np GROUP BY ALL) GROUP BY ALL),
nm AS (SELECT outer_domain, alpha, avg(mae) AS mae, count(*) AS inner_domains FROM nn GROUP BY ALL),
sl AS (SELECT outer_domain, alpha, mae, inner_domains, false AS outer_labels_used FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain) AS best FROM nm)
  WHERE mae <= best + 1e-12 QUALIFY row_number() OVER (PARTITION BY outer_domain ORDER BY alpha DESC) = 1)"""


@query(
    "E3_nested_alpha_scores",
    with_grid(" SELECT outer_domain, inner_domain, alpha, units, records, round(mae, 9) AS mae FROM nn", _HOLD, _NESTED),
)
def e3_scores(spark, d):
    out = workflows.nested_alpha_scores(trajectories(spark, d), ALPHAS, BUDGET)
    return out.withColumn("mae", F.round("mae", 9))


@query(
    "E3_nested_selection",
    with_grid(" SELECT outer_domain, alpha, round(mae, 9) AS mae, inner_domains, outer_labels_used FROM sl", _HOLD, _NESTED),
)
def e3(spark, d):
    scores = workflows.nested_alpha_scores(trajectories(spark, d), ALPHAS, BUDGET)
    return workflows.select_alpha(scores).withColumn("mae", F.round("mae", 9))


@query(
    "E4_outer_scoring",
    with_grid(f""", oo AS (SELECT gb.domain, gb.unit, gb.alpha, gb.rn, gb.truth, gb.b, min(least(greatest(raw_candidate, greatest(0e0, b - {BUDGET}e0)), least(1.3e0, b + {BUDGET}e0)))
    OVER (PARTITION BY gb.domain, gb.unit ORDER BY gb.rn) AS p FROM gb JOIN sl ON sl.outer_domain = gb.domain AND sl.alpha = gb.alpha),
  ou AS (SELECT domain, unit, any_value(alpha) AS alpha, avg(abs(p - truth)) AS g, avg(abs(b - truth)) AS s FROM oo GROUP BY ALL)
 SELECT domain, any_value(alpha) AS selected_alpha, count(*) AS units, round(avg(g), 9) AS guarded, round(avg(s), 9) AS protected_state FROM ou GROUP BY domain""", _HOLD, _NESTED),
)
def e4(spark, d):
    t = trajectories(spark, d)
    selected = workflows.select_alpha(workflows.nested_alpha_scores(t, ALPHAS, BUDGET))
    done = workflows.apply_selected_alpha(t, selected, ALPHAS, BUDGET).frame
    error = lambda m: F.avg(F.abs(F.col(m) - F.col("truth"))).alias(m)
    units = done.groupBy("domain", "unit").agg(
        F.max("selected_alpha").alias("selected_alpha"), error("guarded"), error("protected_state")
    )
    return units.groupBy("domain").agg(
        F.max("selected_alpha").alias("selected_alpha"), F.count(F.lit(1)).alias("units"),
        F.round(F.avg("guarded"), 9).alias("guarded"),
        F.round(F.avg("protected_state"), 9).alias("protected_state"),
    )


_OFF = ", ".join(f"({o}e0)" for o in OFFSETS)
_CONTROL = f"""
cs AS (SELECT domain, alpha, o AS offset_, avg(m) AS mae FROM (SELECT domain, unit, alpha, o, avg(abs(least(greatest(b + o, 0e0), 1.3e0) - truth)) AS m
   FROM gb, (VALUES {_OFF}) v(o) GROUP BY ALL) GROUP BY ALL),
cm AS (SELECT outer_domain, alpha, offset_, avg(mae) AS mae, count(*) AS inner_domains FROM pr JOIN cs ON cs.domain = inner_domain GROUP BY ALL)"""


@query(
    "E5_candidate_free_control",
    with_grid(""" SELECT outer_domain, alpha, offset_ AS "offset", round(mae, 9) AS mae, inner_domains, false AS outer_labels_used
      FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain) AS best FROM cm) WHERE mae <= best + 1e-12
      QUALIFY row_number() OVER (PARTITION BY outer_domain ORDER BY abs(offset_), alpha DESC, offset_ DESC) = 1""", _CONTROL),
)
def e5(spark, d):
    scores = workflows.shift_control_scores(trajectories(spark, d), ALPHAS, OFFSETS)
    out = workflows.select_shift_control(scores)
    return out.withColumn("mae", F.round("mae", 9))


_PATH = """
gm AS (SELECT outer_domain, budget, alpha, avg(mae) AS mae FROM pr JOIN sc ON sc.domain = inner_domain GROUP BY ALL),
gc AS (SELECT outer_domain, budget, alpha FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain, budget) AS best FROM gm)
  WHERE mae <= best + 1e-12 QUALIFY row_number() OVER (PARTITION BY outer_domain, budget ORDER BY alpha DESC) = 1),
un AS (SELECT domain, unit, count(*) AS n FROM led GROUP BY ALL), du AS (SELECT domain, count(*) AS u FROM un GROUP BY ALL),
wt AS (SELECT un.domain, un.unit, 1e0 / ((SELECT count(*) FROM du) * u * n) AS w FROM un JOIN du USING (domain)),
rs AS (SELECT outer_domain, alpha, truth - b AS r, w FROM gb JOIN wt USING (domain, unit) JOIN pr ON pr.inner_domain = gb.domain),
cu AS (SELECT *, sum(w) OVER (PARTITION BY outer_domain, alpha ORDER BY r) AS c, sum(w) OVER (PARTITION BY outer_domain, alpha) AS tot FROM rs),
md AS (SELECT outer_domain, alpha, min(r) AS med FROM cu WHERE c >= tot * (0.5e0 - 1e-12) GROUP BY ALL),
of AS (SELECT outer_domain, alpha, budget, least(greatest(med, -budget), budget) AS off FROM md, (SELECT DISTINCT budget FROM sc)),
os AS (SELECT outer_domain, alpha, budget, off, sum(w * abs(r - off)) / sum(w) AS score FROM rs JOIN of USING (outer_domain, alpha) GROUP BY ALL),
oc AS (SELECT outer_domain, budget, alpha, off FROM (SELECT *, min(score) OVER (PARTITION BY outer_domain, budget) AS best FROM os)
  WHERE score <= best QUALIFY row_number() OVER (PARTITION BY outer_domain, budget ORDER BY abs(off), alpha DESC, off DESC) = 1),
ce AS (SELECT domain, budget, avg(m) AS control_mae FROM (SELECT gb.domain, gb.unit, oc.budget, avg(abs(least(greatest(b + off, 0e0), 1.3e0) - truth)) AS m
   FROM gb JOIN oc ON oc.outer_domain = gb.domain AND oc.alpha = gb.alpha GROUP BY ALL) GROUP BY ALL),
bp AS (SELECT gc.outer_domain AS domain, gc.budget, gc.alpha AS guard_alpha, sc.mae AS guard_mae, oc.alpha AS control_alpha, oc.off AS control_offset, control_mae,
   sc.mae - control_mae AS difference
  FROM gc JOIN sc ON sc.domain = gc.outer_domain AND sc.budget = gc.budget AND sc.alpha = gc.alpha
  JOIN oc ON oc.outer_domain = gc.outer_domain AND oc.budget = gc.budget JOIN ce ON ce.domain = gc.outer_domain AND ce.budget = gc.budget)"""


@query(
    "E6_budget_path",
    with_grid(""" SELECT domain, budget, guard_alpha, round(guard_mae, 9) AS guard_mae, control_alpha, round(control_offset, 9) AS control_offset,
      round(control_mae, 9) AS control_mae, round(difference, 9) + 0e0 AS difference FROM bp""", _PATH),
)
def e6(spark, d):
    out = workflows.budget_path(trajectories(spark, d), ALPHAS, BUDGETS)
    return rounded(out)


@query(
    "E6_budget_path_area",
    with_grid(""", s AS (SELECT *, lag(budget) OVER (PARTITION BY domain ORDER BY budget) AS x0, lag(difference) OVER (PARTITION BY domain ORDER BY budget) AS y0 FROM bp)
 SELECT domain, round(sum(0.5e0 * (difference + y0) * (budget - x0)) / max(budget), 9) AS normalised_area FROM s GROUP BY domain""", _PATH),
)
def e6_area(spark, d):
    path = workflows.budget_path(trajectories(spark, d), ALPHAS, BUDGETS)
    return rounded(metrics.path_area(path, ["domain"], "budget", "difference"))


_REC = """
rsx AS (SELECT domain, alpha, recovery, avg(m) AS mae FROM (SELECT domain, unit, alpha, recovery, avg(abs(p - truth)) AS m FROM cfg JOIN rg USING (domain, unit, ci, rn) GROUP BY ALL) GROUP BY ALL),
rm AS (SELECT outer_domain, alpha, recovery, avg(mae) AS mae, count(*) AS inner_domains FROM pr JOIN rsx ON rsx.domain = inner_domain GROUP BY ALL),
rb AS (SELECT * FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain) AS best FROM rm) WHERE mae <= best + 1e-12 QUALIFY row_number() OVER (PARTITION BY outer_domain ORDER BY recovery, alpha DESC) = 1),
rt AS (SELECT * FROM (SELECT *, min(mae) OVER (PARTITION BY outer_domain) AS best FROM rm WHERE recovery = 0) WHERE mae <= best + 1e-12 QUALIFY row_number() OVER (PARTITION BY outer_domain ORDER BY alpha DESC) = 1)"""


@query(
    "E7_recovery_selection",
    with_ledger(""" SELECT outer_domain, rb.alpha, rb.recovery, round(rb.mae, 9) AS mae, rb.inner_domains, false AS outer_labels_used,
      rt.alpha AS strict_alpha, round(rt.mae, 9) AS strict_mae FROM rb JOIN rt USING (outer_domain)""", _RECOVERY_GRID, _PAIRS, _REC),
)
def e7(spark, d):
    out = workflows.recovery_selection(trajectories(spark, d), RECOVERY_GRID, 0.01)
    return out.withColumns({c: F.round(c, 9) for c in ("mae", "strict_mae")})


_CAPPED = "s + least(greatest(c - s, -budget), budget)"


@query(
    "E8_offline_frontier",
    with_ledger(f""", jo AS (SELECT domain, unit, truth, bs.f AS s, cs.f AS c FROM led JOIN bs USING (domain, unit, rn) JOIN cs USING (domain, unit, rn)),
 u AS (SELECT domain, unit, budget, avg(abs({_CAPPED} - truth)) AS m, avg(abs({_CAPPED} - truth)) - avg(abs(s - truth)) AS g, max(abs({_CAPPED} - s)) AS moved
   FROM jo, (VALUES {_B}) v(budget) GROUP BY ALL),
 dd AS (SELECT budget, domain, avg(m) AS m, max(g) AS ug, avg(g) AS dg, max(moved) AS moved FROM u GROUP BY ALL)
 SELECT budget, round(avg(m), 9) AS domain_equal_mae, round(max(ug), 9) + 0e0 AS maximum_unit_harm, round(max(dg), 9) + 0e0 AS maximum_domain_harm,
   round(max(moved), 9) AS maximum_displacement FROM dd GROUP BY budget""",
        isotonic_sql("bs", "led", "raw_baseline"), isotonic_sql("cs", "led", "raw_candidate")),
)
def e8(spark, d):
    return rounded(workflows.offline_frontier(trajectories(spark, d), BUDGETS))


@query(
    "E9_component_attribution",
    with_metrics(""", w AS (SELECT domain, max(unit_macro_mae) FILTER (method = 'guarded') AS g, max(unit_macro_mae) FILTER (method = 'fixed_shift') AS f,
   max(unit_macro_mae) FILTER (method = 'protected_state') AS s FROM dm GROUP BY domain),
 e AS (SELECT 'fixed_shift' AS variant, f - g AS dif FROM w UNION ALL SELECT 'protected_state', s - g FROM w)
 SELECT variant, round(avg(dif), 9) AS mean_difference, round(max(dif), 9) AS maximum_harm, round(min(dif), 9) AS maximum_gain,
   count(*) FILTER (dif < -1e-12) AS wins, count(*) FILTER (abs(dif) <= 1e-12) AS ties, count(*) FILTER (dif > 1e-12) AS losses FROM e GROUP BY variant"""),
)
def e9(spark, d):
    out = workflows.component_attribution(domain_table(spark, d), "guarded", ["fixed_shift", "protected_state"])
    return rounded(out)


_SWAP = ",".join([LEDGER_SQL.replace("led AS", "l0 AS", 1)])


@query(
    "E10_backbone_portability",
    "WITH RECURSIVE " + _SWAP + f""",
 bk AS (SELECT 'first' AS backbone, domain, unit, rn, truth, raw_baseline AS r, raw_candidate AS c FROM l0
   UNION ALL SELECT 'second', domain, unit, rn, truth, raw_candidate, raw_baseline FROM l0),
 bs AS (SELECT backbone, domain, unit, rn, least(greatest(r, 0e0), 1.3e0) AS b FROM bk WHERE rn = 1
   UNION ALL SELECT l.backbone, l.domain, l.unit, l.rn, least(greatest(s.b + {ALPHA}e0 * least(l.r - s.b, 0e0), 0e0), 1.3e0)
   FROM bs s JOIN bk l ON l.backbone = s.backbone AND l.domain = s.domain AND l.unit = s.unit AND l.rn = s.rn + 1),
 bg AS (SELECT backbone, domain, unit, truth, b, min(least(greatest(c, greatest(0e0, b - {BUDGET}e0)), least(1.3e0, b + {BUDGET}e0)))
    OVER (PARTITION BY backbone, domain, unit ORDER BY rn) AS p FROM bk JOIN bs USING (backbone, domain, unit, rn)),
 bd AS (SELECT backbone, domain, avg(s) AS s, avg(g) AS g FROM (SELECT backbone, domain, unit, avg(abs(b - truth)) AS s, avg(abs(p - truth)) AS g FROM bg GROUP BY ALL) GROUP BY ALL)
 SELECT backbone, round(avg(s), 9) AS state_mae, round(avg(g), 9) AS guard_mae, count(*) FILTER (g - s < -1e-12) AS wins,
   count(*) FILTER (abs(g - s) <= 1e-12) AS ties, count(*) FILTER (g - s > 1e-12) AS losses FROM bd GROUP BY backbone""",
)
def e10(spark, d):
    pairs = {"first": ("raw_baseline", "raw_candidate"), "second": ("raw_candidate", "raw_baseline")}
    return rounded(
        workflows.backbone_portability(trajectories(spark, d), pairs, alpha=ALPHA, budget=BUDGET)
    )


@query(
    "E11_global_alpha_freeze",
    with_grid(f""", fa AS (SELECT alpha, avg(mae) AS mae, count(*) AS domains FROM sc WHERE budget = {BUDGET}e0 GROUP BY ALL)
 SELECT alpha, round(mae, 9) AS mae, domains FROM fa WHERE mae <= (SELECT min(mae) FROM fa) + 1e-12 ORDER BY alpha DESC LIMIT 1"""),
)
def e11(spark, d):
    out = workflows.freeze_alpha(trajectories(spark, d), ALPHAS, BUDGET)
    return out.withColumn("mae", F.round("mae", 9))


@query(
    "E14_recomputation_audit",
    with_guarded(""" SELECT domain, CASE WHEN saved IS NULL THEN 'left_only' WHEN abs(mae - saved) <= 1e-9 THEN 'equal' ELSE 'different' END AS status, count(*) AS units
      FROM (SELECT domain, unit, avg(abs(guarded - truth)) AS mae, CASE WHEN count(*) < 10 THEN NULL WHEN count(*) % 3 = 0 THEN avg(abs(guarded - truth)) + 0.001e0 ELSE avg(abs(guarded - truth)) END AS saved FROM gd GROUP BY ALL) GROUP BY ALL"""),
)
def e14(spark, d):
    records = guarded(spark, d).frame
    error = F.avg(F.abs(F.col("guarded") - F.col("truth")))
    # A published table with some units missing and some edited.
    saved = records.groupBy("domain", "unit").agg(error.alias("mae"), F.count(F.lit(1)).alias("n"))
    edited = F.when(F.col("n") % 3 == 0, F.col("mae") + 0.001).otherwise(F.col("mae"))
    saved = saved.filter("n >= 10").select("domain", "unit", edited.alias("mae"))
    audit = workflows.recomputation_audit(records, saved, "guarded", tolerance=1e-9)
    return audit.groupBy("domain", "status").agg(F.count(F.lit(1)).alias("units"))


@query(
    "E15_monotonicity_ablation",
    with_guarded(f""", ar AS (SELECT gd.domain, gd.unit, gd.rn, guarded, rs.p AS recovered,
   least(greatest(raw_candidate, greatest(0e0, protected_state - {BUDGET}e0)), least(1.3e0, protected_state + {BUDGET}e0)) AS pointwise
  FROM gd JOIN rs USING (domain, unit, rn)),
 tl AS (UNPIVOT ar ON pointwise, guarded, recovered INTO NAME method VALUE v),
 mv AS (SELECT *, v - lag(v) OVER (PARTITION BY domain, unit, method ORDER BY rn) AS move FROM tl),
 u AS (SELECT domain, unit, method, count(*) FILTER (move > 1e-12) AS p, count(move) AS t, max(move) AS h FROM mv GROUP BY ALL)
 SELECT method, sum(p)::BIGINT AS positive_transitions, sum(t)::BIGINT AS total_transitions, round(sum(p) / sum(t), 9) AS positive_fraction,
   count(*) FILTER (p > 0) AS affected_units, round(greatest(max(h), 0e0), 9) AS maximum_increase, NULL::DOUBLE AS maximum_envelope_excess FROM u GROUP BY method""",
        recovery_sql("0.002e0")),
)
def e15(spark, d):
    arms = workflows.monotonicity_arms(
        trajectories(spark, d), alpha=ALPHA, budget=BUDGET, allowance=0.002
    )
    return rounded(metrics.transition_metrics(arms, ["pointwise", "guarded", "recovered"]))


@query(
    "E16_robustness",
    with_metrics(_B5 + """, z AS (SELECT domain, count(*) AS units, sum(records)::BIGINT AS records FROM um WHERE method = 'guarded' GROUP BY domain),
 s AS (SELECT contrast_id, avg(difference) AS mean_difference, min(l) AS lo, max(l) AS hi, quantile_cont(difference, 0.5) AS med,
   arg_max(l, (units, records, domain)) AS wu, arg_max(l, (records, units, domain)) AS wr,
   count(*) FILTER (difference < -1e-12) AS wins, count(*) FILTER (abs(difference) <= 1e-12) AS ties, count(*) FILTER (difference > 1e-12) AS losses
   FROM (SELECT ix.*, units, records, (sum(difference) OVER (PARTITION BY contrast_id) - difference) / (n - 1) AS l FROM ix JOIN z USING (domain)) GROUP BY ALL)
 SELECT contrast_id, round(mean_difference, 9) AS mean_difference, round(lo, 9) AS leave_one_out_low, round(hi, 9) AS leave_one_out_high,
   round(wu, 9) AS without_most_units, round(wr, 9) AS without_most_records,
   round(med, 9) AS median_difference, wins, ties, losses, assignments, sign_flip_p,
   CASE WHEN mean_difference >= 0 THEN 'CONTRADICTED' WHEN hi < 0 AND wu < 0 AND wr < 0 AND sign_flip_p <= 0.05 THEN 'ROBUST' ELSE 'QUALIFIED' END AS robustness
 FROM s JOIN sf USING (contrast_id)""", _UNITS),
)
def e16(spark, d):
    sizes = ledger(spark, d).groupBy("domain", "unit").count().groupBy("domain").agg(
        F.count(F.lit(1)).alias("units"), F.sum("count").alias("records")
    )
    contrasts = unit_contrasts(spark, d).groupBy("contrast_id", "domain").agg(F.avg("difference").alias("difference"))
    out = workflows.robustness(contrasts.join(sizes, "domain"))
    names = (
        "mean_difference", "leave_one_out_low", "leave_one_out_high", "median_difference",
        "without_most_units", "without_most_records",
    )
    return out.withColumns({c: F.round(c, 9) for c in names})


@query(
    "E18_arms_through_guard",
    with_guarded(f""", a AS (SELECT domain, unit, rn, truth,
   min(least(greatest(raw_candidate, greatest(0e0, protected_state - {BUDGET}e0)), least(1.3e0, protected_state + {BUDGET}e0))) OVER w AS guard_change,
   min(least(greatest(raw_baseline, greatest(0e0, protected_state - {BUDGET}e0)), least(1.3e0, protected_state + {BUDGET}e0))) OVER w AS guard_raw
  FROM gd WINDOW w AS (PARTITION BY domain, unit ORDER BY rn)),
 u AS (SELECT domain, unit, avg(abs(guard_change - truth)) AS c, avg(abs(guard_raw - truth)) AS r FROM a GROUP BY ALL)
 SELECT domain, 'guard_change' AS method, round(avg(c), 9) AS unit_macro_mae FROM u GROUP BY domain
 UNION ALL SELECT domain, 'guard_raw', round(avg(r), 9) FROM u GROUP BY domain"""),
)
def e18(spark, d):
    arms = {"change": "raw_candidate", "raw": "raw_baseline"}
    return rounded(
        workflows.arms_through_guard(trajectories(spark, d), arms, alpha=ALPHA, budget=BUDGET)
    )


