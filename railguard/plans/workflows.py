"""Evaluation workflows: the compositions users call.

Each is one declarative query over the ledger.  Parameter grids stay in arrays or
columns until the per-unit result, and selections are small tables joined back.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from railguard.functions.columns import TOLERANCE, Y_MAX, Y_MIN, clip, is_finite, regret_cap
from railguard.operators import inference, metrics
from railguard.operators.folds import GuardGridFold, RecoveryGridFold, StateGridFold, grid_unit_errors
from railguard.operators.guard import causal_state, guard, pointwise_tube, project, recover, state_grid
from railguard.operators.isotonic import monotone_projection
from railguard.operators.joins import compare_tables
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.ordering import with_rank
from railguard.operators.reshape import top_one
from railguard.plans import nested
from railguard.session import durable
from railguard.operators.selection import argmin_with_ties, excluded_pairs, grid_scores, nested_selection


def budget_frontier(
    df: DataFrame, state: str, candidate: str, budgets: list[float], truth: str = "truth",
    keys: Keys = Keys(),
) -> DataFrame:
    """Record-wise capped arm for several budgets: accuracy, harm and displacement.

    Budgets are columns of one per-unit aggregate and become rows only afterwards.
    """
    base = F.abs(F.col(state) - F.col(truth))
    aggs = []
    for i, budget in enumerate(budgets):
        capped = regret_cap(state, candidate, budget)
        error = F.abs(capped - F.col(truth))
        aggs += [
            F.avg(error).alias(f"m{i}"),
            (F.avg(error) - F.avg(base)).alias(f"g{i}"),
            F.max(F.abs(capped - F.col(state))).alias(f"d{i}"),
        ]
    units = df.groupBy(*keys.group).agg(*aggs)
    rows = [
        F.struct(
            F.lit(float(b)).alias("budget"), F.col(f"m{i}").alias("mae"),
            F.col(f"g{i}").alias("gap"), F.col(f"d{i}").alias("moved"),
        )
        for i, b in enumerate(budgets)
    ]
    long = units.select(*keys.group, F.inline(F.array(*rows)))
    domains = long.groupBy("budget", keys.domain).agg(
        F.avg("mae").alias("mae"), F.max("gap").alias("unit_gap"), F.avg("gap").alias("gap"),
        F.max("moved").alias("moved"),
    )
    return domains.groupBy("budget").agg(
        F.avg("mae").alias("domain_equal_mae"),
        F.max("unit_gap").alias("maximum_unit_harm"),
        F.max("gap").alias("maximum_domain_harm"),
        F.max("moved").alias("maximum_displacement"),
    )


def double_holdout(df: DataFrame, truth: str = "truth", candidate: str = "raw_candidate",
                   keys: Keys = Keys()) -> DataFrame:
    """Predictions for every pair of excluded domains, calibrated on the other domains only.

    The calibration is the domain-equal mean residual of the source domains, so it needs
    one row per domain.  Output rows carry ``outer_domain`` and ``inner_domain`` (the
    record's own domain) plus the recalibrated candidate.
    """
    levels = df.groupBy(keys.domain).agg(
        F.avg(F.col(truth) - F.col(candidate)).alias("level")
    )
    # Domains are a short declared list: one row carries all their levels as a map.
    packed = levels.agg(
        F.map_from_entries(F.collect_list(F.struct(keys.domain, "level"))).alias("level"),
        F.sum("level").alias("total"), F.count(F.lit(1)).alias("n"),
    )
    names = F.map_keys("level")
    pairs = packed.select("*", F.explode(names).alias("outer_domain")).select(
        "*", F.explode(names).alias("inner_domain")
    ).filter(F.col("outer_domain") != F.col("inner_domain"))
    rest = (
        F.col("total") - F.element_at("level", F.col("outer_domain"))
        - F.element_at("level", F.col("inner_domain"))
    )
    shifts = pairs.select("outer_domain", "inner_domain", (rest / (F.col("n") - 2)).alias("shift"))
    renamed = df.withColumnRenamed(keys.domain, "inner_domain")
    return renamed.join(F.broadcast(shifts), "inner_domain").withColumn(
        candidate, F.col(candidate) + F.col("shift")
    ).drop("shift")


def pair_trajectories(t: Trajectories, pairs: DataFrame) -> Trajectories:
    """Trajectories whose domain is the (outer, inner) fold."""
    fold = F.concat_ws(">", "outer_domain", "inner_domain")
    keys = replace(t.keys, domain="fold")
    return Trajectories(pairs.withColumn("fold", fold), keys, t.longest, t.cut)


def _outer_inner(scores: DataFrame) -> DataFrame:
    parts = F.split("fold", ">")
    return scores.withColumn("outer_domain", parts[0]).withColumn("inner_domain", parts[1]).drop("fold")


def nested_alpha_scores(t: Trajectories, alphas: list[float], budget: float,
                        truth: str = "truth") -> DataFrame:
    """Inner validation scores of every alpha for every (outer, inner) pair, in one pass."""
    folds = pair_trajectories(t, double_holdout(t.frame, truth, keys=t.keys))
    grid = GuardGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"), alphas=tuple(alphas),
        budgets=(budget,),
    )
    units = grid_unit_errors(folds, grid, truth)
    return _outer_inner(grid_scores(units, folds.keys, [{"alpha": a} for a in alphas]))


def select_alpha(scores: DataFrame) -> DataFrame:
    """Nested source-only choice: smallest mean inner error, ties to the larger alpha."""
    return nested_selection(scores, ["alpha"], [F.desc("alpha")])


def apply_selected_alpha(t: Trajectories, selected: DataFrame, alphas: list[float], budget: float):
    """Guard every outer domain with its own selected alpha.

    The state for all alphas comes from one pass; each record keeps the entry of its
    domain's choice, so no per-domain job is needed.
    """
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    # One row per domain, joined by key; small by construction.
    choice = selected.select(
        F.col("outer_domain").alias(t.keys.domain), F.col("alpha").alias("selected_alpha")
    )
    states = state_grid(t, alphas)
    frame = states.frame.join(F.broadcast(choice), t.keys.domain)
    at = F.array_position(grid, F.col("selected_alpha")).cast("int")
    frame = frame.withColumn("protected_state", F.element_at("states", at)).drop("states")
    return project(states.with_frame(frame), budget=budget)


def shift_control_scores(t: Trajectories, alphas: list[float], offsets: list[float],
                         truth: str = "truth") -> DataFrame:
    """Candidate-free control: unit-macro error of clip(state + offset) on the whole grid."""
    fold = StateGridFold(inputs=("raw_baseline",), state=("b",), alphas=tuple(alphas))
    units = grid_unit_errors(t, fold, truth, tuple(offsets))
    points = [{"alpha": a, "offset": o} for a in alphas for o in offsets]
    return grid_scores(units, t.keys, points)


def leave_one_out_scores(scores: DataFrame, params: list[str], domain: str = "domain",
                         score: str = "mae") -> DataFrame:
    """(outer, inner) rows from per-domain scores when predictions do not depend on the pair."""
    pairs = excluded_pairs(scores, domain)
    return scores.withColumnRenamed(domain, "inner_domain").join(F.broadcast(pairs), "inner_domain").select(
        "outer_domain", "inner_domain", *params, score
    )


def select_shift_control(scores: DataFrame) -> DataFrame:
    inner = leave_one_out_scores(scores, ["alpha", "offset"])
    order = [F.asc(F.abs("offset")), F.desc("alpha"), F.desc("offset")]
    return nested_selection(inner, ["alpha", "offset"], order)


def budget_path(t: Trajectories, alphas: list[float], budgets: list[float],
                truth: str = "truth") -> DataFrame:
    """Per domain and budget: guard and exact-shift control, both chosen without the domain.

    The guard grid is one pass.  The control's offset is the weighted median residual of
    the inner domains, clipped to the budget.
    """
    keys = t.keys
    grid = GuardGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"), alphas=tuple(alphas),
        budgets=tuple(budgets),
    )
    points = [{"alpha": a, "budget": b} for a in alphas for b in budgets]
    scores = grid_scores(grid_unit_errors(t, grid, truth), keys, points)
    inner = leave_one_out_scores(scores, ["alpha", "budget"], keys.domain)
    means = inner.groupBy("outer_domain", "budget", "alpha").agg(F.avg("mae").alias("mae"))
    chosen = argmin_with_ties(means, ["outer_domain", "budget"], "mae", [F.desc("alpha")])
    guard_rows = chosen.select(
        F.col("outer_domain").alias(keys.domain), "budget", F.col("alpha").alias("guard_alpha")
    ).join(
        scores.select(keys.domain, "budget", F.col("alpha").alias("guard_alpha"), F.col("mae").alias("guard_mae")),
        [keys.domain, "budget", "guard_alpha"],
    )
    control = _exact_shift_control(t, alphas, budgets, truth)
    return guard_rows.join(control, [keys.domain, "budget"]).withColumn(
        "difference", F.col("guard_mae") - F.col("control_mae")
    )


def _exact_shift_control(t, alphas, budgets, truth) -> DataFrame:
    keys = t.keys
    weighted = metrics.row_weights(t.frame.select(*t.part, *keys.order, truth, "raw_baseline"), keys)
    # Several rounds below read the states; the ordered pass behind them runs once.
    states = durable(
        state_grid(t.with_frame(weighted), alphas).frame.select(*keys.group, truth, "weight", "states")
    )
    grid = F.array(*[F.lit(float(a)) for a in alphas])
    # Domains are a short declared list. One state per alpha serves all outer domains, so records
    # are not multiplied by them.
    names = tuple(sorted(r[0] for r in states.select(keys.domain).distinct().collect()))
    table = nested.shift_scores(
        nested.Pairs(t, names), states.filter(is_finite(truth)), alphas, budgets, truth
    )
    ordered = sorted(range(len(budgets)), key=lambda i: budgets[i])
    order = [F.asc(F.abs("offset")), F.desc("alpha"), F.desc("offset")]
    # The control takes the exact minimum: only equal scores are ties.
    chosen = top_one(table, ["outer_domain", "budget"], [F.asc("score"), *order])
    picks = chosen.select(
        F.col("outer_domain").alias(keys.domain), "budget", "alpha", F.col("offset").alias("control_offset")
    )
    plan = picks.groupBy(keys.domain).agg(
        F.array_sort(F.collect_list(F.struct("budget", "alpha", "control_offset"))).alias("plan")
    )
    outer = states.select(*keys.group, truth, "states").join(F.broadcast(plan), keys.domain)
    at = lambda i: F.get("plan", F.lit(i))
    aggs = []
    for i in range(len(budgets)):
        state = F.element_at("states", F.array_position(grid, at(i)["alpha"]).cast("int"))
        output = clip(state + at(i)["control_offset"], Y_MIN, Y_MAX)
        aggs.append(F.avg(F.abs(output - F.col(truth))).alias(f"u{i}"))
    units = outer.groupBy(*keys.group).agg(*aggs)
    domains = units.groupBy(keys.domain).agg(*[F.avg(f"u{i}").alias(f"u{i}") for i in range(len(budgets))])
    out = [
        F.struct(F.lit(float(budgets[j])).alias("budget"), F.col(f"u{i}").alias("control_mae"))
        for i, j in enumerate(ordered)
    ]
    return domains.select(keys.domain, F.inline(F.array(*out))).join(
        picks.select(keys.domain, "budget", F.col("alpha").alias("control_alpha"), "control_offset"),
        [keys.domain, "budget"],
    )


def recovery_selection(t: Trajectories, configurations: list[tuple[float, float]], budget: float,
                       truth: str = "truth") -> DataFrame:
    """Per outer domain: best (alpha, allowance), and best with no recovery."""
    fold = RecoveryGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"),
        alphas=tuple(a for a, _ in configurations), allowances=tuple(r for _, r in configurations),
        budget=budget,
    )
    points = [{"alpha": a, "recovery": r} for a, r in configurations]
    scores = grid_scores(grid_unit_errors(t, fold, truth), t.keys, points)
    inner = leave_one_out_scores(scores, ["alpha", "recovery"], t.keys.domain)
    order = [F.asc("recovery"), F.desc("alpha")]
    best = nested_selection(inner, ["alpha", "recovery"], order)
    strict = nested_selection(inner.filter("recovery = 0"), ["alpha", "recovery"], order)
    return best.join(
        strict.select("outer_domain", F.col("alpha").alias("strict_alpha"), F.col("mae").alias("strict_mae")),
        "outer_domain",
    )


def freeze_alpha(t: Trajectories, alphas: list[float], budget: float, truth: str = "truth") -> DataFrame:
    """Global choice over all domains: domain-equal error of every alpha, then the argmin."""
    grid = GuardGridFold(
        inputs=("raw_baseline", "raw_candidate"), state=("b", "p"), alphas=tuple(alphas),
        budgets=(budget,),
    )
    scores = grid_scores(grid_unit_errors(t, grid, truth), t.keys, [{"alpha": a} for a in alphas])
    means = scores.groupBy("alpha").agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("domains"))
    ranked = means.withColumn("_all", F.lit("all"))
    return argmin_with_ties(ranked, ["_all"], "mae", [F.desc("alpha")]).drop("_all")


CERTIFICATES = {
    "displacement_held", "regret_held", "state_non_increasing", "output_non_increasing",
    "range_held", "prefix_replay_exact",
}


def mechanism_decision(
    t: Trajectories, *, alpha: float, budget: float, shift: float, minimum_wins: int,
    truth: str = "truth", reps: int = 100_000, seed: int = 17,
) -> DataFrame:
    """One-row decision: contrast against the fixed shift, certificates, nine gates, verdict.

    Three gates are findings (negative mean, negative upper end of the two-stage bootstrap,
    enough domains improved); six are certificates, of which none may fail.
    """
    from railguard.operators.audits import prefix_replay
    from railguard.operators.selection import decision_verdict

    raw = [*t.part, *t.keys.order, "raw_baseline", "raw_candidate"]
    done = guard(with_rank(t.with_frame(t.frame.select(*raw, truth))), alpha=alpha, budget=budget)
    # Certificates, units and replay read the full run; the ordered pass behind it runs once.
    frame = durable(
        done.frame.withColumn("fixed_shift", clip(F.col("protected_state") + shift, Y_MIN, Y_MAX))
    )
    done = done.with_frame(frame)
    cert = metrics.certificate(done, "protected_state", "guarded", truth, budget)
    state = metrics.certificate(done, "protected_state", "protected_state", truth, budget)
    error = lambda c: F.avg(F.abs(F.col(c) - F.col(truth)))
    units = durable(
        frame.groupBy(*t.keys.group).agg((error("guarded") - error("fixed_shift")).alias("difference")).select(
            F.lit("guarded-fixed_shift").alias("contrast_id"),
            F.col(t.keys.domain).alias("domain"),
            F.col(t.keys.unit).alias("unit"),
            "difference",
        )
    )
    domains = units.groupBy("domain").agg(F.avg("difference").alias("difference"))
    merged = cert
    for row in (
        state.select(F.col("maximum_increase").alias("maximum_state_increase")),
        prefix_replay(
            t.with_frame(frame.select(*raw, "rank")), alpha=alpha, budget=budget, full=frame
        ).select(F.col("maximum_difference").alias("replay_difference")),
        inference.two_stage_bootstrap(units, reps, seed).select("low", "high"),
        domains.agg(
            F.avg("difference").alias("minus_fixed_shift"),
            F.count_if(F.col("difference") < -TOLERANCE).alias("wins"),
        ),
    ):
        merged = merged.unionByName(row, allowMissingColumns=True)
    one = merged.agg(*[F.max(c).alias(c) for c in merged.columns])
    gates = {
        "mean_below_zero": F.col("minus_fixed_shift") < 0,
        "interval_below_zero": F.col("high") < 0,
        "enough_domains_improved": F.col("wins") >= minimum_wins,
        "displacement_held": F.col("maximum_displacement") <= budget + TOLERANCE,
        "regret_held": F.col("maximum_regret") <= budget + TOLERANCE,
        "state_non_increasing": F.col("maximum_state_increase") <= TOLERANCE,
        "output_non_increasing": F.col("maximum_increase") <= TOLERANCE,
        "range_held": (F.col("minimum_output") >= Y_MIN - TOLERANCE) & (F.col("maximum_output") <= Y_MAX + TOLERANCE),
        "prefix_replay_exact": F.col("replay_difference") == 0,
    }
    return one.select("*", *decision_verdict(gates, CERTIFICATES))


def offline_frontier(t: Trajectories, budgets: list[float], truth: str = "truth") -> DataFrame:
    """Retrospective arm: offline monotone fits of both predictions, capped per budget."""
    base = monotone_projection(t, "raw_baseline", "offline_state")
    both = monotone_projection(t.with_frame(base), "raw_candidate", "offline_candidate")
    return budget_frontier(both, "offline_state", "offline_candidate", budgets, truth, t.keys)


def component_attribution(domains: DataFrame, full: str, ablated: list[str], keys: Keys = Keys()) -> DataFrame:
    """Loss of each ablated variant against the full method, per variant over domains."""
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("unit_macro_mae")))
    wide = domains.groupBy(keys.domain).agg(pick(full).alias("_full"), *[pick(a).alias(a) for a in ablated])
    rows = [
        F.struct(F.lit(a).alias("variant"), (F.col(a) - F.col("_full")).alias("difference"))
        for a in ablated
    ]
    long = wide.select(keys.domain, F.inline(F.array(*rows)))
    return metrics.contrast_summary(long, ["variant"])


def monotonicity_arms(t: Trajectories, *, alpha: float, budget: float, allowance: float) -> Trajectories:
    """Pointwise tube, strict guard and bounded recovery side by side."""
    strict = guard(t, alpha=alpha, budget=budget)
    strict = strict.with_frame(
        strict.frame.withColumn("pointwise", pointwise_tube("protected_state", "raw_candidate", budget))
    )
    return recover(strict, alpha=alpha, budget=budget, allowance=allowance)


def backbone_portability(
    t: Trajectories, backbones: dict[str, tuple[str, str]], *, alpha: float, budget: float,
    truth: str = "truth",
) -> DataFrame:
    """The same guard on several (baseline, candidate) pairs: state and guard error per backbone.

    Backbones become part of the domain key, so one job guards all of them side by side.
    """
    pairs = [
        F.struct(F.lit(n).alias("backbone"), F.col(b).alias("raw_baseline_"), F.col(c).alias("raw_candidate_"))
        for n, (b, c) in backbones.items()
    ]
    long = t.frame.withColumn("_p", F.explode(F.array(*pairs))).select(
        *t.keys.record, truth, *[c for c in t.part if c not in t.keys.group],
        F.col("_p.backbone").alias("backbone"), F.col("_p.raw_baseline_").alias("raw_baseline"),
        F.col("_p.raw_candidate_").alias("raw_candidate"),
    ).withColumn("fold", F.concat_ws(">", "backbone", t.keys.domain))
    runs = Trajectories(long, replace(t.keys, domain="fold"), t.longest, t.cut)
    done = guard(runs, alpha=alpha, budget=budget).frame
    units = done.groupBy("backbone", *t.keys.group).agg(
        F.avg(F.abs(F.col("protected_state") - F.col(truth))).alias("state"),
        F.avg(F.abs(F.col("guarded") - F.col(truth))).alias("guard"),
    )
    domains = units.groupBy("backbone", t.keys.domain).agg(
        F.avg("state").alias("state"), F.avg("guard").alias("guard")
    )
    return domains.groupBy("backbone").agg(
        F.avg("state").alias("state_mae"), F.avg("guard").alias("guard_mae"),
        *metrics.win_tie_loss(F.col("guard") - F.col("state")),
    )


def recomputation_audit(
    records: DataFrame, saved: DataFrame, method: str, truth: str = "truth", keys: Keys = Keys(),
    tolerance: float = 1e-12,
) -> DataFrame:
    """Rebuild unit errors from the ledger and compare with a saved table, key by key."""
    error = F.avg(F.abs(F.col(method) - F.col(truth)))
    fresh = records.groupBy(*keys.group).agg(error.alias("mae"))
    return compare_tables(fresh, saved, keys.group, ["mae"], tolerance)


def robustness(contrasts: DataFrame) -> DataFrame:
    """Per contrast: mean, leave-one-out range, sensitivity to the largest domains, exact sign
    flip, wins/ties/losses and class.

    ``contrasts``: contrast_id, domain, difference, units, records.
    """
    from railguard.operators.selection import robustness_class

    n, total = F.count(F.lit(1)), F.sum("difference")
    without = lambda *order: (total - F.max_by("difference", F.struct(*order, "domain"))) / (n - 1)
    spread = contrasts.groupBy("contrast_id").agg(
        F.avg("difference").alias("mean_difference"),
        ((total - F.max("difference")) / (n - 1)).alias("leave_one_out_low"),
        ((total - F.min("difference")) / (n - 1)).alias("leave_one_out_high"),
        without("units", "records").alias("without_most_units"),
        without("records", "units").alias("without_most_records"),
        F.percentile("difference", 0.5).alias("median_difference"),
        *metrics.win_tie_loss(),
    )
    judged = robustness_class(
        F.col("mean_difference"), F.col("leave_one_out_high"), F.col("without_most_units"),
        F.col("without_most_records"), F.col("sign_flip_p"),
    )
    return spread.join(inference.sign_flip(contrasts), "contrast_id").withColumn("robustness", judged)


def arms_through_guard(
    t: Trajectories, arms: dict[str, str], *, alpha: float, budget: float, truth: str = "truth"
) -> DataFrame:
    """Each arm's prediction as candidate of the same guard; unit-macro error per domain and arm."""
    done = causal_state(t, alpha=alpha)
    for name, column in arms.items():
        done = project(done, candidate=column, out=f"guard_{name}", budget=budget)
    units = metrics.unit_errors(done.frame, [f"guard_{a}" for a in arms], truth, t.keys)
    return units.groupBy(t.keys.domain, "method").agg(F.avg("mae").alias("unit_macro_mae"))


def pairwise_effects(
    domains: DataFrame, pairs: list[tuple[str, str]], reps: int, seed: int, keys: Keys = Keys()
) -> DataFrame:
    """Every (method, reference) pair: domain-equal difference, median, bootstrap interval,
    exact sign-flip p-value and wins, ties and losses.

    ``domains``: domain, method, unit_macro_mae; all pairs are contrasts of one job.
    """
    picked = lambda m: F.max(F.when(F.col("method") == m, F.col("unit_macro_mae")))
    methods = list(dict.fromkeys(m for pair in pairs for m in pair))
    wide = domains.groupBy(keys.domain).agg(*[picked(m).alias(m) for m in methods])
    rows = [
        F.struct(F.lit(f"{a}-{b}").alias("contrast_id"), (F.col(a) - F.col(b)).alias("difference")) for a, b in pairs
    ]
    contrasts = durable(wide.select(F.col(keys.domain).alias("domain"), F.inline(F.array(*rows))))
    median = contrasts.groupBy("contrast_id").agg(F.percentile("difference", 0.5).alias("median_difference"))
    return (
        metrics.contrast_summary(contrasts, ["contrast_id"])
        .join(median, "contrast_id")
        .join(inference.cluster_bootstrap(contrasts, reps, seed).select("contrast_id", "low", "high"), "contrast_id")
        .join(inference.sign_flip(contrasts), "contrast_id")
    )
