"""Audits that rerun the guard under a changed input and compare with the full run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from railguard.operators.guard import causal_state, guard
from railguard.operators.isotonic import monotone_projection
from railguard.operators.layout import Trajectories
from railguard.operators.ordering import prefix_part, with_rank, with_running, with_unit_rows


def prefix_replay(
    t: Trajectories, *, alpha: float, budget: float, full: DataFrame | None = None
) -> DataFrame:
    """Run on the first half of each unit and compare with the full run (must be 0).

    A full run at hand, with the ``rank`` of its records, may be given as ``full``; ``t`` then has
    the rank too.
    """
    ranked = with_rank(t) if full is None else t
    if full is None:
        full = guard(ranked, alpha=alpha, budget=budget).frame
    half = guard(prefix_part(ranked), alpha=alpha, budget=budget).frame
    keys = [*t.keys.group, "rank"]
    pairs = half.select(
        *keys, F.col("protected_state").alias("b1"), F.col("guarded").alias("p1")
    ).join(full.select(*keys, "protected_state", "guarded"), keys)
    gap = F.greatest(
        F.abs(F.col("b1") - F.col("protected_state")), F.abs(F.col("p1") - F.col("guarded"))
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("replayed_records"), F.max(gap).alias("maximum_difference")
    )


def future_revision(
    t: Trajectories, value: str, *, alpha: float, budget: float,
    fractions: tuple[float, ...] = (0.25, 0.5, 0.75), tolerance: float = 1e-4,
) -> DataFrame:
    """Share of units whose published history changes once later records arrive.

    Compares the offline monotone fit with the causal guard on growing prefixes.
    """
    ranked = with_rank(t)
    keys = [*t.keys.group, "rank"]

    def both(part: Trajectories) -> DataFrame:
        causal = guard(part, alpha=alpha, budget=budget)
        return monotone_projection(causal, value).select(*keys, "guarded", "isotonic")

    full = both(ranked).toDF(*keys, "full_causal", "full_offline")
    arms = []
    for fraction in fractions:
        early = both(prefix_part(ranked, fraction)).join(full, keys)
        units = early.groupBy(*t.keys.group).agg(
            F.max(F.abs(F.col("guarded") - F.col("full_causal"))).alias("causal"),
            F.max(F.abs(F.col("isotonic") - F.col("full_offline"))).alias("offline"),
        )
        arms.append(
            units.groupBy(t.keys.domain).agg(
                F.count(F.lit(1)).alias("units"),
                F.avg((F.col("causal") > tolerance).cast("double")).alias("causal_revised"),
                F.avg((F.col("offline") > tolerance).cast("double")).alias("offline_revised"),
            ).withColumn("prefix_fraction", F.lit(fraction))
        )
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def shock_response(
    t: Trajectories, raw: str, *, alphas: tuple[float, ...], shock: float = 0.05,
    places: tuple[float, ...] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Cumulative disturbance of the state after one shocked record, per alpha and sign."""
    sized = with_unit_rows(with_rank(t), "_n")
    scenarios = F.array(
        *[
            F.struct(F.lit(p).alias("place"), F.lit(s * shock).alias("shock"))
            for p in places
            for s in (-1.0, 1.0)
        ]
    )
    # Scenarios become part of the unit key: one job runs all of them side by side.
    frame = sized.frame.withColumn("_s", F.explode(scenarios)).select(
        "*", F.col("_s.place").alias("place"), F.col("_s.shock").alias("shock")
    ).drop("_s")
    at = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("place")))
    frame = frame.withColumn(
        "_shocked", F.when(F.col("rank") == at, F.col(raw) + F.col("shock")).otherwise(F.col(raw))
    ).withColumn(
        "_scenario", F.concat_ws("|", F.col(t.keys.unit).cast("string"), "place", "shock")
    )
    keys = type(t.keys)(domain=t.keys.domain, unit="_scenario", order=t.keys.order)
    runs = Trajectories(frame, keys, t.longest, t.cut)
    arms = []
    for alpha in alphas:
        calm = causal_state(runs, raw, "_calm", alpha=alpha)
        both = causal_state(calm, "_shocked", "_hit", alpha=alpha).frame
        arms.append(
            both.groupBy(t.keys.domain, "place", "shock").agg(
                F.count_if(F.col("rank") == at).alias("shocks"),
                F.sum(F.abs(F.col("_hit") - F.col("_calm"))).alias("cumulative_disturbance"),
            ).withColumn("alpha", F.lit(alpha))
        )
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def cap_sensitivity(
    t: Trajectories, caps: list[float], *, alpha: float, budget: float, reference: float = 1.3,
    truth: str = "truth",
) -> DataFrame:
    """Guard replayed under several upper range ends; records whose output changes."""
    keys = t.keys.record
    base = guard(t, alpha=alpha, budget=budget, y_max=reference, out="base").frame
    arms = []
    for cap in caps:
        run = guard(t, alpha=alpha, budget=budget, y_max=cap).frame
        joined = run.join(base.select(*keys, "base"), keys)
        units = joined.groupBy(*t.keys.group).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("guarded") != F.col("base")).alias("changed"),
            F.max(F.abs(F.col("guarded") - F.col("base"))).alias("gap"),
            F.avg(F.abs(F.col("guarded") - F.col(truth))).alias("mae"),
        )
        arms.append(
            units.groupBy(t.keys.domain).agg(
                F.sum("n").alias("records"),
                F.sum("changed").alias("changed_records"),
                F.max("gap").alias("maximum_change"),
                F.avg("mae").alias("unit_macro_mae"),
            ).withColumn("cap", F.lit(cap))
        )
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def nonexpansive_check(
    t: Trajectories, noise: Column, *, alpha: float, budget: float, tolerance: float = 1e-12
) -> DataFrame:
    """Perturb both inputs and check that outputs move no more than the inputs so far.

    ``noise`` is the perturbation of the raw baseline; the candidate gets its negative.
    """
    first = guard(t, alpha=alpha, budget=budget)
    shifted = first.with_frame(
        first.frame.withColumn("_raw2", F.col("raw_baseline") + noise).withColumn(
            "_cand2", F.col("raw_candidate") - noise
        )
    )
    second = guard(shifted, "_raw2", "_cand2", alpha=alpha, budget=budget,
                   state="_state2", out="_out2")
    gap_in = F.greatest(
        F.abs(F.col("_raw2") - F.col("raw_baseline")),
        F.abs(F.col("_cand2") - F.col("raw_candidate")),
    )
    gap_out = F.greatest(
        F.abs(F.col("_state2") - F.col("protected_state")),
        F.abs(F.col("_out2") - F.col("guarded")),
    )
    run = with_running(second, {"_in": ("max", gap_in), "_out": ("max", gap_out)})
    return run.frame.groupBy(t.keys.domain).agg(
        F.count(F.lit(1)).alias("records"),
        F.max("_in").alias("maximum_input_change"),
        F.max("_out").alias("maximum_output_change"),
        F.bool_and(F.col("_out") <= F.col("_in") + tolerance).alias("nonexpansive"),
    )
