"""Window operators (W1-W16), predicates and projections (P1-P11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import (
    BUDGET,
    guarded,
    ledger,
    query,
    table,
    trajectories,
    with_guarded,
    with_ledger,
)
from railguard.functions.columns import clip, log_order
from railguard.operators import ordering
from railguard.operators.flow import active_stage, eligibility
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.reshape import remap

KEYS = ["domain", "unit", "ordinal"]

# Events of one user in time order act as an instrument log: seconds, current, voltage.
LOG_KEYS = Keys(domain="domain", unit="unit", order=("position",))
LOG_SQL = """
lg AS (
  SELECT 'log' AS domain, user_id AS unit, event_id AS position, event_type AS kind,
         (epoch_us(ts) - 1704067200000000) % 3600000000 / 1000000e0 AS seconds,
         value / 100e0 - 0.2e0 AS current, 3e0 + value / 1000e0 AS voltage
  FROM events
)"""


def log_trajectories(spark, d) -> Trajectories:
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    frame = table(spark, d, "events").select(
        F.lit("log").alias("domain"),
        F.col("user_id").alias("unit"),
        F.col("event_id").alias("position"),
        F.col("event_type").alias("kind"),
        (micros % 3600000000 / F.lit(1000000.0)).alias("seconds"),
        (F.col("value") / 100.0 - 0.2).alias("current"),
        (3.0 + F.col("value") / 1000.0).alias("voltage"),
    )
    return Trajectories.plan(frame, LOG_KEYS)


@query(
    "W1_rank_and_scored_flag",
    with_ledger(" SELECT domain, unit, ordinal, rn AS rank, rn > 5 AS scored FROM led"),
)
def w1(spark, d):
    f = ordering.with_rank(trajectories(spark, d)).frame
    return f.select(*KEYS, "rank", (F.col("rank") > 5).alias("scored"))


@query(
    "W2_rank_over_valid",
    with_ledger(""" SELECT domain, unit, ordinal,
      row_number() OVER (PARTITION BY domain, unit ORDER BY order_key, ordinal) AS valid_rank
      FROM led WHERE raw_candidate > 0.85e0"""),
)
def w2(spark, d):
    t = trajectories(spark, d)
    valid = t.with_frame(t.frame.filter("raw_candidate > 0.85"))
    return ordering.with_rank(valid, "valid_rank").frame.select(*KEYS, "valid_rank")


@query(
    "W3_within_key_ordinal",
    """SELECT l_orderkey, l_partkey, within_key_ordinal, printf('EXT-%05d', within_key_ordinal) AS record_id
    FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS within_key_ordinal FROM lineitem)""",
)
def w3(spark, d):
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    f = table(spark, d, "lineitem").select(F.lit("lineitem").alias("source"), "l_orderkey", *order)
    t = Trajectories.plan(f, Keys(domain="source", unit="l_orderkey", order=order))
    out = ordering.with_occurrence_id(t).frame
    return out.select("l_orderkey", "l_partkey", "within_key_ordinal", "record_id")


@query(
    "W4_first_records_median",
    with_ledger(""" SELECT domain, unit, round(quantile_cont(raw_baseline, 0.5), 9) AS reference_raw_baseline,
      round(quantile_cont(truth, 0.5), 9) AS reference_truth FROM led WHERE rn <= 5 GROUP BY ALL"""),
)
def w4(spark, d):
    f = ordering.first_records_median(ledger(spark, d), Keys(), ["raw_baseline", "truth"])
    return f.select("domain", "unit", *[F.round(c, 9).alias(c) for c in f.columns[2:]])


@query(
    "W5_step_difference",
    with_guarded(""" SELECT * FROM (SELECT domain, unit, ordinal,
      guarded - lag(guarded) OVER (PARTITION BY domain, unit ORDER BY rn) AS step FROM gd)
      WHERE step IS NOT NULL"""),
)
def w5(spark, d):
    f = ordering.with_previous(guarded(spark, d), {"before": "guarded"}).frame
    return f.filter("before IS NOT NULL").select(
        *KEYS, (F.col("guarded") - F.col("before")).alias("step")
    )


@query(
    "W6_monotone_verdict",
    with_guarded(""", x AS (SELECT *, raw_candidate - lag(raw_candidate) OVER w AS rc, guarded - lag(guarded) OVER w AS rg
      FROM gd WINDOW w AS (PARTITION BY domain, unit ORDER BY rn))
 SELECT domain, unit, round(coalesce(max(greatest(rc, 0e0)), 0e0), 12) AS candidate_increase,
   coalesce(max(greatest(rg, 0e0)), 0e0) AS guarded_increase,
   coalesce(bool_and(rc <= 1e-12), true) AS candidate_monotone,
   coalesce(bool_and(rg <= 1e-12), true) AS guarded_monotone FROM x GROUP BY ALL"""),
)
def w6(spark, d):
    t = ordering.with_previous(guarded(spark, d), {"c0": "raw_candidate", "g0": "guarded"})
    rc, rg = F.col("raw_candidate") - F.col("c0"), F.col("guarded") - F.col("g0")
    zero = F.lit(0.0)
    return t.frame.groupBy("domain", "unit").agg(
        F.round(F.coalesce(F.max(F.greatest(rc, zero)), zero), 12).alias("candidate_increase"),
        F.coalesce(F.max(F.greatest(rg, zero)), zero).alias("guarded_increase"),
        F.coalesce(F.bool_and(rc <= 1e-12), F.lit(True)).alias("candidate_monotone"),
        F.coalesce(F.bool_and(rg <= 1e-12), F.lit(True)).alias("guarded_monotone"),
    )


@query(
    "W7_first_crossing",
    with_guarded(""" SELECT domain, unit, min(rn) FILTER (truth <= 0.85e0) AS truth_record,
      min(order_key) FILTER (truth <= 0.85e0) AS truth_order,
      min(rn) FILTER (guarded <= 0.85e0) AS prediction_record,
      min(order_key) FILTER (guarded <= 0.85e0) AS prediction_order FROM gd GROUP BY ALL"""),
)
def w7(spark, d):
    f = ordering.with_rank(guarded(spark, d)).frame
    aggs = []
    for name, column in (("truth", "truth"), ("prediction", "guarded")):
        low = F.col(column) <= 0.85
        aggs += [
            F.min(F.when(low, F.col("rank"))).alias(f"{name}_record"),
            F.min(F.when(low, F.col("order_key"))).alias(f"{name}_order"),
        ]
    return f.groupBy("domain", "unit").agg(*aggs)


_GAIN = """
gain AS (
  SELECT *, CASE WHEN prev IS NULL THEN 0e0 ELSE least(greatest(
      CASE WHEN seconds - prev >= 0 THEN seconds - prev ELSE greatest(seconds, 0e0) END, 0e0), 3600e0) END AS gain
  FROM (SELECT *, lag(seconds) OVER (PARTITION BY unit ORDER BY position) AS prev FROM lg)
),
el AS (SELECT *, sum(gain) OVER (PARTITION BY unit ORDER BY position) AS elapsed FROM gain)"""


@query(
    "W8_elapsed_with_resets",
    f"WITH {LOG_SQL}, {_GAIN} SELECT unit, position, round(elapsed, 6) AS elapsed FROM el",
)
def w8(spark, d):
    f = ordering.elapsed_with_resets(log_trajectories(spark, d), "seconds").frame
    return f.select("unit", "position", F.round("elapsed", 6).alias("elapsed"))


@query(
    "W9_cumulative_charge",
    f"""WITH {LOG_SQL}, {_GAIN}, ar AS (
  SELECT *, coalesce(0.5e0 * (lag(current) OVER w + current)
     * least(greatest(elapsed - lag(elapsed) OVER w, 0e0), 3600e0) / 3600e0, 0e0) AS area
  FROM el WINDOW w AS (PARTITION BY unit ORDER BY position))
SELECT unit, position, round(sum(area) OVER (PARTITION BY unit ORDER BY position), 9) + 0e0 AS charge FROM ar""",
)
def w9(spark, d):
    t = ordering.elapsed_with_resets(log_trajectories(spark, d), "seconds")
    f = ordering.cumulative_charge(t, "elapsed", "current").frame
    return f.select("unit", "position", (F.round("charge", 9) + F.lit(0.0)).alias("charge"))


@query(
    "W10_active_blocks",
    f"""WITH {LOG_SQL}, s AS (
  SELECT *, current > 0.05e0 AS act,
         current > 0.05e0 AND NOT coalesce(lag(current > 0.05e0) OVER (PARTITION BY unit ORDER BY position), false) AS st
  FROM lg), b AS (
  SELECT *, sum(st::INT) OVER (PARTITION BY unit ORDER BY position) AS block FROM s)
SELECT unit, block::BIGINT AS block, count(*) AS records, min(position) AS first_position
FROM b WHERE act GROUP BY ALL""",
)
def w10(spark, d):
    t = ordering.with_block(log_trajectories(spark, d), F.col("current") > 0.05)
    return (
        t.frame.filter("block IS NOT NULL")
        .groupBy("unit", "block")
        .agg(F.count(F.lit(1)).alias("records"), F.min("position").alias("first_position"))
    )


@query(
    "W11_trim_to_first",
    f"""WITH {LOG_SQL} SELECT unit, position FROM (
  SELECT *, max((current > 0.5e0)::INT) OVER (PARTITION BY unit ORDER BY position) AS seen FROM lg) WHERE seen = 1""",
)
def w11(spark, d):
    t = ordering.trim_to_first(log_trajectories(spark, d), F.col("current") > 0.5)
    return t.frame.select("unit", "position")


@query(
    "W12_first_seen_order",
    f"""WITH {LOG_SQL} SELECT unit, kind, first_position,
  row_number() OVER (PARTITION BY unit ORDER BY first_position) AS source_order
  FROM (SELECT unit, kind, min(position) AS first_position FROM lg GROUP BY ALL)""",
)
def w12(spark, d):
    return ordering.first_seen_order(log_trajectories(spark, d).frame, ["unit"], "kind", "position")


@query(
    "W13_prefix_half",
    with_ledger(""" SELECT domain, unit, ordinal FROM
      (SELECT *, count(*) OVER (PARTITION BY domain, unit) AS n FROM led) WHERE rn <= greatest(1, n // 2)"""),
)
def w13(spark, d):
    return ordering.prefix_part(ordering.with_rank(trajectories(spark, d))).frame.select(*KEYS)


@query(
    "W14_running_max_perturbation",
    with_ledger(""" SELECT domain, unit, ordinal, max(abs(raw_candidate - raw_baseline))
      OVER (PARTITION BY domain, unit ORDER BY rn) AS running_gap FROM led"""),
)
def w14(spark, d):
    gap = F.abs(F.col("raw_candidate") - F.col("raw_baseline"))
    t = ordering.with_running(trajectories(spark, d), {"running_gap": ("max", gap)})
    return t.frame.select(*KEYS, "running_gap")


@query(
    "W15_running_minimum",
    with_ledger(""" SELECT domain, unit, ordinal, min(raw_candidate)
      OVER (PARTITION BY domain, unit ORDER BY rn) AS running_minimum FROM led"""),
)
def w15(spark, d):
    t = ordering.with_running(
        trajectories(spark, d), {"running_minimum": ("min", F.col("raw_candidate"))}
    )
    return t.frame.select(*KEYS, "running_minimum")


_SPACED = """, s AS (SELECT domain, unit, count(*) AS n FROM led GROUP BY ALL),
 pts AS (
  SELECT DISTINCT domain, unit, CASE WHEN n <= 8 THEN i ELSE round_even(i * ((n - 1) / 7e0), 0)::BIGINT END + 1 AS rn
  FROM s, range(0, 100000) r(i) WHERE i < CASE WHEN n <= 8 THEN n ELSE 8 END)
 SELECT domain, unit, ordinal FROM led SEMI JOIN pts USING (domain, unit, rn)"""


@query("W16_evenly_spaced", with_ledger(_SPACED.replace("range(0, 100000)", "range(0, 8)")))
def w16(spark, d):
    return ordering.evenly_spaced(ordering.with_rank(trajectories(spark, d)), 8).select(*KEYS)


# --- projections and predicates --------------------------------------------------------


@query(
    "P1_post_commissioning",
    with_ledger(" SELECT domain, unit, ordinal FROM led WHERE rn > 5"),
)
def p1(spark, d):
    return ordering.with_rank(trajectories(spark, d)).frame.filter("rank > 5").select(*KEYS)


@query(
    "P2_operating_band",
    with_ledger(""" SELECT domain, count(*) AS records, count(*) FILTER (truth BETWEEN 0.7e0 AND 1.1e0) AS in_band,
      round(avg(abs(raw_candidate - truth)) FILTER (truth BETWEEN 0.7e0 AND 1.1e0), 9) AS band_mae FROM led GROUP BY domain"""),
)
def p2(spark, d):
    band = F.col("truth").between(0.7, 1.1)
    error = F.abs(F.col("raw_candidate") - F.col("truth"))
    return ledger(spark, d).groupBy("domain").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(band).alias("in_band"),
        F.round(F.avg(F.when(band, error)), 9).alias("band_mae"),
    )


ROLES = {
    "events": {"unit": "user_id", "observed": "value"},
    "orders": {"unit": "o_custkey", "observed": "o_totalprice"},
    "lineitem": {"unit": "l_suppkey", "observed": "l_extendedprice"},
}


@query(
    "P3_role_mapping",
    " UNION ALL ".join(
        f"SELECT '{n}' AS source, {r['unit']} AS unit, count(*) AS records, max({r['observed']}) AS highest"
        f" FROM {n} GROUP BY ALL"
        for n, r in ROLES.items()
    ),
)
def p3(spark, d):
    from railguard.operators.reshape import union_arms
    from railguard.sources.tables import with_roles

    arms = {n: with_roles(table(spark, d, n), r) for n, r in ROLES.items()}
    return (
        union_arms(arms, "source")
        .groupBy("source", "unit")
        .agg(F.count(F.lit(1)).alias("records"), F.max("observed").alias("highest"))
    )


@query(
    "P4_score_mask",
    """SELECT source, count(*) AS documents, count(quality) AS scored, round(avg(quality), 9) AS mean_quality
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def p4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count("quality").alias("scored"),
        F.round(F.avg("quality"), 9).alias("mean_quality"),
    )


@query(
    "P5_clip_array",
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: least(greatest(x::DOUBLE, -0.1e0), 0.1e0))), 9) AS clipped_sum
    FROM embeddings""",
)
def p5(spark, d):
    clipped = F.transform("embedding", lambda x: clip(x.cast("double"), -0.1, 0.1))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 9).alias("clipped_sum"))


@query(
    "P6_log_order",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + l_quantity), 9) AS log_quantity FROM lineitem""",
)
def p6(spark, d):
    f = table(spark, d, "lineitem")
    return f.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(log_order("l_quantity"), 9).alias("log_quantity"),
    )


@query("P7_fixed_shift", with_guarded(" SELECT domain, unit, ordinal, fixed_shift FROM gd"))
def p7(spark, d):
    return guarded(spark, d).frame.select(*KEYS, "fixed_shift")


@query(
    "P8_safe_up_control",
    with_guarded(f""" SELECT domain, unit, round(avg(abs(least(protected_state + {BUDGET}e0, 1.3e0) - truth)), 9) AS mae
      FROM gd GROUP BY ALL"""),
)
def p8(spark, d):
    up = clip(F.col("protected_state") + BUDGET, 0.0, 1.3)
    return guarded(spark, d).frame.groupBy("domain", "unit").agg(
        F.round(F.avg(F.abs(up - F.col("truth"))), 9).alias("mae")
    )


@query(
    "P9_source_group_remap",
    with_ledger(""" SELECT CASE WHEN domain IN ('click', 'view') THEN 'browse' ELSE domain END AS domain,
      count(*) AS records, round(avg(truth), 9) AS mean_truth FROM led GROUP BY 1"""),
)
def p9(spark, d):
    f = remap(ledger(spark, d), "domain", {"click": "browse", "view": "browse"})
    return f.groupBy("domain").agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg("truth"), 9).alias("mean_truth")
    )


@query(
    "P10_first_active_stage",
    """WITH x AS (SELECT vec_id, label, list_filter(embedding, lambda v: abs(v) >= 0.05e0) AS act FROM embeddings)
SELECT vec_id, label, CASE WHEN len(act) = 0 THEN 'inactive' WHEN act[1] > 0 THEN 'charge' ELSE 'discharge' END AS first_stage,
       len(act) > 0 AND act[1] < 0 AS excluded FROM x""",
)
def p10(spark, d):
    f = table(spark, d, "embeddings")
    stage = active_stage("embedding", 0.05)
    return f.select(
        "vec_id", "label", stage.alias("first_stage"), (stage == "discharge").alias("excluded")
    )


_ELIGIBLE = """, u AS (
  SELECT domain, unit, count(*) AS n, count(*) FILTER (rn <= 5) AS anchors,
         quantile_cont(truth, 0.5) FILTER (rn <= 5) AS reference FROM led GROUP BY ALL
), r AS (
  SELECT *, CASE WHEN anchors < 5 THEN 'anchor_missing'
                 WHEN reference < 0.85e0 OR reference > 1.1e0 THEN 'reference_out_of_range'
                 WHEN n - 5 < 6 THEN 'too_few_records' END AS reason FROM u)"""


@query(
    "P11_eligibility_reasons",
    with_ledger(_ELIGIBLE + """ SELECT domain, coalesce(reason, 'eligible') AS reason, count(*) AS units,
      sum(n)::BIGINT AS records FROM r GROUP BY ALL"""),
)
def p11(spark, d):
    units = eligibility(ledger(spark, d), Keys(), "truth", (0.85, 1.1), 6)
    return units.groupBy("domain", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(
        F.count(F.lit(1)).alias("units"), F.sum("records").alias("records")
    )


