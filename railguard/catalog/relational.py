"""Joins (J1-J11), contracts (C1-C14), sorts, sets and reshaping (O1-O9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import (
    ALPHA,
    METHODS,
    guarded,
    ledger,
    query,
    table,
    trajectories,
    with_guarded,
    with_ledger,
)
from railguard.operators import contracts, joins, ordering, reshape
from railguard.operators.layout import Keys, Trajectories
from railguard.operators.metrics import unit_errors

KEYS = ["domain", "unit", "ordinal"]


# --- joins -----------------------------------------------------------------------------


@query(
    "J1_complete_join",
    with_guarded(""" SELECT g.domain, g.unit, g.ordinal, g.truth, g.guarded
      FROM gd g JOIN led l ON g.domain = l.domain AND g.unit = l.unit AND g.ordinal = l.ordinal"""),
)
def j1(spark, d):
    predictions = guarded(spark, d).frame.select(*KEYS, "guarded")
    truth = ledger(spark, d).select(*KEYS, "truth")
    return joins.complete_join(truth, predictions, KEYS)


@query(
    "J2_unit_anchor_join",
    with_ledger(""", a AS (SELECT domain, unit, quantile_cont(raw_baseline, 0.5) AS anchor FROM led WHERE rn <= 5 GROUP BY ALL)
 SELECT domain, unit, ordinal, round(raw_baseline - anchor, 9) + 0e0 AS change FROM led JOIN a USING (domain, unit)"""),
)
def j2(spark, d):
    f = ledger(spark, d)
    anchors = ordering.first_records_median(f, Keys(), ["raw_baseline"], prefix="anchor_")
    joined = f.join(anchors, ["domain", "unit"], "left")
    change = F.round(F.col("raw_baseline") - F.col("anchor_raw_baseline"), 9) + F.lit(0.0)
    return joined.select(*KEYS, change.alias("change"))


@query(
    "J3_label_join",
    """SELECT doc_id, source, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality > 0""",
)
def j3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return joins.label_join(docs, labels, ["doc_id"], "quality")


@query(
    "J4_forward_pairing",
    """WITH e AS (SELECT user_id, event_id, event_type, ts,
   lead(event_type) OVER w AS nt, lead(event_id) OVER w AS ni FROM events
   WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, event_id, ni AS paired_event_id FROM e WHERE event_type = 'click' AND nt = 'purchase'""",
)
def j4(spark, d):
    f = table(spark, d, "events").select(
        F.lit("events").alias("domain"), "user_id", "ts", "event_id", "event_type"
    )
    t = Trajectories.plan(f, Keys(unit="user_id", order=("ts", "event_id")))
    pairs = joins.pair_forward(t, "event_type", "click", "purchase", ["event_id"])
    return pairs.select("user_id", "event_id", F.col("next_event_id").alias("paired_event_id"))


@query(
    "J5_lead_alignment",
    with_ledger(""" SELECT domain, unit, ordinal, CASE WHEN domain IN ('click', 'error')
      THEN lead(truth) OVER (PARTITION BY domain, unit ORDER BY rn) ELSE truth END AS target FROM led"""),
)
def j5(spark, d):
    t = joins.align_labels(trajectories(spark, d), "truth", {"click", "error"})
    return t.frame.select(*KEYS, "target")


_MEANS = ", m AS (SELECT domain, round(avg(truth), 9) AS level FROM led GROUP BY domain)"


@query(
    "J6_parameter_lookup",
    with_ledger(_MEANS + """ SELECT domain, unit, round(avg(abs(raw_candidate - level)), 9) AS spread
      FROM led JOIN m USING (domain) GROUP BY ALL"""),
)
def j6(spark, d):
    f = ledger(spark, d)
    levels = f.groupBy("domain").agg(F.round(F.avg("truth"), 9).alias("level"))
    joined = joins.lookup(f, levels, ["domain"])
    spread = F.avg(F.abs(F.col("raw_candidate") - F.col("level")))
    return joined.groupBy("domain", "unit").agg(F.round(spread, 9).alias("spread"))


@query(
    "J7_keep_eligible_units",
    with_ledger(""", u AS (SELECT domain, unit FROM led GROUP BY ALL HAVING count(*) >= 11)
 SELECT domain, unit, ordinal FROM led SEMI JOIN u USING (domain, unit)"""),
)
def j7(spark, d):
    f = ledger(spark, d)
    units = f.groupBy("domain", "unit").count().filter("count >= 11")
    return joins.keep_units(f, units, ["domain", "unit"]).select(*KEYS)


@query(
    "J8_unlabelled_documents",
    "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
)
def j8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return joins.drop_units(docs, table(spark, d, "labels"), ["doc_id"])


_J9_GRID = [(t, r) for t in (0.8, 0.85, 0.9) for r in (1.0, 5.0)]


@query(
    "J9_parameter_grid",
    with_ledger(""" SELECT domain, threshold, cost_ratio, count(*) AS records,
      round(avg((truth > threshold AND raw_candidate <= threshold)::INT
        + cost_ratio * (truth <= threshold AND raw_candidate > threshold)::INT), 9) AS cost
      FROM led, (VALUES (0.8e0), (0.85e0), (0.9e0)) a(threshold), (VALUES (1e0), (5e0)) b(cost_ratio) GROUP BY ALL"""),
)
def j9(spark, d):
    from railguard.operators.decisions import decision_units

    units = decision_units(
        ledger(spark, d), ["raw_candidate"], [0.8, 0.85, 0.9], [1.0, 5.0],
        keys=Keys(unit="domain"),
    )
    records = ledger(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("records"))
    return units.join(records, "domain").select(
        "domain", "threshold", "cost_ratio", "records", F.round("binary_cost", 9).alias("cost")
    )


@query(
    "J10_condition_join",
    """SELECT r_name || '|' || n_name AS condition, count(*) AS suppliers, round(avg(s_acctbal), 6) AS mean_balance
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def j10(spark, d):
    nation = table(spark, d, "nation").join(
        F.broadcast(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey")
    )
    conditions = nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    joined = joins.lookup(table(spark, d, "supplier"), conditions, ["s_nationkey"])
    return joined.groupBy(F.concat_ws("|", "r_name", "n_name").alias("condition")).agg(
        F.count(F.lit(1)).alias("suppliers"), F.round(F.avg("s_acctbal"), 6).alias("mean_balance")
    )


@query(
    "J11_full_outer_comparison",
    """WITH a AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS k, a.v AS v_left, b.v AS v_right,
  CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only'
       WHEN abs(a.v - b.v) <= 0.005e0 THEN 'equal' ELSE 'different' END AS status FROM a FULL JOIN b ON a.k = b.k""",
)
def j11(spark, d):
    orders = table(spark, d, "orders")

    def totals(rows):
        return rows.groupBy(F.col("o_custkey").alias("k")).agg(
            F.round(F.sum("o_totalprice"), 2).alias("v")
        )

    left = totals(orders.filter("o_orderstatus = 'F'"))
    right = totals(orders.filter("o_orderpriority IN ('1-URGENT', '2-HIGH')"))
    return joins.compare_tables(left, right, ["k"], ["v"], 0.005).drop("max_difference")


# --- contracts -------------------------------------------------------------------------


@query("C1_required_columns", "SELECT event_id, user_id, value FROM events")
def c1(spark, d):
    return contracts.require_columns(table(spark, d, "events"), ["event_id", "user_id", "value"])


@query("C2_feature_contract", "SELECT vec_id, label FROM embeddings")
def c2(spark, d):
    f = table(spark, d, "embeddings").select("vec_id", "label")
    contracts.forbid_columns(f.columns, ["quality", "toxic"])
    return f


@query(
    "C3_not_finite",
    """SELECT * FROM (SELECT 'l_discount' AS "column", count(*) FILTER (NOT coalesce(isfinite(1 / l_discount), false)) AS violations FROM lineitem
    UNION ALL SELECT 'l_tax', count(*) FILTER (NOT coalesce(isfinite(1 / l_tax), false)) FROM lineitem) WHERE violations > 0""",
)
def c3(spark, d):
    f = table(spark, d, "lineitem").select(
        F.try_divide(F.lit(1.0), "l_discount").alias("l_discount"),
        F.try_divide(F.lit(1.0), "l_tax").alias("l_tax"),
    )
    return contracts.not_finite(f, ["l_discount", "l_tax"])


@query(
    "C4_duplicate_rows",
    """SELECT role, text, count(*) AS rows FROM conversations GROUP BY ALL HAVING count(*) > 1""",
)
def c4(spark, d):
    return contracts.duplicate_rows(table(spark, d, "conversations").select("role", "text"))


@query(
    "C5_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
)
def c5(spark, d):
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return contracts.duplicate_keys(f, ["l_orderkey", "l_linenumber"])


@query(
    "C6_units_in_several_domains",
    """SELECT user_id, count(DISTINCT event_type) AS domains FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1""",
)
def c6(spark, d):
    f = table(spark, d, "events")
    return contracts.shared_units(f, Keys(domain="event_type", unit="user_id"))


@query(
    "C7_blank_ids",
    """SELECT conv_id, turn FROM conversations WHERE text IS NULL OR trim(text) = '' OR lower(trim(text)) = 'nan'""",
)
def c7(spark, d):
    return contracts.blank_ids(table(spark, d, "conversations"), "text").select("conv_id", "turn")


@query(
    "C8_roster_counts",
    """SELECT count(DISTINCT event_type) AS domains, count(DISTINCT event_type || ':' || user_id) AS units, count(*) AS records FROM events""",
)
def c8(spark, d):
    f = table(spark, d, "events")
    return contracts.roster_counts(f, Keys(domain="event_type", unit="user_id"))




@query(
    "C9_roster_differences",
    with_ledger(""", m AS (
  SELECT domain, unit, 'baseline' AS method, max(truth) AS v FROM led GROUP BY ALL
  UNION ALL SELECT domain, unit, 'candidate', max(truth) FROM led WHERE raw_candidate > 0.9e0 GROUP BY ALL)
 SELECT domain, unit, count(DISTINCT method) AS methods, count(*) AS rows, min(v) AS low, max(v) AS high
 FROM m GROUP BY ALL HAVING count(DISTINCT method) <> 2 OR count(*) <> 2 OR min(v) IS DISTINCT FROM max(v)"""),
)
def c9(spark, d):
    f = ledger(spark, d)
    arms = {
        "baseline": f.groupBy("domain", "unit").agg(F.max("truth").alias("v")),
        "candidate": f.filter("raw_candidate > 0.9").groupBy("domain", "unit").agg(
            F.max("truth").alias("v")
        ),
    }
    long = reshape.union_arms(arms, "method")
    return contracts.roster_differences(long, "method", list(arms), ["domain", "unit"], "v")


@query(
    "C10_label_blind",
    with_guarded(" SELECT domain, unit, ordinal, guarded FROM gd"),
)
def c10(spark, d):
    from railguard.operators.guard import guard

    blind = contracts.label_blind(ledger(spark, d).drop("truth"), ["truth"])
    t = guard(Trajectories.plan(blind), alpha=ALPHA, budget=0.02)
    return contracts.label_blind(t.frame, ["truth"]).select(*KEYS, "guarded")


@query(
    "C11_constant_within_group",
    """SELECT o_custkey, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders GROUP BY 1
    HAVING min(o_orderstatus) <> max(o_orderstatus)""",
)
def c11(spark, d):
    return contracts.varying_values(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query(
    "C12_state_violations",
    with_ledger(""", x AS (SELECT *, lag(raw_baseline) OVER (PARTITION BY domain, unit ORDER BY rn) AS before FROM led)
 SELECT domain, unit, ordinal, CASE WHEN raw_baseline < 0e0 - 1e-12 OR raw_baseline > 1.3e0 + 1e-12 THEN 'outside_range' ELSE 'increases' END AS reason
 FROM x WHERE raw_baseline < 0e0 - 1e-12 OR raw_baseline > 1.3e0 + 1e-12 OR coalesce(raw_baseline - before > 1e-12, false)"""),
)
def c12(spark, d):
    bad = contracts.state_violations(trajectories(spark, d), "raw_baseline", 0.0, 1.3)
    return bad.select(*KEYS, "reason")


@query(
    "C13_missing_anchors",
    with_ledger(" SELECT domain, unit, count(*) AS anchors FROM led WHERE rn <= 5 GROUP BY ALL HAVING count(*) < 5"),
)
def c13(spark, d):
    return contracts.missing_anchors(ledger(spark, d))


@query(
    "C14_bad_schedule_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax - 0.01e0 < 0 OR l_discount <= 0""",
)
def c14(spark, d):
    f = table(spark, d, "lineitem").withColumn("spare", F.col("l_tax") - 0.01)
    bad = contracts.bad_schedule(f, {"spare": False, "l_discount": True})
    return bad.select("l_orderkey", "l_linenumber", "l_partkey")


# --- sorts, sets, reshaping ------------------------------------------------------------


@query(
    "O1_stable_order",
    with_ledger(" SELECT domain, unit, ordinal, rn AS position FROM led"),
)
def o1(spark, d):
    return ordering.with_rank(trajectories(spark, d), "position").frame.select(*KEYS, "position")


@query(
    "O2_top_one",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
      (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def o2(spark, d):
    f = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reshape.top_one(f, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


_MAES = """, ue AS (UNPIVOT (SELECT domain, unit, avg(abs(protected_state - truth)) AS protected_state,
    avg(abs(fixed_shift - truth)) AS fixed_shift, avg(abs(guarded - truth)) AS guarded,
    avg(abs(raw_candidate - truth)) AS raw_candidate FROM gd GROUP BY ALL)
  ON protected_state, fixed_shift, guarded, raw_candidate INTO NAME method VALUE mae)"""


@query(
    "O3_ranked_summary",
    with_guarded(_MAES + """ SELECT method, round(avg(m), 9) AS domain_equal_mae, row_number() OVER (ORDER BY avg(m)) AS place
      FROM (SELECT domain, method, avg(mae) AS m FROM ue GROUP BY ALL) GROUP BY method"""),
)
def o3(spark, d):
    from pyspark.sql import Window

    units = unit_errors(guarded(spark, d).frame, METHODS)
    domains = units.groupBy("domain", "method").agg(F.avg("mae").alias("m"))
    methods = domains.groupBy("method").agg(F.avg("m").alias("m"))
    # One row per method is left, so ranking at the edge needs no partitioning.
    return methods.select(
        "method",
        F.round("m", 9).alias("domain_equal_mae"),
        F.row_number().over(Window.orderBy("m")).cast("bigint").alias("place"),
    )


@query(
    "O4_union_of_arms",
    with_guarded(""" SELECT 'state' AS arm, domain, round(avg(protected_state), 9) AS level FROM gd GROUP BY ALL
     UNION ALL SELECT 'guarded', domain, round(avg(guarded), 9) FROM gd GROUP BY ALL"""),
)
def o4(spark, d):
    f = guarded(spark, d).frame
    arms = {
        "state": f.select("domain", F.col("protected_state").alias("v")),
        "guarded": f.select("domain", F.col("guarded").alias("v")),
    }
    return reshape.union_arms(arms).groupBy("arm", "domain").agg(F.round(F.avg("v"), 9).alias("level"))


@query("O5_distinct_keys", "SELECT DISTINCT source, lang FROM documents")
def o5(spark, d):
    return table(spark, d, "documents").select("source", "lang").dropDuplicates()


@query(
    "O6_roster_sets",
    """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000)
 SELECT k, CASE WHEN k IN (SELECT k FROM a) THEN 'left_only' ELSE 'right_only' END AS status
 FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))""",
)
def o6(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    right = table(spark, d, "orders").filter("o_totalprice > 100000").select(
        F.col("o_custkey").alias("k")
    )
    return reshape.set_differences(left, right, ["k"])


@query(
    "O7_methods_to_columns",
    with_guarded(_MAES + """ SELECT domain, round(avg(mae) FILTER (method = 'protected_state'), 9) AS protected_state,
      round(avg(mae) FILTER (method = 'fixed_shift'), 9) AS fixed_shift, round(avg(mae) FILTER (method = 'guarded'), 9) AS guarded,
      round(avg(mae) FILTER (method = 'raw_candidate'), 9) AS raw_candidate FROM ue GROUP BY domain"""),
)
def o7(spark, d):
    units = unit_errors(guarded(spark, d).frame, METHODS)
    domains = units.groupBy("domain", "method").agg(F.round(F.avg("mae"), 9).alias("mae"))
    return reshape.methods_to_columns(domains, ["domain"], METHODS, "mae")


@query(
    "O8_methods_to_rows",
    with_guarded(""" SELECT domain, unit, ordinal, method, prediction FROM (UNPIVOT (SELECT domain, unit, ordinal, protected_state, fixed_shift, guarded, raw_candidate FROM gd)
      ON protected_state, fixed_shift, guarded, raw_candidate INTO NAME method VALUE prediction)"""),
)
def o8(spark, d):
    return reshape.methods_to_rows(guarded(spark, d).frame, KEYS, METHODS)


@query(
    "O9_deterministic_sample",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
       count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
 SELECT o_custkey, o_orderkey FROM s WHERE n <= 4
   OR rn - 1 IN (0, round_even(1 * ((n - 1) / 3e0), 0)::BIGINT, round_even(2 * ((n - 1) / 3e0), 0)::BIGINT, n - 1)""",
)
def o9(spark, d):
    f = table(spark, d, "orders").select(
        F.lit("orders").alias("domain"), "o_custkey", "o_orderdate", "o_orderkey"
    )
    t = Trajectories.plan(f, Keys(unit="o_custkey", order=("o_orderdate", "o_orderkey")))
    return ordering.evenly_spaced(ordering.with_rank(t), 4).select("o_custkey", "o_orderkey")
