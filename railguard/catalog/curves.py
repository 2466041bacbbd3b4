"""Curve features (F1-F13) and sources and sinks (S1-S12, D1-D5) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import ledger, query, table, with_ledger
from railguard.operators import curves
from railguard.operators.layout import Keys, Trajectories
from railguard.sources import exports, families, nested, sinks, tables

# --- embeddings as measured curves -------------------------------------------------------
# One vector is one cycle: position gives the clock (11 s apart, restarting once), the value
# gives voltage, current and a charge counter; odd labels carry no temperature.

NOMINAL = "CASE WHEN label = 9 THEN 0e0 ELSE 1.1e0 END"


def curve_table(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    pos = lambda i: (i + 1).cast("double")
    clock = lambda _, i: F.when(i < 40, 11.0 * i).otherwise(11.0 * (i - 39))
    return table(spark, d, "embeddings").select(
        "vec_id",
        "label",
        F.transform(x, lambda v: v * 2.0 + 0.3).alias("current"),
        F.transform(x, lambda v: v + 3.5).alias("voltage"),
        F.transform(x, clock).alias("time"),
        F.transform(x, lambda v, i: pos(i) * 0.01 + v * 0.05).alias("charge"),
        F.when(F.col("label") % 2 == 0, F.transform(x, lambda v: v + 25.0)).alias("temperature"),
        F.expr(NOMINAL).alias("nominal"),
    )


CURVE_SQL = f"""
cv AS (
  SELECT vec_id AS k, label, {NOMINAL} AS nominal, i, x * 2e0 + 0.3e0 AS cur, x + 3.5e0 AS v,
    CASE WHEN i <= 40 THEN 11e0 * (i - 1) ELSE 11e0 * (i - 40) END AS t,
    i * 0.01e0 + x * 0.05e0 AS q, CASE WHEN label % 2 = 0 THEN x + 25e0 END AS h
  FROM (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
)"""


def features_sql(source: str, threshold: str, block: bool = False) -> str:
    """CTEs from rows (k, i, cur, v, q, t, h, nominal) to features ``ft`` and reasons ``rs``."""
    early = (
        "CASE WHEN n < 3 THEN 'insufficient_finite_charge_points' WHEN span < 600e0 THEN 'charge_window_not_covered'"
        if block
        else "CASE WHEN n < 3 THEN 'misaligned_or_short_charge_arrays' WHEN nominal <= 0 THEN 'invalid_nominal_capacity'"
    )
    at = lambda g, c: f"max({c}) FILTER (g = {g})"
    volts = ", ".join(f"{at(g, 'gv')} AS v{g}" for g in curves.GRID_SECONDS)
    return f"""
n0 AS (SELECT k, count(*) AS n, max(t) - min(t) AS span, any_value(nominal) AS nominal FROM {source} GROUP BY k),
nx AS (SELECT *, lead(q) OVER (PARTITION BY k ORDER BY i) - q AS rise FROM {source}),
tr AS (SELECT * FROM (SELECT *, max(CASE WHEN rise > {threshold} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS seen FROM nx) WHERE seen = 1),
sg AS (SELECT *, t - lag(t) OVER (PARTITION BY k ORDER BY i) AS dt FROM tr),
ex AS (SELECT *, sum(CASE WHEN dt IS NULL THEN 0e0 ELSE least(greatest(CASE WHEN dt >= 0 THEN dt ELSE greatest(t, 0e0) END, 0e0), 3600e0) END)
        OVER (PARTITION BY k ORDER BY i) AS e FROM sg),
gr AS (SELECT k, g, arg_max(struct_pack(e := e, v := v, c := cur, q := q), (e, -i)) FILTER (e <= g) AS lo,
         arg_min(struct_pack(e := e, v := v, c := cur, q := q), (e, i)) FILTER (e >= g) AS hi
       FROM ex, (SELECT unnest({curves.GRID_SECONDS})::DOUBLE AS g) GROUP BY k, g),
gi AS (SELECT k, g, CASE WHEN hi.e = lo.e THEN lo.v ELSE (hi.v - lo.v) / (hi.e - lo.e) * (g - lo.e) + lo.v END AS gv,
         CASE WHEN hi.e = lo.e THEN lo.c ELSE (hi.c - lo.c) / (hi.e - lo.e) * (g - lo.e) + lo.c END AS gc,
         CASE WHEN hi.e = lo.e THEN lo.q ELSE (hi.q - lo.q) / (hi.e - lo.e) * (g - lo.e) + lo.q END AS gq FROM gr),
gw AS (SELECT k, {at(600, 'gq')} - {at(0, 'gq')} AS dq, {volts}, {at(0, 'gc')} AS c0, {at(300, 'gc')} AS c300, {at(600, 'gc')} AS c600 FROM gi GROUP BY k),
st AS (SELECT k, count(*) AS kept, max(e) AS fin, count(*) FILTER (e <= 600) AS points, avg(v) FILTER (e <= 600) AS vm, stddev_pop(v) FILTER (e <= 600) AS vs,
         avg(cur) FILTER (e <= 600) AS cm, stddev_pop(cur) FILTER (e <= 600) AS csd, avg(abs(cur)) FILTER (e <= 600) AS ca,
         avg(h) FILTER (e <= 600) AS hm, stddev_pop(h) FILTER (e <= 600) AS hs FROM ex GROUP BY k),
ft AS (
  SELECT n0.k, n0.nominal, {early} WHEN kept IS NULL THEN 'no_positive_charge_increment' WHEN kept < 3 THEN 'insufficient_finite_charge_points'
      WHEN fin < 600 THEN 'charge_window_not_covered' WHEN points < 3 THEN 'insufficient_points_in_charge_window'
      WHEN dq IS NULL OR dq <= 0 THEN 'nonpositive_early_charge_throughput' END AS reason,
    st.* EXCLUDE (k), gw.* EXCLUDE (k)
  FROM n0 LEFT JOIN st USING (k) LEFT JOIN gw USING (k))"""


_SCALARS = {
    "delta_q_per_nominal": "dq / nominal", "voltage_mean": "vm", "voltage_std": "vs",
    "voltage_slope_per_hour": "(v600 - v0) / (600e0 / 3600e0)", "current_c_mean": "cm / nominal",
    "current_c_std": "csd / nominal", "current_c_abs_mean": "ca / nominal", "points": "points::DOUBLE",
    **{f"voltage_at_{g}s": f"v{g}" for g in curves.GRID_SECONDS},
    **{f"current_c_at_{g}s": f"c{g} / nominal" for g in (0, 300, 600)},
}
_HEAT = {
    "temperature_available": "(hm IS NOT NULL)::INT::DOUBLE",
    "temperature_mean": "hm", "temperature_std": "hs",
}


def _select(fields: dict[str, str]) -> str:
    return ", ".join(f"round({e}, 9) + 0e0 AS {n}" for n, e in fields.items())


def _rounded_features(f, names):
    return [(F.round(F.col(f"features.{n}"), 9) + F.lit(0.0)).alias(n) for n in names]


def _early(spark, d):
    return curves.early_features(
        curve_table(spark, d), current="current", voltage="voltage", charge="charge", time="time",
        temperature="temperature", nominal=F.col("nominal"),
    )


@query(
    "F1_early_features",
    f"WITH {CURVE_SQL}, {features_sql('cv', 'greatest(1e-10, 1e-8 * nominal)')} "
    f"SELECT k AS vec_id, {_select(_SCALARS | _HEAT)} FROM ft WHERE reason IS NULL",
)
def f1(spark, d):
    f = _early(spark, d).filter("reason IS NULL")
    return f.select("vec_id", *_rounded_features(f, [*_SCALARS, *_HEAT]))


@query(
    "F2_rejection_reasons",
    f"WITH {CURVE_SQL}, {features_sql('cv', 'greatest(1e-10, 1e-8 * nominal)')} "
    "SELECT k AS vec_id, coalesce(reason, 'valid') AS reason FROM ft",
)
def f2(spark, d):
    return _early(spark, d).select("vec_id", F.coalesce("reason", F.lit("valid")).alias("reason"))


@query(
    "F3_grid_interpolation",
    f"""WITH {CURVE_SQL}, ee AS (SELECT k, i * 1e0 AS e, v FROM cv),
 gr AS (SELECT k, g, arg_max(struct_pack(e := e, v := v), e) FILTER (e <= g) AS lo, arg_min(struct_pack(e := e, v := v), e) FILTER (e >= g) AS hi
   FROM ee, (SELECT unnest([1.5e0, 7.25e0, 20e0, 63.75e0]) AS g) GROUP BY k, g)
 SELECT k AS vec_id, g AS place, round(CASE WHEN hi.e = lo.e THEN lo.v ELSE (hi.v - lo.v) / (hi.e - lo.e) * (g - lo.e) + lo.v END, 9) AS value FROM gr""",
)
def f3(spark, d):
    places = [1.5, 7.25, 20.0, 63.75]
    f = curve_table(spark, d)
    x = F.transform("voltage", lambda _, i: (i + 1).cast("double"))
    grid = F.array(*[F.lit(g) for g in places])
    values = curves.interpolate(x, F.col("voltage"), places)
    return f.select("vec_id", F.inline(F.arrays_zip(grid.alias("place"), values.alias("value")))).withColumn(
        "value", F.round("value", 9)
    )


@query(
    "F4_largest_positive_label",
    "SELECT vec_id, CASE WHEN list_max(embedding) - 0.25 > 0 THEN round(list_max(embedding)::DOUBLE - 0.25e0, 9) END AS label_value FROM embeddings",
)
def f4(spark, d):
    shifted = F.transform("embedding", lambda v: v.cast("double") - 0.25)
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(curves.largest_positive(shifted), 9).alias("label_value")
    )


# --- events as instrument text exports ---------------------------------------------------
# One user is one file; six days make one cycle.  Delimiter and decimal mark vary by file.

_EXPORT = """
ev AS (
  SELECT 'unit_' || user_id AS file, event_id AS line, us // 518400000000 AS cycle, user_id,
         (us % 518400000000) / 3600000000e0 AS hours, value / 100e0 - 0.25e0 AS cur, 3e0 + value / 1000e0 AS v,
         round(value / 50e0, 4) AS ah, 20e0 + value / 40e0 AS warm
  FROM (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events))"""


def export_lines(spark, d):
    """Text lines derived from events: comments, one header per file, data rows."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select("event_id", "user_id", "value", us.alias("us"))
    kind = F.col("user_id") % 4
    mark = F.when(kind == 0, ",").when(kind == 1, "\t").when(kind == 2, ";").otherwise(" ")
    # Only files without comma delimiters use decimal commas.
    decimal = F.when(kind.isin(2, 3), ",").otherwise(".")
    text = lambda c: F.call_function("translate", c.cast("string"), F.lit("."), decimal)
    hours = F.col("us") % 518400000000 / F.lit(3600000000.0)
    row = F.call_function(
        "concat_ws", mark, text(hours), text(3.0 + F.col("value") / 1000.0), text(F.col("value") / 100.0 - 0.25),
        text(F.round(F.col("value") / 50.0, 4)), F.floor(F.col("us") / 518400000000).cast("string"),
    )
    head = F.call_function(
        "concat_ws", mark, F.lit("~Time[h]"), F.lit("U[V]"), F.lit("I[A]"), F.lit("Ah[Ah]"), F.lit("Cyc-Count")
    )
    file = F.concat(F.lit("unit_"), F.col("user_id").cast("string"))
    data = e.select(file.alias("file"), F.col("event_id").alias("line"), row.alias("value"))
    users = e.select("user_id").distinct()
    top = users.select(file.alias("file"), F.lit(-1).cast("bigint").alias("line"), head.alias("value"))
    note = users.select(
        file.alias("file"), F.lit(-2).cast("bigint").alias("line"), F.lit("~ exported log").alias("value")
    )
    return data.unionByName(top).unionByName(note)


def _measured(spark, d, check=True):
    f = exports.with_seconds(exports.prediction_fields(export_lines(spark, d), check))
    return f.select(
        "file", "line", exports.number("cycle_raw").cast("bigint").alias("cycle"), "seconds",
        exports.number("current_raw").alias("current"), exports.number("voltage_raw").alias("voltage"),
    )


@query(
    "S6_text_export_fields",
    f"WITH {_EXPORT} SELECT file, line, cycle, round(hours * 3600e0, 6) AS seconds, cur AS current, v AS voltage FROM ev",
)
def s6(spark, d):
    return _measured(spark, d).withColumn("seconds", F.round("seconds", 6))


@query(
    "S7_text_export_labels",
    f"WITH {_EXPORT} SELECT file, line, cycle, cur AS current, ah AS cumulative FROM ev",
)
def s7(spark, d):
    f = exports.label_fields(export_lines(spark, d))
    return f.select(
        "file", "line", exports.number("cycle_raw").cast("bigint").alias("cycle"),
        exports.number("current_raw").alias("current"),
        exports.number("cumulative_raw").alias("cumulative"),
    )


def family_lines(spark, d):
    """The same records in three families of exports, one file per user, told by user_id % 3."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select("event_id", "user_id", "value", us.alias("us"))
    kind = F.col("user_id") % 3
    text = lambda c: c.cast("string")
    comma = lambda c: F.translate(text(c), ".", ",")
    hours = F.col("us") % 518400000000 / F.lit(3600000000.0)
    seconds = F.col("us") % 518400000000 / F.lit(1000000.0)
    cycle = text(F.floor(F.col("us") / 518400000000))
    volts, amps = 3.0 + F.col("value") / 1000.0, F.col("value") / 100.0 - 0.25
    charge, warm = F.round(F.col("value") / 50.0, 4), 20.0 + F.col("value") / 40.0
    quote = F.lit('"')
    row = (
        F.when(kind == 0, F.concat_ws(" ", text(hours), text(volts), text(amps), text(charge), cycle))
        .when(kind == 1, F.concat_ws(";", cycle, comma(hours), F.concat(quote, comma(amps), quote), comma(volts), comma(charge), comma(warm)))
        .otherwise(F.concat_ws(",", cycle, F.lit('"a, ""b"""'), text(seconds), text(amps), F.lit("9"), text(volts), F.lit("7"), text(warm), text(charge)))
    )
    head = (
        F.when(kind == 0, "~Time[h] U[V] I[A] Ah[Ah] Cyc-Count")
        .when(kind == 1, "Cyc-Count;~Time[h];I[A];U[V];Ah[Ah];T1[°C]")
        .otherwise('"Cycle Count","Start time, local",Test Time,Cell current,Charge current limit,"Cell voltage",'
                   "Chamber temp,Cell temp,Ah-Cyc-Discharge-0")
    )
    file = F.concat(F.lit("unit_"), F.col("user_id").cast("string")).alias("file")
    users = e.select("user_id").distinct()
    above = lambda n, value: users.select(file, F.lit(n).cast("bigint").alias("line"), value.alias("value"))
    return (
        e.select(file, F.col("event_id").alias("line"), row.alias("value"))
        .unionByName(above(-1, head))
        .unionByName(above(-2, F.lit("exported log; unit, cycle and time below")))
    )


@query(
    "S6_text_export_families",
    f"""WITH {_EXPORT} SELECT file, line, ['prefixed', 'counter', 'synonyms'][user_id % 3 + 1] AS family, cycle,
     round(hours * 3600e0, 6) AS seconds, cur AS current, v AS voltage,
     CASE WHEN user_id % 3 > 0 THEN warm END AS temperature FROM ev""",
)
def s6_families(spark, d):
    f = families.with_seconds(families.prediction_fields(family_lines(spark, d)))
    return f.select(
        "file", "line", "family", exports.number("cycle_raw").cast("bigint").alias("cycle"),
        F.round("seconds", 6).alias("seconds"), exports.number("current_raw").alias("current"),
        exports.number("voltage_raw").alias("voltage"), exports.number("temperature_raw").alias("temperature"),
    )


@query(
    "S7_text_export_family_labels",
    f"""WITH {_EXPORT} SELECT file, line, cycle, cur AS current, CASE WHEN user_id % 3 < 2 THEN ah END AS cumulative,
     CASE WHEN user_id % 3 = 2 THEN ah END AS capacity FROM ev""",
)
def s7_families(spark, d):
    f = families.label_fields(family_lines(spark, d))
    return f.select(
        "file", "line", exports.number("cycle_raw").cast("bigint").alias("cycle"),
        *[exports.number(f"{c}_raw").alias(c) for c in ("current", "cumulative", "capacity")],
    )


@query(
    "S10_header_inventory",
    """SELECT count(DISTINCT user_id) AS files, min('unit_' || user_id) AS first_file, 5 AS fields FROM events GROUP BY user_id % 4""",
)
def s10(spark, d):
    return exports.header_inventory(export_lines(spark, d)).drop("signature")


@query(
    "F5_negative_variation",
    f"""WITH {_EXPORT}, x AS (SELECT *, lag(ah) OVER (PARTITION BY file, cycle ORDER BY line) AS b FROM ev)
 SELECT file, cycle, round(sum(b - ah) FILTER (cur < -0.05e0 AND b - ah > 0), 9) AS label FROM x GROUP BY ALL""",
)
def f5(spark, d):
    rows = s7(spark, d)
    t = Trajectories.plan(rows, Keys(domain="file", unit="cycle", order=("line",)))
    return curves.negative_variation(t, "current", "cumulative").withColumn("label", F.round("label", 9))


@query(
    "F6_largest_discharge",
    f"""WITH {_EXPORT} SELECT file, cycle, max(abs(ah)) FILTER (cur < -0.05e0 AND abs(ah) > 0) AS label FROM ev GROUP BY ALL""",
)
def f6(spark, d):
    return curves.largest_discharge(s7(spark, d), ["file", "cycle"], "current", "cumulative")


@query(
    "F7_located_scalar",
    """WITH loc AS (SELECT vec_id, (vec_id * 7) % 600 AS target FROM embeddings),
 ob AS (SELECT vec_id AS target, CASE WHEN label < 7 THEN 'discharge' ELSE 'charge' END AS kind, list_filter(embedding, lambda v: v > 0.25) AS vals FROM embeddings)
 SELECT loc.vec_id, target, CASE WHEN kind IS NULL THEN 'source_missing' WHEN kind <> 'discharge' THEN 'locator_has_other_kind'
   WHEN len(vals) <> 1 THEN 'not_one_positive_scalar' END AS reason,
   CASE WHEN kind = 'discharge' AND len(vals) = 1 THEN vals[1]::DOUBLE END AS label FROM loc LEFT JOIN ob USING (target)""",
)
def f7(spark, d):
    e = table(spark, d, "embeddings")
    locators = e.select("vec_id", (F.col("vec_id") * 7 % 600).alias("target"))
    objects = e.select(
        F.col("vec_id").alias("target"),
        F.when(F.col("label") < 7, "discharge").otherwise("charge").alias("kind"),
        F.transform(F.filter("embedding", lambda v: v > 0.25), lambda v: v.cast("double")).alias("vals"),
    )
    out = curves.located_scalar(locators, objects, ["target"], "kind", "vals", "discharge")
    return out.select("vec_id", "target", "reason", "label")


@query(
    "F8_retention_targets",
    with_ledger(""", r AS (SELECT domain, unit, quantile_cont(truth, 0.5) AS ref FROM led WHERE rn <= 5 GROUP BY ALL)
 SELECT domain, unit, ordinal, round(truth / ref, 9) AS retention_initial, round(truth / raw_baseline, 9) AS retention_nominal
 FROM led JOIN r USING (domain, unit)"""),
)
def f8(spark, d):
    f = curves.retention(ledger(spark, d), Keys(), "truth", "raw_baseline")
    return f.select(
        "domain", "unit", "ordinal", F.round("retention_initial", 9).alias("retention_initial"),
        F.round("retention_nominal", 9).alias("retention_nominal"),
    )


FEATURES = ["raw_baseline", "raw_candidate"]
_ANCHOR = """, a AS (SELECT domain, unit, quantile_cont(raw_baseline, 0.5) AS m, abs(quantile_cont(raw_baseline, 0.75) - quantile_cont(raw_baseline, 0.25)) AS s
   FROM led WHERE rn <= 5 GROUP BY ALL)"""


@query(
    "F9_anchor_coordinates",
    with_ledger(_ANCHOR + """ SELECT domain, unit, ordinal,
   round(least(greatest(CASE WHEN s > 1e-12 THEN (raw_baseline - m) / s ELSE 0e0 END, -20e0), 20e0), 6) + 0e0 AS z, (s > 1e-12)::INT::DOUBLE AS valid
 FROM led JOIN a USING (domain, unit)"""),
)
def f9(spark, d):
    f = curves.anchor_coordinates(ledger(spark, d), Keys(), ["raw_baseline"])
    return f.select(
        "domain", "unit", "ordinal",
        (F.round("anchor_z__raw_baseline", 6) + F.lit(0.0)).alias("z"),
        F.col("anchor_valid__raw_baseline").alias("valid"),
    )


@query(
    "F9_anchor_coverage",
    with_ledger(_ANCHOR + """ SELECT 'raw_baseline' AS feature, count(*) AS units, count(*) FILTER (s > 1e-12) AS valid_units,
   round(avg((s > 1e-12)::INT), 9) AS valid_fraction FROM a"""),
)
def f9_coverage(spark, d):
    f = curves.anchor_coordinates(ledger(spark, d), Keys(), ["raw_baseline"])
    out = curves.anchor_coverage(f, Keys(), ["raw_baseline"])
    return out.withColumn("valid_fraction", F.round("valid_fraction", 9))


@query(
    "F10_context_change",
    with_ledger(_ANCHOR + """ SELECT domain, unit, ordinal, round(m, 9) AS context, round(raw_baseline - m, 9) + 0e0 AS change,
   round(least(greatest((raw_baseline - m) / greatest(abs(m), 1e-6), -5e0), 5e0), 9) + 0e0 AS relative_change FROM led JOIN a USING (domain, unit)"""),
)
def f10(spark, d):
    f = curves.context_change(ledger(spark, d), Keys(), ["raw_baseline"])
    pick = {"context": "context__raw_baseline", "change": "change__raw_baseline",
            "relative_change": "relative_change__raw_baseline"}
    return f.select(
        "domain", "unit", "ordinal",
        *[(F.round(c, 9) + F.lit(0.0)).alias(n) for n, c in pick.items()],
    )


_BLOCKS = f"""{_EXPORT},
b0 AS (SELECT *, cur > 0.05e0 AS act, lag(cur > 0.05e0) OVER (PARTITION BY file, cycle ORDER BY line) AS was FROM ev),
b1 AS (SELECT *, sum((act AND NOT coalesce(was, false))::INT) OVER (PARTITION BY file, cycle ORDER BY line) AS block FROM b0),
b2 AS (SELECT file || '#' || cycle || '#' || block AS k, file, cycle, block, cur, v, hours * 3600e0 AS t, line, 0.5e0 AS nominal, NULL::DOUBLE AS h FROM b1 WHERE act),
b3 AS (SELECT *, row_number() OVER w AS i, 0.5e0 * (lag(cur) OVER w + cur) * least(greatest(t - lag(t) OVER w, 0e0), 3600e0) / 3600e0 AS area
       FROM b2 WINDOW w AS (PARTITION BY k ORDER BY t, line)),
cv AS (SELECT *, sum(coalesce(area, 0e0)) OVER (PARTITION BY k ORDER BY i) AS q FROM b3)"""


@query(
    "F11_first_passing_block",
    f"""WITH {_BLOCKS}, {features_sql('cv', '1e-8 * 0.5e0', block=True)},
 kk AS (SELECT DISTINCT k, file, cycle, block FROM cv),
 fb AS (SELECT kk.file, kk.cycle, kk.block, ft.* FROM kk JOIN ft USING (k)),
 ch AS (SELECT file, cycle, min(block) FILTER (reason IS NULL) AS block, arg_max(reason, block) FILTER (reason IS NOT NULL) AS last FROM fb GROUP BY ALL),
 cy AS (SELECT DISTINCT file, cycle FROM ev)
 SELECT cy.file, cy.cycle, ch.block::BIGINT AS block, CASE WHEN ch.block IS NULL THEN coalesce(ch.last, 'no_positive_charge_segment') END AS reason, {_select(_SCALARS)}
 FROM cy LEFT JOIN ch USING (file, cycle) LEFT JOIN fb ON fb.file = cy.file AND fb.cycle = cy.cycle AND fb.block = ch.block""",
)
def f11(spark, d):
    rows = _measured(spark, d)
    t = Trajectories.plan(rows, Keys(domain="file", unit="cycle", order=("line",)))
    out = curves.first_passing_block(
        t, cycle="cycle", current="current", voltage="voltage", time="seconds", nominal=0.5
    )
    return out.select("file", "cycle", "block", "reason", *_rounded_features(out, _SCALARS))


@query(
    "F12_protocol_rate",
    """SELECT vec_id, list_filter(embedding, lambda v: v > 0.15)[1]::DOUBLE AS rate FROM embeddings""",
)
def f12(spark, d):
    steps = F.transform(
        "embedding",
        lambda v: F.struct(
            F.when(v > 0.15, v.cast("double").cast("string")).when(v > 0, "rest").alias("rate_in_C")
        ),
    )
    f = table(spark, d, "embeddings").select("vec_id", steps.alias("protocol"))
    return f.select("vec_id", curves.first_rate("protocol").alias("rate"))


@query(
    "F13_charge_window",
    """WITH x AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN 'c_' || (label * 10) || '-' || (label * 10 + vec_id % 20) || '_x' ELSE 'c_' || vec_id END AS id,
   round(embedding[1]::DOUBLE + 0.2e0, 6) AS m0, round(embedding[2]::DOUBLE + 0.6e0, 6) AS m1 FROM embeddings),
 y AS (SELECT *, try_cast(regexp_extract(id, '_(\\d{1,3})-(\\d{1,3})_', 1) AS DOUBLE) / 100e0 AS a, try_cast(regexp_extract(id, '_(\\d{1,3})-(\\d{1,3})_', 2) AS DOUBLE) / 100e0 AS b FROM x),
 z AS (SELECT *, coalesce(a >= 0 AND a < b AND b <= 1, false) AS ok1, coalesce(m0 >= 0 AND m0 < m1 AND m1 <= 1, false) AS ok2 FROM y)
 SELECT vec_id, CASE WHEN ok1 THEN a WHEN ok2 THEN m0 END AS soc_lower, CASE WHEN ok1 THEN b WHEN ok2 THEN m1 END AS soc_upper,
   CASE WHEN ok1 THEN 'cell_id' WHEN ok2 THEN 'metadata' ELSE 'unresolved' END AS soc_source,
   coalesce(CASE WHEN ok1 THEN a WHEN ok2 THEN m0 END <= 0.01e0 AND CASE WHEN ok1 THEN b WHEN ok2 THEN m1 END >= 0.99e0, false) AS full_window FROM z""",
)
def f13(spark, d):
    label, vec = F.col("label"), F.col("vec_id")
    low, high = (label * 10).cast("string"), (label * 10 + vec % 20).cast("string")
    ident = F.when(
        vec % 3 == 0, F.concat(F.lit("c_"), low, F.lit("-"), high, F.lit("_x"))
    ).otherwise(F.concat(F.lit("c_"), vec.cast("string")))
    meta = F.array(
        F.round(F.get("embedding", F.lit(0)).cast("double") + 0.2, 6),
        F.round(F.get("embedding", F.lit(1)).cast("double") + 0.6, 6),
    )
    f = table(spark, d, "embeddings").select("vec_id", ident.alias("id"), meta.alias("interval"))
    return f.select("vec_id", *curves.soc_window("id", "interval"))


# --- scans and unions --------------------------------------------------------------------


@query("S1_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def s1(spark, d):
    f = tables.read_columns(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])
    return f.filter("o_totalprice > 200000")


@query(
    "S2_union_with_contract",
    """SELECT 'customer' AS domain, 'c' || c_custkey AS unit, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', 's' || s_suppkey, s_acctbal FROM supplier""",
)
def s2(spark, d):
    parts = {
        "customer": table(spark, d, "customer").select(
            F.lit("customer").alias("domain"), F.concat(F.lit("c"), "c_custkey").alias("unit"),
            F.col("c_acctbal").alias("balance"),
        ),
        "supplier": table(spark, d, "supplier").select(
            F.lit("supplier").alias("domain"), F.concat(F.lit("s"), "s_suppkey").alias("unit"),
            F.col("s_acctbal").alias("balance"),
        ),
    }
    return tables.union_sources(parts, ["domain", "unit", "balance"])


@query(
    "S11_roster_complement",
    "SELECT 'unit_' || user_id AS file FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)",
)
def s11(spark, d):
    e = table(spark, d, "events").select("user_id", "value")
    file = F.concat(F.lit("unit_"), F.col("user_id").cast("string")).alias("file")
    development = e.filter("value > 150").select(file).distinct()
    return exports.confirmation_roster(e.select(file).distinct(), development)




@query(
    "S9_cycle_discovery",
    """WITH x AS (SELECT vec_id, unnest(range(0, len(embedding))) AS cycle_index, unnest(embedding)::DOUBLE AS reading FROM embeddings),
 y AS (SELECT *, reading > 0.1e0 AS known, floor(reading * 20e0) AS h, cycle_index % 60 AS m FROM x)
 SELECT vec_id, cycle_index, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN known THEN 0 ELSE 1 END,
   CASE WHEN known THEN h ELSE 0 END, CASE WHEN known THEN m ELSE 0 END, cycle_index) AS place FROM y""",
)
def s9(spark, d):
    from railguard.operators.ordering import with_rank

    e = table(spark, d, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: F.struct(v.cast("double").alias("reading"))).alias("cycle_data"),
    )
    cycles = nested.explode_cycles(e, ["vec_id"])
    hour = F.floor(F.col("reading") * 20.0).cast("double")
    minute = (F.col("cycle_index") % 60).cast("double")
    vector = F.when(
        F.col("reading") > 0.1,
        F.array(F.lit(2024.0), F.lit(1.0), F.lit(1.0), hour, minute, F.lit(0.0)),
    )
    keyed = cycles.withColumn("vector", vector).withColumn("source", F.lit("embeddings"))
    keyed = keyed.withColumn("sort_key", nested.time_vector_key("vector", "source", "cycle_index"))
    t = Trajectories.plan(
        keyed.select("source", "vec_id", "cycle_index", "sort_key").withColumn("o", F.lit(0)),
        Keys(domain="source", unit="vec_id", order=("o", "sort_key")),
    )
    return with_rank(t, "place").frame.select(
        "vec_id", F.col("cycle_index").cast("bigint").alias("cycle_index"), "place"
    )


@query(
    "S8_nested_units",
    """WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
 SELECT 'unit_' || vec_id AS cell_id, (i // 16)::INT AS cycle_index, (i // 16 + 1)::INT AS cycle_number, max(v) AS highest, count(*)::INT AS points FROM x GROUP BY ALL""",
)
def s8(spark, d):
    """Nested unit objects (four cycles of sixteen points each) stored, read and exploded."""
    from railguard.session import scratch_path

    values = F.transform("embedding", lambda v: v.cast("double"))

    def cycle(i):
        part = F.slice(values, i * 16 + 1, F.lit(16))
        return F.struct(
            (i + 1).cast("int").alias("cycle_number"),
            *[part.alias(name) for name in nested.CYCLE_ARRAYS],
        )

    steps = F.array(F.struct(F.lit("0.5").alias("rate_in_C")))
    units = table(spark, d, "embeddings").select(
        F.concat(F.lit("unit_"), F.col("vec_id").cast("string")).alias("cell_id"),
        F.lit(1.1).alias("nominal_capacity_in_Ah"),
        steps.alias("charge_protocol"), steps.alias("discharge_protocol"),
        F.array(F.lit(0.0), F.lit(1.0)).alias("SOC_interval"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), cycle).alias("cycle_data"),
    )
    path = scratch_path(spark, "units")
    sinks.write_parquet(units, path)
    cycles = nested.explode_cycles(nested.read_units(spark, path), ["cell_id"])
    return cycles.select(
        "cell_id", "cycle_index", "cycle_number",
        F.array_max("voltage_in_V").alias("highest"), F.size("voltage_in_V").alias("points"),
    )


# --- sinks -------------------------------------------------------------------------------


@query(
    "D4_duplicate_payloads",
    "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def d4(spark, d):
    return sinks.duplicate_payloads(table(spark, d, "documents"), "doc_id", "text")


@query(
    "D5_manifest_difference",
    """SELECT doc_id AS path, CASE WHEN quality IS NULL THEN 'missing' ELSE 'changed' END AS status
    FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR (toxic = 1 AND text <> '')""",
)
def d5(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    saved = docs.select("path", F.sha2("text", 256).alias("sha256"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("path"), "toxic")
    kept = docs.join(labels, "path")
    edited = F.when(F.col("toxic") == 1, "").otherwise(F.col("text"))
    return sinks.manifest_difference(saved, kept.select("path", F.sha2(edited, 256).alias("sha256")))


@query("D1_parquet_round_trip", with_ledger(" SELECT domain, unit, ordinal, truth FROM led"))
def d1(spark, d):
    from railguard.session import scratch_path

    path = scratch_path(spark, "ledger")
    sinks.write_parquet(ledger(spark, d).select("domain", "unit", "ordinal", "truth"), path)
    return spark.read.parquet(path)


@query(
    "D3_report",
    """SELECT count(*) AS records, count(DISTINCT event_type) AS domains, round(max(value), 6) AS highest FROM events""",
)
def d3(spark, d):
    """Nested report written as JSON text and read back through its declared schema."""
    one = table(spark, d, "events").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("event_type").alias("domains"),
        F.round(F.max("value"), 6).alias("highest"),
    )
    parts = {"counts": F.struct("records", "domains"), "values": F.struct("highest")}
    text = sinks.report(parts, one)
    schema = "counts struct<records bigint, domains bigint>, values struct<highest double>"
    body = F.from_json("report", schema, {"mode": "FAILFAST"})
    return text.select(body.alias("b")).select("b.counts.records", "b.counts.domains", "b.values.highest")


@query("S4_csv_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s4(spark, d):
    from railguard.session import scratch_path

    path = scratch_path(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option(
        "header", True
    ).csv(path)
    return tables.read_csv(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("S5_json_scan", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def s5(spark, d):
    from railguard.session import scratch_path

    path = scratch_path(spark, "json")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.json(path)
    return tables.read_json(spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double", lines=True)


@query(
    "S3_multi_dataset_load",
    "SELECT event_type AS domain, count(*) AS records, max(value) AS highest FROM events GROUP BY 1",
)
def s3(spark, d):
    from railguard.session import scratch_path

    path = scratch_path(spark, "datasets")
    events = table(spark, d, "events").select(F.col("event_type").alias("domain"), "user_id", "value")
    # Domains are declared data sets, a short list; which ones there are is read from the data.
    names = sorted(r["domain"] for r in events.select("domain").distinct().collect())
    events.withColumn("folder", F.col("domain")).write.partitionBy("folder").parquet(path)
    out = tables.read_datasets(spark, {n: f"{path}/folder={n}" for n in names}, ["domain", "user_id", "value"])
    return out.groupBy("domain").agg(
        F.count(F.lit(1)).alias("records"), F.max("value").alias("highest")
    )


