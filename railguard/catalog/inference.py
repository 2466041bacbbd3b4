"""Statistics as table jobs (B1-B8): many contrasts in one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from railguard.catalog.base import METHODS, guarded, query
from railguard.catalog.evaluation import with_metrics
from railguard.functions.draws import uniform_index_sql
from railguard.operators import inference, metrics

REPS, SEED = 100_000, 17
CONTRASTS = {"guarded-fixed_shift": ("guarded", "fixed_shift"),
             "guarded-protected_state": ("guarded", "protected_state"),
             "raw_candidate-guarded": ("raw_candidate", "guarded")}


def unit_contrasts(spark, d):
    """Unit MAE differences of every contrast, from one pass over the records."""
    units = metrics.unit_errors(guarded(spark, d).frame, METHODS)
    wide = units.groupBy("domain", "unit").pivot("method", METHODS).agg(F.first("mae"))
    rows = [
        F.struct(F.lit(n).alias("contrast_id"), (F.col(a) - F.col(b)).alias("difference"))
        for n, (a, b) in CONTRASTS.items()
    ]
    return wide.select("domain", "unit", F.inline(F.array(*rows)))


def domain_contrasts(spark, d):
    return unit_contrasts(spark, d).groupBy("contrast_id", "domain").agg(
        F.avg("difference").alias("difference")
    )


_UNITS = """
uc AS (SELECT domain, unit, max(mae) FILTER (method = 'guarded') AS g, max(mae) FILTER (method = 'fixed_shift') AS f,
  max(mae) FILTER (method = 'protected_state') AS s, max(mae) FILTER (method = 'raw_candidate') AS c FROM um GROUP BY ALL),
cu AS (SELECT 'guarded-fixed_shift' AS contrast_id, domain, unit, g - f AS difference FROM uc
  UNION ALL SELECT 'guarded-protected_state', domain, unit, g - s FROM uc
  UNION ALL SELECT 'raw_candidate-guarded', domain, unit, c - g FROM uc),
cd AS (SELECT contrast_id, domain, avg(difference) AS difference FROM cu GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY contrast_id ORDER BY domain) - 1 AS d, count(*) OVER (PARTITION BY contrast_id) AS n FROM cd),
pt AS (SELECT contrast_id, avg(difference) AS point FROM cd GROUP BY ALL)"""

_B1 = f"""
, dr AS (SELECT contrast_id, rep, {uniform_index_sql('n', SEED, 'rep', 'j')} AS d
  FROM (SELECT DISTINCT contrast_id, n FROM ix), range({REPS}) r(rep), LATERAL (SELECT unnest(range(n)) AS j)),
 rp AS (SELECT contrast_id, rep, avg(difference) AS r FROM dr JOIN ix USING (contrast_id, d) GROUP BY ALL)"""


@query(
    "B1_cluster_bootstrap",
    with_metrics(_B1 + """ SELECT contrast_id, round(point, 9) AS point, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high
      FROM rp JOIN pt USING (contrast_id) GROUP BY contrast_id, point""", _UNITS),
)
def b1(spark, d):
    return _nine(inference.cluster_bootstrap(domain_contrasts(spark, d), REPS, SEED))


def _nine(df):
    return df.withColumns({c: F.round(c, 9) for c in ("point", "low", "high")})


# The draws are the same for all contrasts, so SQL makes them once for the wide unit table.
_WIDE = """
, un AS (SELECT domain, unit, g - f AS x1, g - s AS x2, c - g AS x3, (row_number() OVER (PARTITION BY domain ORDER BY unit) - 1)::INT AS i,
   count(*) OVER (PARTITION BY domain) AS m FROM uc),
 sz AS (SELECT domain, any_value(m) AS m, row_number() OVER (ORDER BY domain) - 1 AS d, count(*) OVER () AS n FROM un GROUP BY domain)"""
_LONG = """SELECT 'guarded-fixed_shift' AS contrast_id, {0} r1 AS r FROM rw UNION ALL
   SELECT 'guarded-protected_state', {0} r2 FROM rw UNION ALL SELECT 'raw_candidate-guarded', {0} r3 FROM rw"""
_B2 = f"""{_WIDE},
 sl AS (SELECT rep, slot, {uniform_index_sql('n', SEED, 'rep', 'slot')} AS d
   FROM (SELECT DISTINCT n FROM sz), range({REPS}) r(rep), LATERAL (SELECT unnest(range(n)) AS slot)),
 dw AS (SELECT rep, slot, domain, {uniform_index_sql('m', SEED + 1, 'rep', 'slot', 'j')}::INT AS i
   FROM (SELECT sl.*, sz.domain, sz.m FROM sl JOIN sz USING (d)), LATERAL (SELECT unnest(range(m)) AS j)),
 ms AS (SELECT rep, slot, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3 FROM dw JOIN un USING (domain, i) GROUP BY rep, slot),
 rw AS (SELECT rep, avg(m1) AS r1, avg(m2) AS r2, avg(m3) AS r3 FROM ms GROUP BY rep),
 rp AS ({_LONG.format('rep,')})"""


@query(
    "B2_two_stage_bootstrap",
    with_metrics(_B2 + """ SELECT contrast_id, round(point, 9) AS point, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high
      FROM rp JOIN pt USING (contrast_id) GROUP BY contrast_id, point""", _UNITS),
)
def b2(spark, d):
    return _nine(inference.two_stage_bootstrap(unit_contrasts(spark, d), REPS, SEED))


_B3 = f"""{_WIDE},
 dw AS (SELECT rep, domain, {uniform_index_sql('m', SEED, 'rep', 'j', 'd')}::INT AS i
   FROM sz, range({REPS}) r(rep), LATERAL (SELECT unnest(range(m)) AS j)),
 rw AS (SELECT domain, rep, avg(x1) AS r1, avg(x2) AS r2, avg(x3) AS r3 FROM dw JOIN un USING (domain, i) GROUP BY domain, rep),
 rp AS ({_LONG.format('domain, rep,')})"""


@query(
    "B3_unit_bootstrap",
    with_metrics(_B3 + """ SELECT contrast_id, domain, round(difference, 9) AS point, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high
      FROM rp JOIN cd USING (contrast_id, domain) GROUP BY contrast_id, domain, difference""", _UNITS),
)
def b3(spark, d):
    return _nine(inference.unit_bootstrap(unit_contrasts(spark, d), REPS, SEED))


@query(
    "B4_bonferroni_interval",
    with_metrics(_B1 + """ SELECT contrast_id, round(point, 9) AS point, round(quantile_cont(r, 0.05 / 6), 9) AS low, round(quantile_cont(r, 1 - 0.05 / 6), 9) AS high
      FROM rp JOIN pt USING (contrast_id) GROUP BY contrast_id, point""", _UNITS),
)
def b4(spark, d):
    out = inference.cluster_bootstrap(
        domain_contrasts(spark, d), REPS, SEED, comparisons=len(CONTRASTS)
    )
    return _nine(out)


_B5 = """
, asg AS (SELECT contrast_id, code, sum(CASE WHEN (code >> d) & 1 = 1 THEN difference ELSE -difference END) / any_value(n) AS stat
   FROM ix, range(1024) c(code) WHERE code < 1 << n GROUP BY ALL),
 ob AS (SELECT contrast_id, abs(avg(difference)) AS o FROM cd GROUP BY ALL),
 sf AS (SELECT contrast_id, count(*) AS assignments, avg((abs(stat) >= o - 1e-12)::INT) AS sign_flip_p FROM asg JOIN ob USING (contrast_id) GROUP BY ALL)"""


@query(
    "B5_sign_flip",
    with_metrics(_B5 + " SELECT contrast_id, assignments, sign_flip_p FROM sf", _UNITS),
)
def b5(spark, d):
    return inference.sign_flip(domain_contrasts(spark, d))


_B6 = """
, wt AS (SELECT contrast_id, count(*) FILTER (difference < -1e-12) AS wins, count(*) FILTER (abs(difference) <= 1e-12) AS ties,
   count(*) FILTER (difference > 1e-12) AS losses FROM cd GROUP BY ALL),
 sp AS (SELECT contrast_id, wins, ties, losses, CASE WHEN wins + losses > 0 THEN least(1e0, 2e0 *
   (SELECT sum(factorial((wins + losses)::INT)::DOUBLE / (factorial(k::INT) * factorial((wins + losses - k)::INT))) FROM range(64) r(k) WHERE k <= least(wins, losses)) / pow(2e0, wins + losses)) ELSE 1e0 END AS sign_p FROM wt)"""


@query(
    "B6_sign_test",
    with_metrics(_B6 + " SELECT contrast_id, wins, ties, losses, sign_p::DOUBLE AS sign_p FROM sp", _UNITS),
)
def b6(spark, d):
    return inference.sign_test(domain_contrasts(spark, d))


_B7 = """
, rk AS (SELECT contrast_id, domain, d, n, sign(difference) * (rank() OVER (PARTITION BY contrast_id ORDER BY abs(difference))
     + (count(*) OVER (PARTITION BY contrast_id, abs(difference)) - 1) / 2e0) AS r FROM ix WHERE difference <> 0),
 wa AS (SELECT contrast_id, code, sum(CASE WHEN (code >> d) & 1 = 1 THEN r ELSE -r END) AS stat FROM rk, range(1024) c(code) WHERE code < 1 << n GROUP BY ALL),
 wo AS (SELECT contrast_id, abs(sum(r)) AS o FROM rk GROUP BY ALL),
 wx AS (SELECT contrast_id, avg((abs(stat) >= o - 1e-12)::INT) AS wilcoxon_p FROM wa JOIN wo USING (contrast_id) GROUP BY ALL),
 ti AS (SELECT contrast_id, count(*) AS n, avg(difference) AS mean, quantile_cont(difference, 0.5) AS median,
   stddev_samp(difference) / sqrt(count(*)) AS se FROM cd GROUP BY ALL)"""


@query(
    "B7_small_sample_summary",
    with_metrics(_B5 + _B6 + _B7 + """ SELECT contrast_id, n, round(mean, 9) AS mean, round(median, 9) AS median, round(se, 9) AS standard_error,
   round(mean - 2.7764451e0 * se, 9) AS t_low, round(mean + 2.7764451e0 * se, 9) AS t_high, wins, ties, losses, sign_p::DOUBLE AS sign_p,
   assignments, sign_flip_p, wilcoxon_p FROM ti JOIN sp USING (contrast_id) JOIN sf USING (contrast_id) JOIN wx USING (contrast_id)""", _UNITS),
)
def b7(spark, d):
    out = inference.small_sample_summary(domain_contrasts(spark, d))
    names = ("mean", "median", "standard_error", "t_low", "t_high")
    return out.withColumns({c: F.round(c, 9) for c in names})


@query(
    "B8_grouped_inference",
    """WITH u AS (SELECT l_returnflag || '/' || l_linestatus AS contrast_id, l_linenumber::VARCHAR AS domain, avg(l_discount - l_tax) - 0.01e0 AS difference FROM lineitem GROUP BY ALL),
 ix AS (SELECT *, row_number() OVER (PARTITION BY contrast_id ORDER BY domain) - 1 AS d, count(*) OVER (PARTITION BY contrast_id) AS n FROM u),
 asg AS (SELECT contrast_id, code, sum(CASE WHEN (code >> d) & 1 = 1 THEN difference ELSE -difference END) / any_value(n) AS stat
   FROM ix, range(1024) c(code) WHERE code < 1 << n GROUP BY ALL),
 ob AS (SELECT contrast_id, abs(avg(difference)) AS o FROM u GROUP BY ALL)
 SELECT contrast_id, count(*) AS assignments, avg((abs(stat) >= o - 1e-12)::INT) AS sign_flip_p FROM asg JOIN ob USING (contrast_id) GROUP BY ALL""",
)
def b8(spark, d):
    from railguard.catalog.base import table

    contrasts = (
        table(spark, d, "lineitem")
        .groupBy(
            F.concat_ws("/", "l_returnflag", "l_linestatus").alias("contrast_id"),
            F.col("l_linenumber").cast("string").alias("domain"),
        )
        .agg((F.avg(F.col("l_discount") - F.col("l_tax")) - 0.01).alias("difference"))
    )
    return inference.sign_flip(contrasts)
