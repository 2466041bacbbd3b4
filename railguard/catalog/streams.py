"""Streaming guard (R1-R6): streams over the driver's event files, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.catalog.base import (
    ALPHA, BUDGET, guarded, ledger_columns, query, table, with_guarded, with_ledger,
)
from railguard.catalog.trajectory import OVER, SCHEDULE, UNDER, _STATUS
from railguard.session import scratch_path
from railguard.streaming.guard_stream import (
    certificate_stream, closing_markers, guard_stream, latest_totals, run_available,
)


#: Slices in time in which the events arrive, each one in as many files as there are shuffle partitions.
ARRIVALS = 4


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as they arrive: a micro-batch per slice in time, state carried over all of them.

    A unit's records of a slice are in one file, so batches that end inside a slice keep order.
    """
    events = table(spark, d, "events")
    source = scratch_path(spark, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    done = F.timestamp_diff("MICROSECOND", F.lit(first), F.col("ts"))
    whole = F.timestamp_diff("MICROSECOND", F.lit(first), F.lit(last)) + 1
    part = F.coalesce((done * ARRIVALS / whole).cast("int"), F.lit(0))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n in range(ARRIVALS):
        arrived = events.filter(part == n).repartition(files, "event_type", "user_id")
        arrived.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
    return ledger_columns(stream.parquet(source))


def published(spark: SparkSession, d: str, **kw) -> DataFrame:
    options = {"alpha": ALPHA, "budget": BUDGET} | kw
    stream = guard_stream(event_stream(spark, d), **options)
    return run_available(stream, scratch_path(spark, "stream"), scratch_path(spark, "state"))


@query(
    "R1_streaming_guard",
    with_guarded(" SELECT domain, unit, ordinal, protected_state, guarded, 'published' AS status FROM gd"),
)
def r1(spark, d):
    return published(spark, d).select(
        "domain", "unit", "ordinal", "protected_state", "guarded", "status"
    )


@query(
    "R2_commissioning_state",
    with_ledger(""", m AS (SELECT domain, unit, quantile_cont(raw_baseline, 0.5) AS ref FROM led WHERE rn <= 5 GROUP BY ALL)
 SELECT domain, unit, ordinal, rn AS rank, rn > 5 AS scored, CASE WHEN rn >= 5 THEN round(ref, 9) END AS reference FROM led JOIN m USING (domain, unit)"""),
)
def r2(spark, d):
    return published(spark, d).select(
        "domain", "unit", "ordinal", "rank", (F.col("rank") > 5).alias("scored"),
        F.round("reference", 9).alias("reference"),
    )


@query(
    "R3_late_records",
    with_ledger(""", a AS (SELECT domain, unit, max(order_key) AS last FROM led WHERE ordinal % 10 <> 3 GROUP BY ALL)
 SELECT domain, unit, ordinal, CASE WHEN ordinal % 10 = 3 AND last IS NOT NULL AND order_key <= last THEN 'late_rejected' ELSE 'published' END AS status
 FROM led LEFT JOIN a USING (domain, unit)"""),
)
def r3(spark, d):
    """A tenth of the records arrives after everything else; published rows stay as they are."""
    events = table(spark, d, "events")
    source, out, state = (scratch_path(spark, n) for n in ("arrivals", "late", "late-state"))
    late = F.col("event_id") % 10 == 3
    events.filter(~late).write.mode("append").parquet(source)
    stream = guard_stream(
        ledger_columns(spark.readStream.schema(events.schema).parquet(source)),
        alpha=ALPHA, budget=BUDGET,
    )
    run_available(stream, out, state)
    events.filter(late).write.mode("append").parquet(source)
    return run_available(stream, out, state).select("domain", "unit", "ordinal", "status")


@query(
    "R3_reorder_late",
    with_ledger(""", a AS (SELECT domain, unit, max(order_key) FILTER (ordinal % 10 <> 3) AS seen,
     max(order_key) AS newest FROM led GROUP BY ALL),
 l AS (SELECT led.*, a.seen, a.newest, max(order_key) FILTER (ordinal % 10 <> 3 AND order_key <= seen - 86400000000)
     OVER (PARTITION BY led.domain, led.unit) AS last FROM led JOIN a USING (domain, unit))
 SELECT domain, unit, ordinal, CASE WHEN order_key > newest - 86400000000 AND NOT coalesce(ordinal % 10 = 3 AND order_key <= last, false) THEN 'waiting'
   WHEN ordinal % 10 = 3 AND last IS NOT NULL AND order_key <= last THEN 'late_rejected' ELSE 'published' END AS status FROM l"""),
)
def r3_reorder(spark, d):
    """A tenth of the records arrives a batch late under a delay of a day: none is lost."""
    events = table(spark, d, "events")
    source, out, state = (scratch_path(spark, n) for n in ("arrivals", "reorder", "reorder-state"))
    late = F.col("event_id") % 10 == 3
    for part in (events.filter(~late), events.filter(late)):
        part.write.mode("append").parquet(source)
        stream = guard_stream(
            ledger_columns(spark.readStream.schema(events.schema).parquet(source)),
            alpha=ALPHA, budget=BUDGET, reorder_delay="1 day",
        )
        rows = run_available(stream, out, state).select("domain", "unit", "ordinal", "status")
    left = ledger_columns(events).select("domain", "unit", "ordinal").join(rows, ["domain", "unit", "ordinal"], "left")
    return left.withColumn("status", F.coalesce("status", F.lit("waiting")))


@query(
    "R3_reorder_flush",
    with_ledger(""", a AS (SELECT domain, unit, max(order_key) FILTER (ordinal % 10 <> 3) AS seen FROM led GROUP BY ALL),
 l AS (SELECT led.*, max(order_key) FILTER (ordinal % 10 <> 3 AND order_key <= seen - 86400000000)
     OVER (PARTITION BY led.domain, led.unit) AS last FROM led JOIN a USING (domain, unit))
 SELECT domain, unit, ordinal, CASE WHEN ordinal % 10 = 3 AND order_key <= last THEN 'late_rejected' ELSE 'published' END AS status FROM l"""),
)
def r3_flush(spark, d):
    """Late arrivals under a delay of a day, then a marker for every unit: rows in are rows out."""
    events = ledger_columns(table(spark, d, "events")).withColumn("closing", F.lit(False))
    source, out, state = (scratch_path(spark, n) for n in ("arrivals", "flush", "flush-state"))
    late = F.col("ordinal") % 10 == 3
    for part in (events.filter(~late), events.filter(late), closing_markers(events)):
        part.write.mode("append").parquet(source)
        stream = guard_stream(
            spark.readStream.schema(events.schema).parquet(source),
            alpha=ALPHA, budget=BUDGET, reorder_delay="1 day", closing="closing",
        )
        rows = run_available(stream, out, state)
    return rows.select("domain", "unit", "ordinal", "status")


@query(
    "R4_fail_closed_schedule",
    with_guarded(_STATUS + """
 SELECT domain, unit, ordinal, CASE WHEN failed = 0 THEN 'published'
   WHEN rn = min(rn) FILTER (failed = 1) OVER (PARTITION BY domain, unit) THEN 'infeasible' ELSE 'halted' END AS status,
   CASE WHEN failed = 0 THEN p END AS guarded FROM r"""),
)
def r4(spark, d):
    rows = published(
        spark, d, budget=F.expr(SCHEDULE), under_cost=F.expr(UNDER), over_cost=F.expr(OVER)
    )
    return rows.select("domain", "unit", "ordinal", "status", "guarded")


@query(
    "R5_stream_batch_parity",
    with_ledger(" SELECT domain, count(*) AS records, 0e0 AS maximum_difference FROM led GROUP BY domain"),
)
def r5(spark, d):
    keys = ["domain", "unit", "ordinal"]
    stream = published(spark, d).select(*keys, F.col("protected_state").alias("b"), F.col("guarded").alias("p"))
    batch = guarded(spark, d).frame.select(*keys, "protected_state", "guarded")
    gap = F.greatest(
        F.abs(F.col("b") - F.col("protected_state")), F.abs(F.col("p") - F.col("guarded"))
    )
    return batch.join(stream, keys).groupBy("domain").agg(
        F.count(F.lit(1)).alias("records"), F.max(gap).alias("maximum_difference")
    )


@query(
    "R6_online_certificate",
    with_guarded(""" SELECT domain, count(*) AS published, max(abs(guarded - protected_state)) AS maximum_displacement,
      0::BIGINT AS late_rejected, 0::BIGINT AS infeasible FROM gd GROUP BY domain"""),
)
def r6(spark, d):
    path = scratch_path(spark, "stream")
    stream = guard_stream(event_stream(spark, d), alpha=ALPHA, budget=BUDGET)
    table_ = run_available(stream, path, scratch_path(spark, "state"))
    return latest_totals(certificate_stream(spark.readStream.schema(table_.schema).parquet(path)))
