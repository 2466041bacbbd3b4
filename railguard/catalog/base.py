"""Registry of queries and the driver tables in their trajectory roles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from railguard.operators.guard import guard
from railguard.operators.layout import Keys, Trajectories

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB equivalent."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events in trajectory roles --------------------------------------------------------

# Time in days since the first of January 2024, exact in both engines.
_DAY = "{us} / 86400000000e0"

_TRUTH = "1.0e0 - 0.006e0 * day - value / 2000e0"
_BASELINE = "1.02e0 - 0.006e0 * day - value / 900e0 + ((event_id * 7919) % 101) / 1010e0"
_CANDIDATE = "1.01e0 - 0.006e0 * day - value / 1500e0 + ((event_id * 104729) % 89) / 1780e0"

ALPHA = 0.3
BUDGET = 0.02
SHIFT = 0.01
METHODS = ["protected_state", "fixed_shift", "guarded", "raw_candidate"]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction ledger on ``events``: domain = event type, unit = user within the type."""
    return ledger_columns(table(spark, sf_dir, "events"))


def ledger_columns(events: DataFrame) -> DataFrame:
    """Ledger columns of an events table or stream."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return (
        events.select("event_id", "user_id", "event_type", "value", micros.alias("us"))
        .withColumn("day", F.expr(_DAY.format(us="us")))
        .select(
            F.col("event_type").alias("domain"),
            F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("unit"),
            F.col("us").alias("order_key"),
            F.col("event_id").alias("ordinal"),
            F.expr(_TRUTH).alias("truth"),
            F.expr(_BASELINE).alias("raw_baseline"),
            F.expr(_CANDIDATE).alias("raw_candidate"),
        )
    )


LEDGER_SQL = f"""
led AS (
  SELECT *, row_number() OVER (PARTITION BY domain, unit ORDER BY order_key, ordinal) AS rn
  FROM (
    SELECT event_type AS domain, event_type || ':' || user_id::VARCHAR AS unit,
           us AS order_key, event_id AS ordinal,
           {_TRUTH} AS truth, {_BASELINE} AS raw_baseline, {_CANDIDATE} AS raw_candidate
    FROM (SELECT *, {_DAY.format(us='us')} AS day
          FROM (SELECT *, epoch_us(ts) - 1704067200000000 AS us FROM events))
  )
)"""


def state_sql(name: str, source: str, raw: str, alpha: str, keys: str = "domain, unit") -> str:
    """Recursive CTE for the protected state over ``source`` (which carries ``rn``)."""
    on = " AND ".join(f"l.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    return f"""
{name} AS (
  SELECT {keys}, rn, least(greatest({raw}, 0e0), 1.3e0) AS b FROM {source} WHERE rn = 1
  UNION ALL
  SELECT {picked}, l.rn,
         least(greatest(s.b + {alpha} * least(l.{raw} - s.b, 0e0), 0e0), 1.3e0)
  FROM {name} s JOIN {source} l ON {on} AND l.rn = s.rn + 1
)"""


def guarded_sql(
    name: str = "gd", source: str = "led", alpha: float = ALPHA, budget: float = BUDGET
) -> str:
    """State, guarded output and the fixed-shift control for every record of ``source``."""
    return f"""{state_sql(name + '_st', source, 'raw_baseline', f'{alpha}e0')},
{name} AS (
  SELECT l.*, s.b AS protected_state,
         least(greatest(s.b + {SHIFT}e0, 0e0), 1.3e0) AS fixed_shift,
         min(least(greatest(l.raw_candidate, greatest(0e0, s.b - {budget}e0)),
                   least(1.3e0, s.b + {budget}e0)))
           OVER (PARTITION BY l.domain, l.unit ORDER BY l.rn) AS guarded
  FROM {source} l JOIN {name}_st s USING (domain, unit, rn)
)"""


def with_guarded(sql: str, *extra: str) -> str:
    """Oracle text: the guarded ledger ``gd`` plus further CTEs, then ``sql``."""
    return "WITH RECURSIVE " + ",".join([LEDGER_SQL, guarded_sql(), *extra]) + sql


def with_ledger(sql: str, *extra: str) -> str:
    return "WITH RECURSIVE " + ",".join([LEDGER_SQL, *extra]) + sql


def trajectories(spark: SparkSession, sf_dir: str) -> Trajectories:
    return Trajectories.plan(ledger(spark, sf_dir), Keys())


def guarded(spark: SparkSession, sf_dir: str) -> Trajectories:
    """The guarded ledger every metric query starts from."""
    t = guard(trajectories(spark, sf_dir), alpha=ALPHA, budget=BUDGET)
    shift = F.least(F.greatest(F.col("protected_state") + SHIFT, F.lit(0.0)), F.lit(1.3))
    return t.with_frame(t.frame.withColumn("fixed_shift", shift))


# --- lineitem in trajectory roles ------------------------------------------------------

LINE_KEYS = Keys(
    order=("order_key", "l_orderkey", "l_linenumber", "l_partkey", "price", "quantity")
)


def supplier_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger on ``lineitem``: domain = region, unit = supplier (hundreds of records each)."""
    regions = (
        table(spark, sf_dir, "nation")
        .join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    # nation and region are fixed reference tables (25 and 5 rows); supplier is left to AQE.
    suppliers = table(spark, sf_dir, "supplier").join(
        F.broadcast(regions), F.expr("s_nationkey = n_nationkey")
    )
    lines = table(spark, sf_dir, "lineitem")
    days = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', l_shipdate)")
    return lines.join(suppliers, F.expr("l_suppkey = s_suppkey")).select(
        F.col("r_name").alias("domain"),
        F.col("l_suppkey").alias("unit"),
        days.cast("bigint").alias("order_key"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.expr(SUPPLIER_TRUTH).alias("truth"),
        F.expr(SUPPLIER_BASELINE).alias("raw_baseline"),
        F.expr(SUPPLIER_CANDIDATE).alias("raw_candidate"),
    )


SUPPLIER_TRUTH = "1.0e0 - l_quantity / 500e0"
SUPPLIER_BASELINE = "1.05e0 - l_extendedprice / 1000000e0 - (l_orderkey % 97) / 970e0"
SUPPLIER_CANDIDATE = "1.0e0 - l_discount * 2e0 - (l_partkey % 53) / 530e0"

SUPPLIER_SQL = f"""
sup AS (
  SELECT *, row_number() OVER (PARTITION BY domain, unit
    ORDER BY order_key, l_orderkey, l_linenumber, l_partkey, price, quantity) AS rn
  FROM (
    SELECT r_name AS domain, l_suppkey AS unit,
           date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS order_key,
           l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price,
           l_quantity AS quantity, {SUPPLIER_TRUTH} AS truth,
           {SUPPLIER_BASELINE} AS raw_baseline, {SUPPLIER_CANDIDATE} AS raw_candidate
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  )
)"""


def supplier_trajectories(spark: SparkSession, sf_dir: str) -> Trajectories:
    return Trajectories.plan(supplier_ledger(spark, sf_dir), LINE_KEYS)
