"""Nested unit objects: one row per unit with an array of cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from railguard.operators.contracts import ContractViolation, enforce, duplicate_keys

# Measurement arrays every cycle must carry.
CYCLE_ARRAYS = [
    "current_in_A", "voltage_in_V", "charge_capacity_in_Ah", "discharge_capacity_in_Ah",
    "time_in_s", "temperature_in_C", "internal_resistance_in_ohm",
]
UNIT_SCHEMA = (
    "cell_id string, nominal_capacity_in_Ah double, charge_protocol array<struct<rate_in_C:string>>, "
    "discharge_protocol array<struct<rate_in_C:string>>, SOC_interval array<double>, "
    "cycle_data array<struct<cycle_number:int, "
    + ", ".join(f"{a}:array<double>" for a in CYCLE_ARRAYS)
    + ">>"
)


def read_units(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Nested units from Parquet or JSON lines under the declared schema.

    Objects in language-specific binary formats are converted outside; loading them would
    execute code from the file.
    """
    reader = spark.read.schema(UNIT_SCHEMA)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    units = reader.format(fmt).load(path)
    enforce(duplicate_keys(units.select("cell_id"), ["cell_id"]), "duplicate units")
    return units


def explode_cycles(units: DataFrame, keep: list[str], cycles: str = "cycle_data") -> DataFrame:
    """One typed row per cycle; ``cycle_index`` is the recorded position (0-based)."""
    fields = units.schema[cycles].dataType.elementType.fieldNames()
    out = units.select(*keep, F.posexplode(cycles).alias("cycle_index", "_c"))
    clash = set(keep) & set(fields)
    if clash:
        raise ContractViolation(f"columns in unit and cycle {sorted(clash)}")
    return out.select(*keep, "cycle_index", *[F.col(f"_c.{f}").alias(f) for f in fields])


def time_vector_key(vector: str | Column, source: str, index: str) -> Column:
    """Sort key of a cycle: calendar 6-vector first, otherwise recorded position.

    Cycles with a complete finite time sort before those without.
    """
    v = F.col(vector) if isinstance(vector, str) else vector
    six = F.slice(v, 1, 6)
    bad = F.exists(six, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = F.coalesce((F.size(v) >= 6) & ~bad, F.lit(False))
    parts = [F.when(known, F.get(six, F.lit(i))).otherwise(0.0).alias(f"t{i}") for i in range(6)]
    return F.struct(
        F.when(known, 0).otherwise(1).alias("missing"), *parts,
        F.col(source).alias("source"), F.col(index).alias("index"),
    )
