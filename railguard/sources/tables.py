"""Table sources: Parquet, CSV and JSON scans with contracts, unions and caches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from railguard.operators.contracts import ContractViolation, enforce, require_columns, shared_units
from railguard.operators.layout import Keys


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan of exactly these columns; a missing one fails before any job."""
    return require_columns(spark.read.parquet(path), columns)


def with_roles(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Project source columns onto role names (role -> source column)."""
    missing = sorted(set(roles.values()) - set(df.columns))
    if missing:
        raise ContractViolation(f"missing columns {missing}")
    return df.select(*[F.col(source).alias(role) for role, source in roles.items()])


def union_sources(
    sources: Mapping[str, DataFrame], columns: list[str], keys: Keys = Keys(), check: bool = True
) -> DataFrame:
    """Union of several tables under one contract: same columns, no unit in two domains."""
    parts = [require_columns(df, columns) for df in sources.values()]
    out = reduce(DataFrame.unionByName, parts)
    if check:
        enforce(shared_units(out, keys), "units shared between domains")
    return out


def read_datasets(
    spark: SparkSession, paths: Mapping[str, str], columns: list[str], domain: str = "domain"
) -> DataFrame:
    """One Parquet path per domain; the domain column must equal the declared name."""
    parts = []
    for name, path in paths.items():
        df = read_columns(spark, path, columns)
        named = F.when(F.col(domain) == name, F.col(domain)).otherwise(
            F.raise_error(F.concat(F.lit(f"expected domain {name}, found "), F.col(domain)))
        )
        parts.append(df.withColumn(domain, named))
    return reduce(DataFrame.unionByName, parts)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed CSV scan: declared schema, header checked, malformed rows fail the job."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_json(
    spark: SparkSession, path: str, schema: StructType | str, *, lines: bool = False
) -> DataFrame:
    """Strict JSON: declared schema, NaN and Infinity rejected; a document per file or per line."""
    return (
        spark.read.schema(schema)
        .option("multiLine", not lines)
        .option("mode", "FAILFAST")
        .option("allowNonNumericNumbers", False)
        .json(path)
    )


def write_pair_cache(df: DataFrame, path: str) -> None:
    """Predictions keyed by the excluded pair, one directory per pair for pruned reads."""
    (
        df.repartition("excluded_a", "excluded_b", F.pmod(F.xxhash64("unit"), F.lit(64)))
        .write.mode("errorifexists")
        .partitionBy("excluded_a", "excluded_b")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_pair_cache(spark: SparkSession, path: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Validated read of a pair cache: required columns, unique keys, finite predictions."""
    from railguard.operators.contracts import duplicate_keys, not_finite

    cached = require_columns(spark.read.parquet(path), columns)
    enforce(duplicate_keys(cached, keys), "cache keys")
    numeric = [c for c, kind in cached.dtypes if kind == "double"]
    enforce(not_finite(cached, numeric), "cache values")
    return cached
