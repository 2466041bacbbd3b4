"""Sinks with checks: Parquet with a row-count check, CSV metrics, JSON reports, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from railguard.operators.contracts import ContractViolation


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> int:
    """Write once, refuse to overwrite, and check the row count after the write.

    The expected count is observed during the write itself, so nothing runs twice.  The
    commit protocol makes the folder appear only when all tasks have finished.
    """
    seen = Observation("written")
    writer = (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("errorifexists")
        .option("compression", "zstd")
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    expected = seen.get["rows"]
    found = df.sparkSession.read.parquet(path).count()
    if found != expected:
        raise ContractViolation(f"{path}: wrote {expected} rows, found {found}")
    return found


def write_ledger(predictions: DataFrame, metrics: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Prediction ledger as Parquet, metric tables as CSV with header."""
    counts = {"predictions": write_parquet(predictions, f"{path}/predictions")}
    for name, table in metrics.items():
        table.write.mode("errorifexists").option("header", True).csv(f"{path}/{name}")
        counts[name] = table.sparkSession.read.option("header", True).csv(f"{path}/{name}").count()
    return counts


def report(parts: dict[str, Column], source: DataFrame) -> DataFrame:
    """One-row nested report as JSON text with its hash (``source`` has one row)."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))
    return source.select(body.alias("report")).withColumn("sha256", F.sha2("report", 256))


def duplicate_payloads(df: DataFrame, key: str, content: str) -> DataFrame:
    """Payloads stored more than once: hash, copies and the smallest key.

    Only the hash is shuffled, never the payload, and copies are counted map-side.
    """
    hashed = df.select(key, F.sha2(F.col(content), 256).alias("sha256"))
    return (
        hashed.groupBy("sha256")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .filter(F.col("copies") > 1)
    )


#: Hexadecimal digits of a row's SHA-256 that one summed lane takes.
_LANE = 15


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, schema, lane1..lane4) that names the multiset of rows, in any order or layout.

    Each row's SHA-256 is cut into four lanes of 60 bits, which are added up; repeated rows
    count as often as they occur.
    """
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    lanes = [
        F.sum(F.conv(F.substring("_h", 1 + _LANE * i, _LANE), 16, 10).cast("decimal(38,0)")).alias(f"lane{i + 1}")
        for i in range(4)
    ]
    kinds = ", ".join(f"{c} {k}" for c, k in sorted(df.dtypes))
    return df.select(F.sha2(body, 256).alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(kinds).alias("schema"), *[F.coalesce(x, F.lit(0)).alias(f"lane{i + 1}") for i, x in enumerate(lanes)]
    )


def seal(df: DataFrame, path: str) -> int:
    """Write ``df`` once and keep the fingerprint of what was written beside it."""
    rows = write_parquet(df, f"{path}/table")
    written = df.sparkSession.read.parquet(f"{path}/table")
    fingerprint(written).write.mode("errorifexists").parquet(f"{path}/seal")
    return rows


def open_sealed(spark: SparkSession, path: str) -> DataFrame:
    """The sealed table, after its fingerprint was computed anew and found equal.

    Anything that reads labels comes after this: a table that was changed, added to or cut
    since it was sealed stops the job.
    """
    table = spark.read.parquet(f"{path}/table")
    kept, found = spark.read.parquet(f"{path}/seal").collect(), fingerprint(table).collect()
    if kept != found:
        raise ContractViolation(f"{path}: the table is not the one that was sealed")
    return table


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, length and SHA-256 of every file below ``path``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest_difference(saved: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Entries that are missing, untracked or changed against a saved manifest."""
    a = saved.select(key, F.col("sha256").alias("_saved"))
    b = current.select(key, F.col("sha256").alias("_now"))
    status = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("_saved").isNull(), "untracked")
        .when(F.col("_saved") != F.col("_now"), "changed")
    )
    return (
        a.join(b, key, "full_outer")
        .withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select(key, "status")
    )
