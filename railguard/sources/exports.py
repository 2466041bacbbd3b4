"""Instrument text exports: header discovery, charge-side and label-side projections.

Files are read line by line, so one large file is split over many tasks; a file's
header is a single row that is joined back to its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from railguard.operators.contracts import enforce

# What a header line looks like and the normalised names it must contain.
HEADER_START = "~Time"
HEADER_MARK = "Cyc-Count"
ROLES = {"time": "timeh", "voltage": "uv", "current": "ia", "cumulative": "ahah", "cycle": "cyccount"}
CLOCK = r"^(\d+):(\d{1,2}):(\d{1,2}(?:[.,]\d+)?)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files with their place: (file, block start, line within the split)."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    # Bytes that are not UTF-8 are Latin-1 in these files (micro and degree signs).
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return raw.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(latin))


def normalise_header(name: Column) -> Column:
    """Lower case, micro sign to u, everything but letters and digits removed."""
    text = F.translate(F.lower(F.trim(name)), "µμ", "uu")
    return F.regexp_replace(text, "[^a-z0-9]+", "")


def delimiter_of(line: Column) -> Column:
    return (
        F.when(F.contains(line, F.lit(",")), ",")
        .when(F.contains(line, F.lit("\t")), "\t")
        .when(F.contains(line, F.lit(";")), ";")
        .otherwise("whitespace")
    )


def split_fields(line: Column, delimiter: Column) -> Column:
    by_char = F.transform(F.split(line, delimiter), lambda x: F.trim(x))
    return F.when(delimiter == "whitespace", F.split(F.trim(line), r"\s+")).otherwise(by_char)


def header_candidates(lines: DataFrame) -> DataFrame:
    """Every line that looks like a header, with delimiter and normalised field names."""
    found = lines.filter(
        F.startswith("value", F.lit(HEADER_START)) & F.contains("value", F.lit(HEADER_MARK))
    )
    # Candidates are a few lines per file.  Regrouping them by place keeps the tests on
    # field names, which are costly, from being pushed down onto every line of every file.
    place = [c for c in lines.columns if c != "value"]
    found = found.groupBy(*place).agg(F.first("value").alias("value"))
    found = found.withColumn("delimiter", delimiter_of(F.col("value")))
    return found.withColumn(
        "fields",
        F.transform(split_fields(F.col("value"), F.col("delimiter")), normalise_header),
    )


def headers(lines: DataFrame) -> DataFrame:
    """The single admissible header of each file with the 1-based place of every role."""
    candidates = header_candidates(lines)
    complete = F.lit(True)
    for name in ROLES.values():
        complete = complete & (F.size(F.filter("fields", lambda f: f == name)) == 1)
    return candidates.filter(complete).select(
        "file", "delimiter", "fields", F.size("fields").alias("width"),
        *[F.array_position("fields", n).cast("int").alias(f"at_{r}") for r, n in ROLES.items()],
    )


def header_violations(lines: DataFrame) -> DataFrame:
    """Files without exactly one admissible header."""
    files = lines.select("file").distinct()
    counts = headers(lines).groupBy("file").agg(F.count(F.lit(1)).alias("headers"))
    return (
        files.join(counts, "file", "left")
        .withColumn("headers", F.coalesce("headers", F.lit(0)))
        .filter(F.col("headers") != 1)
    )


def _project(lines: DataFrame, roles: list[str], check: bool) -> DataFrame:
    if check:
        enforce(header_violations(lines), "one header per file")
    data = lines.filter(~F.startswith("value", F.lit("~")) & (F.trim("value") != ""))
    joined = data.join(headers(lines), "file")
    parts = joined.withColumn("_f", split_fields(F.col("value"), F.col("delimiter")))
    # Rows with surplus fields are skipped, short rows are padded with NULL.
    parts = parts.filter(F.size("_f") <= F.col("width"))
    keep = [c for c in lines.columns if c != "value"]
    return parts.select(
        *keep, *[F.get("_f", F.col(f"at_{r}") - 1).alias(f"{r}_raw") for r in roles]
    )


def prediction_fields(lines: DataFrame, check: bool = True) -> DataFrame:
    """Charge-side columns only; the outcome counter is never projected."""
    return _project(lines, ["cycle", "time", "current", "voltage"], check)


def label_fields(lines: DataFrame, check: bool = True) -> DataFrame:
    """Label-side columns of the same files, released after predictions are frozen."""
    return _project(lines, ["cycle", "current", "cumulative"], check)


def number(text: str | Column) -> Column:
    """Decimal text with point or comma; NULL when it is not a number."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.trim(column), ",", ".").try_cast("double")


def clock_seconds(text: str | Column) -> Column:
    """``h:m:s`` text to seconds; NULL when it does not match."""
    column = F.trim(F.col(text) if isinstance(text, str) else text)
    part = lambda i: number(F.regexp_extract(column, CLOCK, i))
    return F.when(
        F.rlike(column, F.lit(CLOCK)), part(1) * 3600.0 + part(2) * 60.0 + part(3)
    )


def with_seconds(df: DataFrame, time_raw: str = "time_raw", out: str = "seconds") -> DataFrame:
    """Hours as decimal text, or clock text in files where under 95% of times are numeric."""
    numeric = number(time_raw)
    share = df.groupBy("file").agg(F.avg(numeric.isNotNull().cast("double")).alias("_share"))
    value = F.when(F.col("_share") >= 0.95, numeric * 3600.0).otherwise(clock_seconds(time_raw))
    return df.join(share, "file").withColumn(out, value).drop("_share")


def header_inventory(lines: DataFrame) -> DataFrame:
    """Structural signature of every header and the number of files that share it.

    A file without a header stops the inventory: it would otherwise be left out silently.
    """
    candidates = header_candidates(lines)
    without = lines.select("file").distinct().join(candidates.select("file").distinct(), "file", "left_anti")
    enforce(without, "files without a header")
    signature = F.sha2(F.to_json(F.struct("delimiter", "fields")), 256)
    return candidates.groupBy(signature.alias("signature")).agg(
        F.countDistinct("file").alias("files"),
        F.min("file").alias("first_file"),
        F.max(F.size("fields")).alias("fields"),
    )


def confirmation_roster(files: DataFrame, development: DataFrame, key: str = "file") -> DataFrame:
    """All files except those already used for development."""
    return files.join(development.select(key), key, "left_anti")
