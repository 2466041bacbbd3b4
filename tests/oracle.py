"""Run a registered query on Spark and its SQL on DuckDB and compare the results."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return sorted((str(k), _plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([_plain(r[n]) for n in names]) for r in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [repr([_plain(r[i]) for i in order]) for r in result.fetchall()]
    return sorted(names), sorted(rows)


def difference(df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    names, rows = spark_rows(df)
    other_names, other = duck_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if len(rows) != len(other):
        return f"{len(rows)} rows != {len(other)} rows"
    for a, b in zip(rows, other):
        if a != b:
            return f"{a} != {b}"
    return None
