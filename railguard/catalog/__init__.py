"""Registered queries: the library's operators on the driver tables, with DuckDB equivalents."""

from railguard.catalog.base import ORACLES, QUERIES
from railguard.catalog import (  # noqa: F401  (importing a module registers its queries)
    curves,
    evaluation,
    inference,
    learning,
    nested,
    relational,
    streams,
    trajectory,
    windows,
    workflows,
)

__all__ = ["ORACLES", "QUERIES"]
