"""The named queries: functions of (spark, sf_dir), with the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r4(c: Column) -> Column:
    """Rounded to four places; adding zero clears the sign of zero. In SQL: round(x, 4) + 0."""
    return F.round(c, 4) + F.lit(0.0)
