"""Registry of analyses and their SQL counterparts."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadfield.shipping import attach

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` and the SQL that gives the same rows."""

    def add(fn):
        @wraps(fn)
        def run(spark, folder):
            attach(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def rounded(c, digits: int = 6) -> Column:
    """Rounded, with -0.0 cleared."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
