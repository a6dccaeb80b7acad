"""Named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, data folder) under ``name``."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def nudge(digits: int) -> float:
    """Offset that moves exact rounding ties off the tie in both engines."""
    return 1.3 * 10.0 ** -(digits + 3)


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Rounded value without negative zero, so both engines print it alike."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(nudge(digits)), digits) + F.lit(0.0)


def tidy(df: DataFrame, keep: list[str], nums: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[rounded(c, digits).alias(c) for c in nums])
