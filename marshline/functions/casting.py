"""Tolerant casts: what cannot be read becomes missing, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Tried after ISO dates and timestamps, which cast directly.
DATE_FORMATS = ["yyyy/MM/dd", "MM/dd/yyyy"]


def nan_to_null(col: Column) -> Column:
    """NaN to NULL; every source applies this so only NULL means missing."""
    return F.when(~F.isnan(col), col)


def coerce_numeric(col: Column) -> Column:
    # Unlike a condition, nanvl names the number once, so the text is read once.
    return F.nanvl(F.trim(col.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def coerce_date(col: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """The date of the first format that parses, else NULL.

    A format that fails costs an exception, 100 times a cast, so one with slashes
    (outside optional parts) is tried on texts with a slash only.
    """
    text = F.trim(col.cast("string"))

    def tried(f: str) -> Column:
        parsed = F.try_to_timestamp(text, F.lit(f)).cast("date")
        return F.when(text.contains("/"), parsed) if "/" in f and "[" not in f else parsed

    return F.coalesce(text.try_cast("date"), *[tried(f) for f in formats])


def coerce_count(col: Column | None) -> Column:
    """Integer count; anything unreadable, and an absent column, counts as one."""
    if col is None:
        return F.lit(1).cast("long")
    return F.coalesce(coerce_numeric(col).cast("long"), F.lit(1).cast("long"))


def read_once(df: DataFrame, *cols: str) -> DataFrame:
    """The same rows with ``cols`` (last) worked out once a row.

    A filter on a plain column is pushed below it, which works its expression out
    again for every test; a filter on generated columns stays above them.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*rest, F.stack(F.lit(1), *[F.col(c) for c in cols]).alias(*cols))


def nonfinite_to_zero(col: Column) -> Column:
    """NULL, NaN and infinities to 0.0."""
    bad = col.isNull() | F.isnan(col) | (F.abs(col) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(col)
