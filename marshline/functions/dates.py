"""Calendar expressions: dekads, bird seasons and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from marshline import constants as K


def assign_dekad(date: Column) -> Column:
    """First day (1, 11 or 21) of the ten-day period a date falls in."""
    day = F.dayofmonth(date)
    start = F.when(day <= 10, 1).when(day <= 20, 11).otherwise(21)
    return F.make_date(F.year(date), F.month(date), start)


def bird_season(month: Column) -> Column:
    expr = None
    for name, months in K.SEASON_MONTHS.items():
        hit = month.isin(months)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("unknown")


def cycle(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value's position within ``period``."""
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def temporal_columns(date: Column, doy_period: float = K.DAYS_PER_YEAR) -> dict[str, Column]:
    """year, month, day_of_year, bird_season, doy_sin and doy_cos of a date."""
    sin, cos = cycle(F.dayofyear(date), doy_period)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "day_of_year": F.dayofyear(date),
        "bird_season": bird_season(F.month(date)),
        "doy_sin": sin,
        "doy_cos": cos,
    }


def month_cycle(month: Column) -> dict[str, Column]:
    sin, cos = cycle(month, 12)
    return {"month_sin": sin, "month_cos": cos}
