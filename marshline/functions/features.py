"""Model features derived from the spectral indices."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from marshline import constants as K
from marshline.functions.casting import nonfinite_to_zero
from marshline.functions.dates import cycle, month_cycle


def interaction_columns() -> dict[str, Column]:
    """Products, ratios and squares of the index columns."""
    c = F.col
    out = {name: c(a) * c(b) for name, (a, b) in K.INTERACTIONS.items()}
    out |= {name: c(a) / (F.abs(c(b)) + K.RATIO_OFFSET) for name, (a, b) in K.RATIOS.items()}
    out |= {name: c(a) * c(a) for name, a in K.SQUARES.items()}
    return out


def interaction_features(df: DataFrame) -> DataFrame:
    return df.withColumns(interaction_columns())


def align_features(df: DataFrame, names: list[str], keep: list[str] = ()) -> DataFrame:
    """``keep`` columns, then ``names`` in order; absent features become 0.0."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(n) if n in have else F.lit(0.0).alias(n) for n in names])


def training_features(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """All model features of cell-dekad rows; missing and infinite become 0."""
    wide = interaction_features(df).withColumns(month_cycle(F.col("month")))
    return align_features(wide, K.MODEL_FEATURES, keep).withColumns(
        {n: nonfinite_to_zero(F.col(n)) for n in K.MODEL_FEATURES}
    )


def scoring_features(df: DataFrame, date: dt.date | Column, keep: list[str] = (),
                     names: list[str] = K.MODEL_FEATURES, doy_period: float = 365.0) -> DataFrame:
    """The same features for cells seen on one acquisition date."""
    day = F.lit(date) if isinstance(date, dt.date) else date
    sin, cos = cycle(F.dayofyear(day), doy_period)
    wide = interaction_features(df).withColumns(
        {**month_cycle(F.month(day)), "doy_sin": sin, "doy_cos": cos}
    )
    return align_features(wide, names, keep).withColumns(
        {n: nonfinite_to_zero(F.col(n)) for n in names}
    )
