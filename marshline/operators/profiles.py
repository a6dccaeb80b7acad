"""Per-cell profiles of the cell-by-dekad table.

Each feature family is a list of aggregate expressions, so any combination runs
as one pass. A cell has at most one row per dekad, which bounds every per-cell
state, exact medians included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marshline import constants as K
from marshline.operators.selection import percentile_name, percentile_struct

CELL = ["ix", "iy"]


def _in_season(names: list[str]) -> Column:
    return F.col("bird_season").isin(names)


def _days(date: Column) -> Column:
    return F.datediff(date, F.lit("2020-01-01").cast("date")).cast("double")


def stat_exprs(cols: list[str], median: bool = True) -> list[Column]:
    out = []
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
        if median:
            out.append(F.median(c).alias(f"{c}_median"))
    return out


def season_exprs(cols: list[str]) -> list[Column]:
    return [F.avg(F.when(F.col("bird_season") == s, F.col(c))).alias(f"{c}_{s}")
            for s in K.SEASONS for c in cols]


def slope_expr(col: str, date: str, min_points: int, per_days: float) -> Column:
    """Least-squares slope over days, scaled; missing for short or flat series."""
    t = _days(F.col(date))
    enough = (F.count("*") >= min_points) & (F.count(col) >= min_points) & (F.max(t) > F.min(t))
    return F.when(enough, F.regr_slope(F.col(col), t) * F.lit(per_days)).alias(f"{col}_trend")


def trend_exprs(cols: list[str] = K.TREND_INDICES, date: str = "dekad") -> list[Column]:
    return [slope_expr(c, date, 6, K.DAYS_PER_YEAR) for c in cols]


def daily_trend_exprs(cols: list[str] = K.DAILY_TREND_INDICES, date: str = "time") -> list[Column]:
    return [slope_expr(c, date, 3, 1.0) for c in cols]


def flood_expr() -> Column:
    return F.avg("water_mask").alias("flood_frequency")


def hydroperiod_expr() -> Column:
    return F.stddev_samp("NDWI").alias("hydroperiod_variability")


def amplitude_exprs(cols: list[str] = K.AMPLITUDE_INDICES) -> list[Column]:
    return [
        (F.avg(F.when(_in_season(K.GROWING), F.col(c)))
         - F.avg(F.when(_in_season(K.DORMANT), F.col(c)))).alias(f"{c}_seasonal_amplitude")
        for c in cols
    ]


def bird_exprs(cols: list[str] = K.BIRD_METRICS) -> list[Column]:
    out = []
    for c in cols:
        out += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum")]
    return out + [(F.sum("n_observations") > 0).cast("int").alias("has_bird_data")]


def order_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("n_") and c not in K.BIRD_METRICS]


def order_exprs(cols: list[str]) -> list[Column]:
    return [F.sum(c).alias(f"{c}_total") for c in cols]


def index_stats(df: DataFrame, cols: list[str] = K.INDICES, keys: list[str] = CELL) -> DataFrame:
    """mean, std, min, max and median of each index per cell."""
    return df.groupBy(*keys).agg(*stat_exprs(cols))


def seasonal_means(df: DataFrame, cols: list[str] = K.INDICES, keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(*season_exprs(cols))


def interannual_std(df: DataFrame, cols: list[str] = K.INDICES, keys: list[str] = CELL) -> DataFrame:
    """Standard deviation across yearly means."""
    yearly = df.groupBy(*keys, "year").agg(*[F.avg(c).alias(c) for c in cols])
    return yearly.groupBy(*keys).agg(*[F.stddev_samp(c).alias(f"{c}_interannual_std") for c in cols])


def trend_slope(df: DataFrame, cols: list[str] = K.TREND_INDICES, keys: list[str] = CELL) -> DataFrame:
    """Change per year of each index; needs six points."""
    return df.groupBy(*keys).agg(*trend_exprs(cols))


def trend_slope_daily(df: DataFrame, cols: list[str] = K.DAILY_TREND_INDICES, keys: list[str] = CELL,
                      date: str = "time") -> DataFrame:
    """Change per day of each index; needs three points."""
    return df.groupBy(*keys).agg(*daily_trend_exprs(cols, date))


def flood_frequency(df: DataFrame, keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(flood_expr())


def hydroperiod_variability(df: DataFrame, keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(hydroperiod_expr())


def seasonal_amplitude(df: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Growing-season mean minus dormant-season mean."""
    return df.groupBy(*keys).agg(*amplitude_exprs())


def bird_summary(df: DataFrame, keys: list[str] = CELL) -> DataFrame:
    return df.groupBy(*keys).agg(*bird_exprs())


def order_totals(df: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Sum of each order column per cell."""
    return df.groupBy(*keys).agg(*order_exprs(order_columns(df)))


def raw_profiles(df: DataFrame, keys: list[str] = CELL, indices: list[str] = K.INDICES) -> DataFrame:
    """Every profile feature, missing values left as they are.

    One conditional aggregation plus the yearly one, joined on the cell they
    are both partitioned by. ``df`` should be a stored table, since both read it.
    """
    exprs = (stat_exprs(indices) + season_exprs(indices) + trend_exprs() + [flood_expr(), hydroperiod_expr()]
             + amplitude_exprs())
    if set(K.BIRD_METRICS) <= set(df.columns):
        exprs += bird_exprs() + order_exprs(order_columns(df))
    return df.groupBy(*keys).agg(*exprs).join(interannual_std(df, indices, keys), keys)


def value_counts(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Non-missing values per column plus ``_rows``: one small eager aggregate."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in cols]).first()
    return row.asDict()


def drop_empty_columns(df: DataFrame, keep: list[str] = CELL) -> DataFrame:
    """Remove columns that hold no value at all."""
    cols = [c for c in df.columns if c not in keep]
    counts = value_counts(df, cols)
    return df.select(*[c for c in df.columns if c in keep or counts[c] > 0])


def impute_column_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replace missing values by the exact median of their column."""
    if not cols:
        return df
    medians = percentile_struct(df, cols, [0.5])
    with_q = df.withColumn("_q", medians)
    return with_q.withColumns(
        {c: F.coalesce(F.col(c), F.col("_q")[percentile_name(c, 0.5)]) for c in cols}
    ).drop("_q")


def finish_profiles(raw: DataFrame, keep: list[str] = (*CELL, "has_bird_data")) -> DataFrame:
    """Drop empty columns and impute the gaps of a stored ``raw_profiles``.

    One eager count decides which columns need work; most have no gaps.
    """
    cols = [c for c in raw.columns if c not in keep]
    counts = value_counts(raw, cols)
    rows = counts["_rows"]
    full = raw.select(*[c for c in raw.columns if c in keep or counts[c] > 0])
    return impute_column_median(full, [c for c in cols if 0 < counts[c] < rows])


def cell_summary(df: DataFrame, keys: list[str] = CELL, date: str = "time", by_source: bool = False,
                 cols: list[str] = K.INDICES) -> DataFrame:
    """Summary of a long time series per cell (and source file, if asked).

    Statistics without medians, seasonal means, per-day trends, flooding.
    """
    groups = [*keys, "source_tile"] if by_source else list(keys)
    bands = [c for c in K.BANDS if c in df.columns]
    return df.groupBy(*groups).agg(
        *stat_exprs([*cols, *bands], median=False), *season_exprs([*cols, *bands]),
        *daily_trend_exprs(date=date), flood_expr(), hydroperiod_expr())


def dataset_summary(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Size, extent and bird coverage of a cell-by-dekad table.

    Distinct cells and dates are counted from the distinct set of each, which
    aggregates map-side.
    """
    exprs = [
        F.count("*").alias("n_rows"),
        F.count_distinct("ix", "iy").alias("n_cells"),
        F.count_distinct("dekad").alias("n_dates"),
        F.min("dekad").alias("first_date"), F.max("dekad").alias("last_date"),
        (100.0 * F.avg((F.col("n_observations") > 0).cast("double"))).alias("pct_with_birds"),
    ]
    return df.groupBy(*keys).agg(*exprs) if keys else df.agg(*exprs)
