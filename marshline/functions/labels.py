"""Class labels and report sentences as Column expressions.

Reported numbers are rounded half to even before they are formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marshline import constants as K


def percent(col: Column) -> Column:
    """A value rounded half-even to a whole number, for ``%d`` slots."""
    return F.bround(col, 0).cast("long")


def ladder(value: Column, steps: list[tuple[float, str]], lowest: str, strict: bool) -> Column:
    """The label of the first step a value reaches (or exceeds, if strict)."""
    expr = None
    for edge, label in steps:
        hit = value > edge if strict else value >= edge
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(lowest)


def suitability_class(p: Column, water: Column) -> Column:
    """Serving class of a probability; mostly-water cells stand apart."""
    steps = [(lo, name) for name, lo, _ in K.PROBABILITY_BANDS[:-1]]
    land = ladder(p, steps, K.PROBABILITY_BANDS[-1][0], strict=False)
    return F.when(water > 0.5, K.OPEN_WATER).otherwise(land)


def probability_band(p: Column, top_closed: bool = True) -> Column:
    """Half-open band of a probability.

    ``top_closed=False`` leaves p = 1.0 without a band, as in a half-open top.
    """
    expr = None
    for i, (name, lo, hi) in enumerate(K.PROBABILITY_BANDS):
        upper = p <= hi if (i == 0 and top_closed) else p < hi
        hit = (p >= lo) & upper
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr


def describe_trend(slope: Column, name: str, horizon_years: int = 6) -> Column:
    """Sentence for a per-year slope; NULL slopes give ``No data``."""
    pct = percent(F.abs(slope * horizon_years) * 100)
    word = F.when(slope > 0, "increased").otherwise("declined")
    text = F.format_string(K.TREND_TEXT, F.lit(name), word, pct, F.lit(horizon_years))
    return (F.when(slope.isNull(), K.TREND_NO_DATA)
            .when(F.abs(slope) < K.TREND_EPS, K.TREND_STABLE).otherwise(text))


def notable_change(name: Column, slope: Column, horizon_years: int = 6) -> Column:
    pct = percent(F.abs(slope * horizon_years) * 100)
    word = F.when(slope > 0, "increasing").otherwise("decreasing")
    label = F.upper(F.replace(F.replace(name, F.lit("_trend"), F.lit("")), F.lit("_"), F.lit(" ")))
    text = F.format_string(K.NOTABLE_TEXT, label, word, pct, F.lit(horizon_years))
    return F.when(F.abs(slope) > K.TREND_EPS, text).otherwise(K.NOTABLE_NONE)


def diversity_level(h: Column) -> Column:
    return F.when(h.isNull(), K.DIVERSITY_NO_DATA).otherwise(
        ladder(h, K.DIVERSITY_LEVELS, K.DIVERSITY_LOWEST, strict=False)
    )


def coverage_text(pct: Column) -> Column:
    n = percent(pct)
    return (
        F.when(pct >= 20, F.format_string(K.COVERAGE_WELL, n))
        .when(pct >= 5, F.format_string(K.COVERAGE_MODERATE, n))
        .when(pct > 0, F.format_string(K.COVERAGE_SPARSE, n))
        .otherwise(K.COVERAGE_NONE)
    )


def condition_text(label: Column, pct: Column) -> Column:
    n = percent(pct)
    return (
        F.when(label == "degrading", F.format_string(K.CONDITION_TEXT["degrading"], n))
        .when(label == "improving", F.format_string(K.CONDITION_TEXT["improving"], n))
        .otherwise(F.format_string(K.CONDITION_TEXT["stable"], n))
    )


def score_summary_text(high: Column, moderate: Column, unsuitable: Column, mean_p: Column) -> Column:
    """Headline for an area from its class shares (percent) and mean probability."""
    return (
        F.when(high > 30, F.format_string(K.SCORE_STRONG, percent(high)))
        .when(high + moderate > 50, F.format_string(K.SCORE_MIXED, percent(high), percent(moderate)))
        .when(unsuitable > 70, F.format_string(K.SCORE_LIMITED, percent(unsuitable)))
        .otherwise(F.format_string(K.SCORE_MODERATE, percent(mean_p * 100)))
    )


def cluster_label(flood: Column, ndvi_mean: Column, ndvi_trend: Column) -> Column:
    """Readable archetype name from flooding, vegetation and greening."""
    zero = F.lit(0.0)
    water = ladder(F.coalesce(flood, zero), K.FLOOD_LABELS, K.FLOOD_LOWEST, strict=True)
    veg = ladder(F.coalesce(ndvi_mean, zero), K.VEGETATION_LABELS, K.VEGETATION_LOWEST, strict=True)
    trend = (F.when(ndvi_trend > K.GREENING_EPS, K.GREENING)
             .when(ndvi_trend < -K.GREENING_EPS, K.BROWNING))
    return F.concat_ws(" ", F.concat_ws(" — ", water, veg), trend)
