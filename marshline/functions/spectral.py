"""Spectral indices as Column expressions over scaled reflectance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marshline import constants as K


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, missing where the denominator is zero."""
    return F.when(den != 0, num / den)


def safe_nd(a: Column, b: Column) -> Column:
    """Normalised difference, missing where ``a + b`` is zero."""
    return safe_ratio(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return safe_nd(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return safe_nd(green, nir)


def mndwi(green: Column, swir1: Column) -> Column:
    return safe_nd(green, swir1)


def ndmi(nir: Column, swir1: Column) -> Column:
    return safe_nd(nir, swir1)


def lswi(nir: Column, swir1: Column) -> Column:
    """Same formula as NDMI; kept because both names are reported."""
    return ndmi(nir, swir1)


def evi(blue: Column, red: Column, nir: Column) -> Column:
    return safe_ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)


def savi(red: Column, nir: Column) -> Column:
    return safe_ratio(1.5 * (nir - red), nir + red + 0.5)


def wri(green: Column, red: Column, nir: Column, swir1: Column) -> Column:
    return safe_ratio(green + red, nir + swir1)


def gcvi(green: Column, nir: Column) -> Column:
    return F.when(green != 0, nir / green - 1)


def tc_wetness(**bands: Column) -> Column:
    """Tasselled-cap wetness: a fixed weighted sum of six bands."""
    terms = [F.lit(w) * bands[name] for name, w in K.TC_WETNESS.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def wetland_moisture_index(ndwi_: Column, ndmi_: Column, mndwi_: Column) -> Column:
    return (ndwi_ + ndmi_ + mndwi_) / 3.0


def water_mask(mndwi_: Column, ndvi_: Column, keep_unknown: bool = False) -> Column:
    """1.0 for open water, else 0.0.

    Unknown inputs give 0.0 unless ``keep_unknown``, which leaves them missing.
    """
    wet = (mndwi_ > 0) & (ndvi_ < 0.2)
    mask = F.when(wet, 1.0).otherwise(0.0)
    return F.when(mndwi_.isNotNull() & ndvi_.isNotNull(), mask) if keep_unknown else mask


def scl_valid(scl: Column, policy: str) -> Column:
    """Whether a pixel's scene class is acceptable under a named policy."""
    if policy in K.SCL_KEEP:
        return F.coalesce(scl.isin(K.SCL_KEEP[policy]), F.lit(False))
    return ~F.coalesce(scl.isin(K.SCL_DROP[policy]), F.lit(False))
