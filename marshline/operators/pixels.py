"""Pixel tables: band names, indices, masks and spatial aggregation.

``pixels`` holds one row per (tile, time, px, py) with bands as columns, stored
as Parquet partitioned by ``tile_id, year``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marshline import constants as K
from marshline.functions import geometry as G, spectral as S
from marshline.functions.dates import assign_dekad
from marshline.grid import in_bbox
from marshline.operators.selection import grouped_medians
from marshline.session import stage


def canonical_bands(df: DataFrame, coordinates: bool = True) -> DataFrame:
    """Product band (and coordinate) names to the names used here."""
    have = set(df.columns)
    names = {a: b for a, b in K.BAND_ALIASES.items() if a in have and b not in have}
    for alias, target in K.COORD_ALIASES if coordinates else []:
        if alias in have and target not in have and target not in names.values():
            names[alias] = target
    return df.withColumnsRenamed(names)


def scale_reflectance(df: DataFrame, bands: list[str] = K.BANDS) -> DataFrame:
    """Digital numbers to reflectance, in double precision."""
    have = [b for b in bands if b in df.columns]
    return df.withColumns({b: F.col(b).cast("double") / F.lit(K.REFLECTANCE_SCALE) for b in have})


def spectral_indices(df: DataFrame, keep_unknown_water: bool = False) -> DataFrame:
    """Add the twelve indices to reflectance bands.

    Unchanged when a required band is absent or indices are already there.
    """
    have = set(df.columns)
    if not set(K.REQUIRED_BANDS) <= have or have & set(K.INDICES):
        return df
    b = {name: F.col(name) for name in K.REQUIRED_BANDS}
    base = df.withColumns({
        "NDVI": S.ndvi(b["nir"], b["red"]),
        "NDWI": S.ndwi(b["green"], b["nir"]),
        "MNDWI": S.mndwi(b["green"], b["swir1"]),
        "NDMI": S.ndmi(b["nir"], b["swir1"]),
        "EVI": S.evi(b["blue"], b["red"], b["nir"]),
        "SAVI": S.savi(b["red"], b["nir"]),
        "LSWI": S.lswi(b["nir"], b["swir1"]),
        "WRI": S.wri(b["green"], b["red"], b["nir"], b["swir1"]),
        "tc_wetness": S.tc_wetness(**b),
        "GCVI": S.gcvi(b["green"], b["nir"]),
    })
    c = F.col
    return base.withColumns({
        "wetland_moisture_index": S.wetland_moisture_index(c("NDWI"), c("NDMI"), c("MNDWI")),
        "water_mask": S.water_mask(c("MNDWI"), c("NDVI"), keep_unknown_water),
    })


def scl_mask(df: DataFrame, policy: str, cols: list[str] = K.INDICES, scl: str = "scl") -> DataFrame:
    """Make ``cols`` missing where the scene class is unacceptable."""
    ok = S.scl_valid(F.col(scl), policy)
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols if c in df.columns})


def clip_scene_pixels(df: DataFrame, bbox) -> DataFrame:
    """Pixels inside ``bbox`` that have at least one band."""
    bands = [b for b in K.BANDS if b in df.columns]
    return df.where(in_bbox(F.col("lon"), F.col("lat"), bbox)).dropna("all", subset=bands)


def resample_match(fine: DataFrame, coarse: DataFrame, scene: list[str], bands: list[str],
                   factor: int = 2) -> DataFrame:
    """Bring coarse bands onto the fine grid by nearest neighbour.

    Pixel numbers of both grids start at 0, so a fine pixel's neighbour is its
    number divided by ``factor``. One equi join, no search.
    """
    right = coarse.select(*scene, F.col("px").alias("cpx"), F.col("py").alias("cpy"), *bands)
    left = fine.drop(*bands).withColumns({
        "cpx": F.floor(F.col("px") / F.lit(factor)), "cpy": F.floor(F.col("py") / F.lit(factor))})
    return left.join(right, [*scene, "cpx", "cpy"], "left").drop("cpx", "cpy")


def coarsen_factor(km: float, resolution: float, projected: bool, m_per_deg: float = K.M_PER_DEG) -> int:
    """Pixels per block edge for a block of ``km`` at a resolution in m or degrees."""
    step = resolution if projected else resolution * m_per_deg
    return max(1, round(km * 1000 / step))


def coarsen_blocks(df: DataFrame, factor: int, cols: list[str], raster: list[str] = ("tile_id",),
                   time: str = "time") -> DataFrame:
    """Mean over ``factor`` x ``factor`` blocks; incomplete edge blocks are dropped.

    Missing pixels are skipped. Pixels are read once and averaged map-side; the
    staged blocks, smaller by the pixels per block, also give the raster extents.
    """
    raster = list(raster)
    have = [c for c in ("lon", "lat") if c in df.columns]
    f = F.lit(factor)
    blocks = stage(df.groupBy(*raster, time, F.floor(F.col("px") / f).alias("bx"), F.floor(F.col("py") / f).alias("by")).agg(
        *[F.avg(c).alias(c) for c in [*have, *cols]], F.count("*").alias("n_pixels"),
        F.max("px").alias("_px"), F.max("py").alias("_py")), "blocks")
    extent = blocks.groupBy(*raster).agg(
        F.floor((F.max("_px") + 1) / f).alias("nx"), F.floor((F.max("_py") + 1) / f).alias("ny"))
    return (blocks.drop("_px", "_py").join(extent, raster)
            .where((F.col("bx") < F.col("nx")) & (F.col("by") < F.col("ny"))).drop("nx", "ny"))


def cell_means(df: DataFrame, keys: list[str], cols: list[str] = K.INDICES, weighted: bool = False) -> DataFrame:
    """Mean of each column per key; with ``weighted`` by ``n_pixels``."""
    if not weighted:
        return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
    w = F.col("n_pixels")
    return df.groupBy(*keys).agg(*[
        F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in cols])


def dedupe_overlaps(df: DataFrame, keys: list[str] = ("ix", "iy", "dekad"),
                    cols: list[str] = K.INDICES) -> DataFrame:
    """One row per key: the unweighted mean over overlapping tiles."""
    return cell_means(df, list(keys), cols)


def drop_missing_all(df: DataFrame, cols: list[str] = K.INDICES) -> DataFrame:
    """Drop rows where every column is missing."""
    return df.dropna("all", subset=list(cols))


def drop_missing_any(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any column is missing."""
    return df.dropna("any", subset=list(cols))


def temporal_median(df: DataFrame, keys: list[str] = ("px", "py"), cols: list[str] = K.INDICES,
                    hot_rows: int | None = 1_000_000) -> DataFrame:
    """Per-pixel median over scenes; ``hot_rows=None`` where scenes are limited."""
    return grouped_medians(df, list(keys), list(cols), hot_rows)


def dekadal_composite(df: DataFrame, keys: list[str] = ("tile_id", "px", "py"),
                      bands: list[str] = K.BANDS, policy: str | None = "composite") -> DataFrame:
    """Masked per-pixel, per-band median of each ten-day period.

    The bands are digital numbers of at most 16 bits and the median counts
    values, which bounds the state of a pixel however many scenes see it.
    """
    masked = scl_mask(df, policy, bands) if policy else df
    dated = masked.withColumn("dekad", assign_dekad(F.col("time")))
    return drop_missing_all(grouped_medians(dated, [*keys, "dekad"], bands, None), bands)


def cloud_fraction(df: DataFrame, keys: list[str]) -> DataFrame:
    """Share of cloud classes among classified pixels; 1.0 when none is classified."""
    known = F.col("scl") > 0
    cloudy = F.when(known, F.col("scl").isin(K.SCL_CLOUD).cast("double"))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(cloudy), F.lit(1.0)).alias("cloud_fraction"))


def complete(cols: list[str] = K.INDICES) -> Column:
    """Whether every index of a row is present."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok


def index_coverage(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Share of rows with all indices present; 0 for an empty table."""
    share = F.coalesce(F.avg(complete().cast("double")), F.lit(0.0)).alias("coverage")
    return df.groupBy(*keys).agg(share) if keys else df.agg(share)


def guess_utm_zone(df: DataFrame, x: str = "x", keys: list[str] = ()) -> DataFrame:
    """EPSG code guessed from the mean easting, for a study area astride 90 W."""
    epsg = F.when(F.avg(x) < 500000, 32616).otherwise(32615).alias("epsg")
    return df.groupBy(*keys).agg(epsg) if keys else df.agg(epsg)


def locate_pixels(df: DataFrame, raster: list[str] = ("tile_id", "time"), x: str = "x", y: str = "y", epsg: str | None = None) -> DataFrame:
    """Replace ``x``, ``y`` (and ``epsg``) by ``lon`` and ``lat``, each raster by its own coordinates.

    A raster whose coordinates go beyond 360 is projected: by its ``epsg``, or without one by the zone that its mean easting suggests. Others are in
    degrees. The routes, one small row a raster, come from one aggregate that combines map-side and are joined back.
    """
    keys = list(raster)
    code = F.max(F.col(epsg).cast("int")) if epsg else F.lit(None).cast("int")
    seen = df.groupBy(*keys).agg((F.max(F.greatest(F.abs(x), F.abs(y))) > 360).alias("_projected"), code.alias("_given"), F.avg(x).alias("_mean"))
    routes = stage(seen.select(*keys, F.when(F.col("_projected"), F.coalesce("_given", F.when(F.col("_mean") < 500000, 32616).otherwise(32615))).alias("_epsg")), "routes")
    # Null-safe on every key: a raster without a time is a raster.
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    routed = df.alias("p").join(routes.alias("r"), same).select("p.*", "r._epsg")
    lon, lat = G.to_lonlat(F.col(x), F.col(y), F.col("_epsg"))
    flat = F.col("_epsg").isNull()
    return routed.withColumns({"lon": F.when(flat, F.col(x)).otherwise(lon), "lat": F.when(flat, F.col(y)).otherwise(lat)}).drop("_epsg", x, y, *([epsg] if epsg else []))
