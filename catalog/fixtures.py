"""Input tables derived from the given test tables.

Satellite pixels and sightings come from ``lineitem`` (with ``part``), scenes
from ``orders``, areas of interest from ``supplier``, labelled events from
``events``. Every builder is a projection of a whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marshline import constants as K
from marshline.functions.geometry import parse_aoi
from marshline.grid import GridSpec, with_centers
from marshline.operators import profiles as R, sightings as B
from marshline.plans import habitat as H

GRID = GridSpec()
NOW = dt.date(2025, 6, 30)
# Box around all fixture sites, split 3 x 3 into study tiles.
BOX = (-90.605, 28.995, -90.385, 29.115)
# Moves 1995-2001 onto 2019-2025 with leap years aligned; year filters then remove rows.
SHIFT_MONTHS = 288


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shifted(col: str) -> Column:
    return F.add_months(F.to_date(col), SHIFT_MONTHS)


def _lon(site: Column, ok: Column) -> Column:
    return F.lit(-90.60) + (site % 20) * F.lit(0.0103) + (ok % 5) * F.lit(0.0001)


def _lat(site: Column, line: Column) -> Column:
    return F.lit(29.00) + F.floor(site / 20) * F.lit(0.0091) + line * F.lit(0.0001)


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """One row per pixel observation with digital-number bands."""
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    site = pk % 240
    dead = (ln == 7) & (ok % 10 == 0)

    def alive(c: Column) -> Column:
        return F.when(dead, 0).otherwise(c).cast("int")

    nir = alive(500 + (ok * 19 + sk * 53) % 3500)
    return table(spark, d, "lineitem").select(
        (sk % 9).cast("int").alias("tile_id"), ok.alias("scene_id"), shifted("l_shipdate").alias("time"),
        site.alias("site"), _lon(site, ok).alias("lon"), _lat(site, ln).alias("lat"),
        (ok % 50).alias("px"), (pk % 43).alias("py"),
        (300 + (ok * 31 + ln * 17) % 900).cast("int").alias("blue"),
        alive(400 + (ok * 13 + pk * 7) % 1500).alias("green"),
        alive(300 + (pk * 11 + ln * 101) % 1500).alias("red"),
        nir.alias("nir"), nir.alias("nir_narrow"),
        F.when(ok % 97 != 0, alive(300 + (pk * 5 + ok * 3) % 2500)).alias("swir1"),
        (200 + (ok * 23) % 1800).cast("int").alias("swir2"),
        ((ok + ln * 3) % 12).cast("int").alias("scl"),
        (((ok * 37 + ln * 11) % 1001) / F.lit(1000.0)).alias("score"),
        F.col("l_returnflag").alias("flag"), ln.alias("line"))


def indices(spark: SparkSession, d: str) -> DataFrame:
    """Pixels with reflectance and indices, cell and dekad."""
    return H.assign_grid_cell(H.pixel_indices(pixels(spark, d)), GRID).withColumn(
        "dekad", H.assign_dekad(F.col("time")))


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Every line of ``lineitem`` with the key of its part; those of a third of the sites are reported from far outside the study area, so their cells stay quiet."""
    ok, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    site = pk % 240
    return table(spark, d, "lineitem").select(
        F.when((ok % 37 == 0) | (site % 3 == 0), _lon(site, ok) - 5).otherwise(_lon(site, ok)).alias("lon"),
        _lat(site, ln).alias("lat"),
        F.when(ok % 53 == 0, "not-a-date").otherwise(shifted("l_shipdate").cast("string")).alias("date_str"),
        pk.alias("part"), (ok % 41 != 0).alias("named"),
        F.when(ok % 23 == 0, "X").otherwise(F.col("l_quantity").cast("long").cast("string")).alias("count_str"),
        F.when((ok % 29 == 0) & (ln > 5), "Insecta").otherwise("Aves").alias("taxon"),
        (ln <= 5).alias("is_ebird"))


def _with_names(lines: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Species, brand and type of each line's part; lines without a part are dropped."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_brand", "p_type")
    return lines.join(parts, "part").withColumns({
        "species": F.when(F.col("named"), F.col("p_name")), "brand": F.col("p_brand"), "type": F.col("p_type")
    }).drop("part", "named", "p_name", "p_brand", "p_type")


def _raw_sightings(spark: SparkSession, d: str) -> DataFrame:
    return _with_names(_reported(spark, d), spark, d)


def ebird_raw(spark: SparkSession, d: str) -> DataFrame:
    return _raw_sightings(spark, d).where("is_ebird").select(
        F.col("lat").cast("string").alias("decimalLatitude"), F.col("lon").cast("string").alias("decimalLongitude"),
        F.col("date_str").alias("eventDate"), "species", F.col("count_str").alias("individualCount"),
        F.col("brand").alias("order"), F.col("type").alias("family"))


def inat_raw(spark: SparkSession, d: str) -> DataFrame:
    return _raw_sightings(spark, d).where(~F.col("is_ebird")).select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("date_str").alias("observed_on"),
        F.col("species").alias("scientific_name"), F.col("taxon").alias("iconic_taxon_name"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """``ebird_raw`` and ``inat_raw`` cleaned and stacked.

    Parts are joined once and last: by then lines from outside the area and without a date are gone, and what is left is narrow.
    """
    lines, keep = _reported(spark, d), ["part", "named"]
    ebird = lines.where("is_ebird").select(
        F.col("lat").cast("string").alias("decimalLatitude"), F.col("lon").cast("string").alias("decimalLongitude"),
        F.col("date_str").alias("eventDate"), F.lit(None).cast("string").alias("species"), F.col("count_str").alias("individualCount"), *keep)
    inat = lines.where(~F.col("is_ebird")).select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("date_str").alias("observed_on"),
        F.lit(None).cast("string").alias("scientific_name"), F.col("taxon").alias("iconic_taxon_name"), *keep)
    clean = B.union_sightings(B.clean_ebird(ebird, GRID, keep=keep), B.clean_inat(inat, GRID, keep=keep))
    recorded = F.col("source") == "ebird"  # the other source has no order and no family
    return _with_names(clean, spark, d).select(
        *B.CELL_DEKAD, "species", F.when(recorded, F.col("brand")).alias("order"), F.when(recorded, F.col("type")).alias("family"), "count", "source")


def model_input(spark: SparkSession, d: str, orders: list[str] = ()) -> DataFrame:
    return H.model_input(pixels(spark, d), observations(spark, d), GRID, order_names=list(orders), sparse=True)


def stand_in_cluster() -> Column:
    """Deterministic cluster number, so scoring can be compared with SQL."""
    return F.pmod(F.col("ix") * 7 + F.col("iy") * 3, F.lit(6)).cast("int")


def profiles(spark: SparkSession, d: str, orders: list[str] = ()) -> DataFrame:
    """The profile columns scoring needs, with the stand-in cluster."""
    mi = model_input(spark, d, orders)
    return mi.groupBy("ix", "iy").agg(
        F.avg("NDVI").alias("NDVI_mean"), *R.trend_exprs(), R.flood_expr(), *R.bird_exprs(),
        *R.order_exprs(R.order_columns(mi))
    ).withColumns({"cluster": stand_in_cluster(), "cluster_confidence": F.lit(1.0)})


def scenes(spark: SparkSession, d: str) -> DataFrame:
    ck = F.col("o_custkey")
    west, south = F.lit(-90.60) + (ck % 12) * F.lit(0.01), F.lit(29.00) + (ck % 7) * F.lit(0.01)
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scene_id"), (ck % 9).cast("int").alias("tile_id"),
        shifted("o_orderdate").alias("datetime"),
        (F.floor("o_totalprice").cast("long") % 100).cast("double").alias("cloud_cover"),
        west.alias("west"), south.alias("south"), (west + 0.05).alias("east"), (south + 0.05).alias("north"),
        F.col("o_orderstatus").alias("status_code"))


# Outlines in twentieths of an area's width and height: rectangle, L, rectangle
# with a hole, two separate parts. Nested as polygons, rings, points.
OUTLINES = [
    [[[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)]]],
    [[[(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20), (0, 0)]]],
    [[[(0, 0), (20, 0), (20, 20), (0, 20), (0, 0)], [(5, 5), (15, 5), (15, 15), (5, 15), (5, 5)]]],
    [[[(0, 0), (8, 0), (8, 20), (0, 20), (0, 0)]], [[(12, 0), (20, 0), (20, 20), (12, 20), (12, 0)]]],
]


def aoi_geojson(spark: SparkSession, d: str) -> DataFrame:
    """One GeoJSON FeatureCollection string per supplier.

    Every eleventh area lies outside the study area.
    """
    s = F.col("s_suppkey")
    site = (s * 7) % 240
    x0 = F.lit(-906050) + (site % 20) * 103 - F.when(s % 11 == 0, 20000).otherwise(0)
    y0 = F.lit(289950) + F.floor(site / 20) * 91
    w, h = 10 + 5 * (s % 5), 10 + 5 * (s % 3)

    def point(p) -> Column:
        return F.array((x0 + p[0] * w) / F.lit(10000.0), (y0 + p[1] * h) / F.lit(10000.0))

    text = None
    for kind, polys in enumerate(OUTLINES):
        shape = F.array(*[F.array(*[F.array(*[point(p) for p in ring]) for ring in poly]) for poly in polys])
        name = "MultiPolygon" if len(polys) > 1 else "Polygon"
        coords = F.to_json(shape if len(polys) > 1 else shape[0])
        json = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":'
                              f'{{"type":"{name}","coordinates":'), coords, F.lit("}}]}"))
        text = F.when(s % 4 == kind, json) if text is None else text.when(s % 4 == kind, json)
    return table(spark, d, "supplier").select(s.alias("aoi_id"), text.alias("geojson"))


def aois(spark: SparkSession, d: str) -> DataFrame:
    return aoi_geojson(spark, d).select("aoi_id", parse_aoi(F.col("geojson")).alias("polys"))


def latest_sat(spark: SparkSession, d: str) -> DataFrame:
    """Whole-period mean indices per cell with centres."""
    return with_centers(indices(spark, d).groupBy("ix", "iy").agg(
        *[F.avg(c).alias(c) for c in K.INDICES]), GRID)


def scored_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a stand-in probability, class and diversity."""
    from marshline.functions.labels import suitability_class
    p = F.pmod(F.col("ix") * 37 + F.col("iy") * 11, F.lit(1001)) / F.lit(1000.7)
    div = F.pmod(F.col("ix") * 5 + F.col("iy") * 13, F.lit(301)) / F.lit(100.0)
    return latest_sat(spark, d).select("ix", "iy", "cell_x", "cell_y", "water_mask", p.alias("suitability_probability")
                                       ).withColumns({
        "suitability_pct": F.bround(p * 100, 1), "predicted_diversity": F.bround(div, 2),
        "archetype": suitability_class(F.col("suitability_probability"), F.col("water_mask"))})
