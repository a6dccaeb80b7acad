"""Queries for projections, grid, calendar, casting and label operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import fixtures as X
from catalog.registry import query, rounded, tidy
from catalog.sqlkit import (cluster_label_sql, condition_sql, coverage_sql, cx, cy, diversity_text, num, r6, rcols, score_text, sql, suit_class,
                            temporal, tiles_sql, trend_text)
from marshline import constants as K
from marshline.functions import casting as A, dates as D, features as E, geometry as G, labels as L, spectral as S
from marshline.grid import assign_grid_cell, cell_polygon, in_bbox, split_bbox_tiles, split_periods
from marshline.operators import pixels as P, scenes as C, sightings as B
from marshline.plans import habitat as H

_STATS = ["n_valid", "mean_value", "min_value", "max_value"]


def _per_cell(df: DataFrame, value) -> DataFrame:
    """Per-cell summary of a pixel expression, so the output stays small."""
    out = assign_grid_cell(df, X.GRID).groupBy("ix", "iy").agg(
        F.count(value).alias("n_valid"), F.avg(value).alias("mean_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return tidy(out, ["ix", "iy", "n_valid"], _STATS[1:])


def _per_cell_sql(expr: str) -> str:
    return sql(f"SELECT ix, iy, count(v) AS n_valid, {r6('avg(v)', 'mean_value')}, {r6('min(v)', 'min_value')}, "
               f"{r6('max(v)', 'max_value')} FROM (SELECT ix, iy, {expr} AS v FROM idx) GROUP BY ix, iy", "idx")


def _refl(spark, d):
    return P.scale_reflectance(X.pixels(spark, d))


_c = F.col
_INDEX = {
    "safe_nd": (lambda: S.safe_nd(_c("nir"), _c("swir2")),
                "CASE WHEN nir + swir2 <> 0 THEN (nir - swir2) / (nir + swir2) END"),
    "ndvi": (lambda: S.ndvi(_c("nir"), _c("red")), '"NDVI"'),
    "ndwi": (lambda: S.ndwi(_c("green"), _c("nir")), '"NDWI"'),
    "mndwi": (lambda: S.mndwi(_c("green"), _c("swir1")), '"MNDWI"'),
    "ndmi": (lambda: S.ndmi(_c("nir"), _c("swir1")), '"NDMI"'),
    "evi": (lambda: S.evi(_c("blue"), _c("red"), _c("nir")), '"EVI"'),
    "savi": (lambda: S.savi(_c("red"), _c("nir")), '"SAVI"'),
    "lswi": (lambda: S.lswi(_c("nir"), _c("swir1")), '"LSWI"'),
    "wri": (lambda: S.wri(_c("green"), _c("red"), _c("nir"), _c("swir1")), '"WRI"'),
    "wetland_moisture_index": (
        lambda: S.wetland_moisture_index(S.ndwi(_c("green"), _c("nir")), S.ndmi(_c("nir"), _c("swir1")),
                                         S.mndwi(_c("green"), _c("swir1"))), "wetland_moisture_index"),
    "water_mask": (lambda: S.water_mask(S.mndwi(_c("green"), _c("swir1")), S.ndvi(_c("nir"), _c("red"))), "water_mask"),
    "tc_wetness": (lambda: S.tc_wetness(**{b: _c(b) for b in K.TC_WETNESS}), "tc_wetness"),
    "gcvi": (lambda: S.gcvi(_c("green"), _c("nir")), '"GCVI"'),
}
for _name, (_expr, _sql) in _INDEX.items():
    query(_name, _per_cell_sql(_sql))(lambda spark, d, e=_expr: _per_cell(_refl(spark, d), e()))

_ALL_AVG = ", ".join(r6(f'avg("{c}")', c) for c in K.INDICES)


@query("canonical_bands", sql(
    "SELECT tile_id, " + ", ".join(f"CAST(sum({b}) AS BIGINT) AS {b}" for b in K.BANDS)
    + f", {r6('min(lon)', 'min_x')}, {r6('max(lat)', 'max_y')}, max(time) AS last_time FROM pix GROUP BY tile_id", "pix"))
def canonical_bands(spark, d):
    raw = X.pixels(spark, d).withColumnsRenamed({
        "blue": "B02", "green": "B03", "red": "B04", "nir": "B08", "nir_narrow": "nir08", "swir1": "swir16",
        "swir2": "B12", "lon": "longitude", "lat": "latitude", "time": "t"})
    return P.canonical_bands(raw).groupBy("tile_id").agg(
        *[F.sum(b).alias(b) for b in K.BANDS], rounded(F.min("x")).alias("min_x"),
        rounded(F.max("y")).alias("max_y"), F.max("time").alias("last_time"))


@query("scale_reflectance", sql(
    "SELECT tile_id, " + ", ".join(r6(f"avg({b})", b) for b in K.BANDS) + " FROM refl GROUP BY tile_id", "refl"))
def scale_reflectance(spark, d):
    return _refl(spark, d).groupBy("tile_id").agg(*[rounded(F.avg(b)).alias(b) for b in K.BANDS])


@query("spectral_indices", sql(f"SELECT ix, iy, {_ALL_AVG} FROM idx GROUP BY ix, iy", "idx"))
def spectral_indices(spark, d):
    df = assign_grid_cell(P.spectral_indices(_refl(spark, d)), X.GRID)
    return df.groupBy("ix", "iy").agg(*[rounded(F.avg(c)).alias(c) for c in K.INDICES])


def _scl_sql() -> str:
    parts = []
    for name, codes in {**K.SCL_KEEP, **K.SCL_DROP}.items():
        ok = f"scl {'IN' if name in K.SCL_KEEP else 'NOT IN'} ({','.join(map(str, codes))})"
        parts.append(f"SELECT '{name}' AS policy, tile_id, count(v) AS n_valid, {r6('avg(v)', 'mean_ndvi')}, "
                     f"count(w) AS n_water FROM (SELECT tile_id, CASE WHEN {ok} THEN \"NDVI\" END AS v, "
                     f"CASE WHEN {ok} THEN water_mask END AS w FROM idx) GROUP BY tile_id")
    return sql(" UNION ALL ".join(parts), "idx")


@query("scl_mask", _scl_sql())
def scl_mask(spark, d):
    base = P.spectral_indices(_refl(spark, d))
    out = None
    for policy in [*K.SCL_KEEP, *K.SCL_DROP]:
        part = P.scl_mask(base, policy, ["NDVI", "water_mask"]).groupBy("tile_id").agg(
            F.count("NDVI").alias("n_valid"), rounded(F.avg("NDVI")).alias("mean_ndvi"),
            F.count("water_mask").alias("n_water")).select(F.lit(policy).alias("policy"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("assign_grid_cell", sql(f"""SELECT ix, iy, count(*) AS n_rows, {r6(cx(), 'cell_x')}, {r6(cy(), 'cell_y')}
    FROM idx GROUP BY ix, iy""", "idx"))
def grid_cell(spark, d):
    df = assign_grid_cell(X.pixels(spark, d), X.GRID).groupBy("ix", "iy").agg(F.count("*").alias("n_rows"))
    return tidy(H.with_centers(df, X.GRID), ["ix", "iy", "n_rows"], ["cell_x", "cell_y"])


def _corner(i: int) -> str:
    sx, sy = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)][i]
    hx, hy = num(X.GRID.cell_lon / 2), num(X.GRID.cell_lat / 2)
    return f"{r6(f'{cx()} + {sx} * {hx}', f'x{i}')}, {r6(f'{cy()} + {sy} * {hy}', f'y{i}')}"


@query("cell_polygon", sql("SELECT ix, iy, " + ", ".join(_corner(i) for i in range(5)) + " FROM cellpts", "cellpts"))
def polygon_of_cell(spark, d):
    cells = assign_grid_cell(X.pixels(spark, d), X.GRID).select("ix", "iy").distinct()
    ring = cells.withColumn("r", cell_polygon(F.col("ix"), F.col("iy"), X.GRID))
    return ring.select("ix", "iy", *[rounded(F.col("r")[i][a]).alias(f"{a}{i}") for i in range(5) for a in ("x", "y")])


@query("assign_dekad", sql(f"SELECT dekad, count(*) AS n_rows, min(time) AS first_day, max(time) AS last_day FROM idx "
                           "GROUP BY dekad", "idx"))
def dekads(spark, d):
    return X.pixels(spark, d).withColumn("dekad", D.assign_dekad(F.col("time"))).groupBy("dekad").agg(
        F.count("*").alias("n_rows"), F.min("time").alias("first_day"), F.max("time").alias("last_day"))


@query("temporal_features", sql(
    f"SELECT time, year, month, day_of_year, bird_season, {rcols(['doy_sin', 'doy_cos'])}, count(*) AS n_rows FROM "
    f"(SELECT time, {temporal('time')} FROM pix) GROUP BY ALL", "pix"))
def temporal_features(spark, d):
    df = X.pixels(spark, d).groupBy("time").agg(F.count("*").alias("n_rows"))
    return tidy(H.temporal_features(df, "time"), ["time", "year", "month", "day_of_year", "bird_season", "n_rows"],
                ["doy_sin", "doy_cos"])


@query("month_cycle", sql("SELECT month(time) AS month, count(*) AS n_rows, "
                          + r6("sin(2 * pi() * month(time) / 12e0)", "month_sin") + ", "
                          + r6("cos(2 * pi() * month(time) / 12e0)", "month_cos") + " FROM pix GROUP BY month(time)",
                          "pix").replace("SELECT month(time) AS month", "SELECT CAST(month(time) AS INTEGER) AS month"))
def month_cycle(spark, d):
    df = X.pixels(spark, d).groupBy(F.month("time").alias("month")).agg(F.count("*").alias("n_rows"))
    return tidy(df.withColumns(D.month_cycle(F.col("month"))), ["month", "n_rows"], ["month_sin", "month_cos"])


@query("split_bbox_tiles", sql(f"""SELECT tile AS tile_id, count(*) AS n_pixels,
    {r6(f"{num(X.BOX[0])} + (tile // 3) * {num((X.BOX[2] - X.BOX[0]) / 3)}", 'west')},
    {r6(f"{num(X.BOX[1])} + (tile % 3) * {num((X.BOX[3] - X.BOX[1]) / 3)}", 'south')},
    {r6(f"{num(X.BOX[0])} + (tile // 3 + 1) * {num((X.BOX[2] - X.BOX[0]) / 3)}", 'east')},
    {r6(f"{num(X.BOX[1])} + (tile % 3 + 1) * {num((X.BOX[3] - X.BOX[1]) / 3)}", 'north')}
    FROM ({tiles_sql('pix', 'lon', 'lon', 'lat', 'lat')}) GROUP BY tile""", "pix"))
def bbox_tiles(spark, d):
    counts = C.pixels_by_tile(X.pixels(spark, d), X.BOX, 3, 3).groupBy("tile_id").agg(F.count("*").alias("n_pixels"))
    out = split_bbox_tiles(spark, X.BOX).join(counts, "tile_id")
    return tidy(out, ["tile_id", "n_pixels"], ["west", "south", "east", "north"])


@query("split_periods", sql("""SELECT CAST(year(time) AS INTEGER) AS year, CAST(quarter(time) AS INTEGER) AS quarter,
    CAST(date_trunc('quarter', time) AS DATE) AS start_date,
    CAST(date_trunc('quarter', time) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date, count(*) AS n_pixels
    FROM pix WHERE year(time) BETWEEN 2020 AND 2025 GROUP BY ALL""", "pix"))
def periods(spark, d):
    daily = X.pixels(spark, d).groupBy(F.year("time").alias("year"), F.quarter("time").alias("quarter")).agg(
        F.count("*").alias("n_pixels"))
    return split_periods(spark, list(range(2020, 2026)), quarterly=True).join(daily, ["year", "quarter"])


@query("in_bbox", sql("SELECT tile_id, count(*) AS n_pixels FROM pix WHERE lon BETWEEN -90.55e0 AND -90.45e0 "
                      "AND lat BETWEEN 29.02e0 AND 29.07e0 GROUP BY tile_id", "pix"))
def bbox_rows(spark, d):
    return X.pixels(spark, d).where(in_bbox(F.col("lon"), F.col("lat"), (-90.55, 29.02, -90.45, 29.07))).groupBy(
        "tile_id").agg(F.count("*").alias("n_pixels"))


@query("parse_aoi", sql(f"""SELECT aoi_id, count(DISTINCT poly) AS n_polygons, count(DISTINCT poly * 10 + ring) AS n_rings,
    count(*) AS n_points, {r6('sum(x)', 'sum_x')}, {r6('sum(y)', 'sum_y')} FROM aoi_v GROUP BY aoi_id""", "aoi_v"))
def parse_aoi(spark, d):
    pts = G.points(F.col("polys"))
    return X.aois(spark, d).select(
        "aoi_id", F.size("polys").cast("long").alias("n_polygons"), F.size(F.flatten("polys")).cast("long").alias("n_rings"),
        F.size(pts).cast("long").alias("n_points"),
        rounded(F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["x"])).alias("sum_x"),
        rounded(F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["y"])).alias("sum_y"))


@query("polygon_bounds", sql(f"SELECT aoi_id, {rcols(['west', 'south', 'east', 'north'])} FROM aoi_b", "aoi_b"))
def bounds(spark, d):
    return tidy(X.aois(spark, d).select("aoi_id", G.polygon_bounds(F.col("polys")).alias("b")).select("aoi_id", "b.*"),
                ["aoi_id"], ["west", "south", "east", "north"])


_W, _S, _E, _N = (num(v) for v in K.AOI_BOUNDS)


@query("bbox_within", sql(f"SELECT aoi_id, west >= {_W} AND east <= {_E} AND south >= {_S} AND north <= {_N} AS inside "
                          "FROM aoi_b", "aoi_b"))
def within(spark, d):
    return X.aois(spark, d).select("aoi_id", G.bbox_within(F.col("polys"), K.AOI_BOUNDS).alias("inside"))


@query("points_in_polygon", sql("SELECT aoi_id, ix, iy FROM hits", "hits"))
def contained(spark, d):
    from marshline.operators.aoi import spatial_join
    cells = assign_grid_cell(X.pixels(spark, d), X.GRID).select("ix", "iy").distinct()
    return spatial_join(H.with_centers(cells, X.GRID), X.aois(spark, d), X.GRID).select("aoi_id", "ix", "iy")


def _utm_sql(lon: str, lat: str, meridian: float) -> tuple[str, str]:
    t = (f"sinh(atanh(sin(radians({lat}))) - {num(G._ECC)} * atanh({num(G._ECC)} * sin(radians({lat}))))")
    dl = f"radians({lon} - ({num(meridian)}))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl}) / sqrt(1 + {t} * {t}))"
    x = eta + "".join(f" + ({num(a)}) * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(G._ALPHA, 1))
    y = xi + "".join(f" + ({num(a)}) * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(G._ALPHA, 1))
    k = num(G._K0 * G._RECT)
    return f"500000e0 + {k} * ({x})", f"{k} * ({y})"


_UX, _UY = _utm_sql("lon", "lat", -93.0)


@query("to_utm", sql(f"""SELECT site, count(*) AS n_rows, {r6(f'avg({_UX})', 'easting', 3)}, {r6(f'avg({_UY})', 'northing', 3)}
    FROM pix GROUP BY site""", "pix"))
def to_utm(spark, d):
    x, y = G.to_utm(F.col("lon"), F.col("lat"), 32615)
    return X.pixels(spark, d).groupBy("site").agg(
        F.count("*").alias("n_rows"), rounded(F.avg(x), 3).alias("easting"), rounded(F.avg(y), 3).alias("northing"))


@query("to_lonlat", sql(f"SELECT site, {r6('avg(lon)', 'lon', 7)}, {r6('avg(lat)', 'lat', 7)} FROM pix GROUP BY site", "pix"))
def to_lonlat(spark, d):
    """There and back again through zone 16; the oracle is the original point."""
    x, y = G.to_utm(F.col("lon"), F.col("lat"), 32616)
    proj = X.pixels(spark, d).select("site", x.alias("x"), y.alias("y"))
    lon, lat = G.to_lonlat(F.col("x"), F.col("y"), 32616)
    return proj.groupBy("site").agg(rounded(F.avg(lon), 7).alias("lon"), rounded(F.avg(lat), 7).alias("lat"))


@query("guess_utm_zone", sql("""SELECT tile_id, CASE WHEN avg(500000 + (site % 20 - 10) * 5000) < 500000 THEN 32616
    ELSE 32615 END AS epsg FROM pix GROUP BY tile_id""", "pix"))
def utm_zone(spark, d):
    df = X.pixels(spark, d).withColumn("x", 500000 + (F.col("site") % 20 - 10) * 5000)
    return P.guess_utm_zone(df, "x", ["tile_id"])


_VX, _VY = _utm_sql("x", "y", -93.0)
AREA_SQL = f"""SELECT aoi_id, round_even(sum(CASE WHEN ring = 0 THEN a ELSE -a END) / 1e6, 1) AS area_km2 FROM (
    SELECT aoi_id, poly, ring, abs(sum(ux * uy2 - ux2 * uy)) / 2 AS a FROM (
    SELECT aoi_id, poly, ring, ux, uy, lead(ux) OVER w AS ux2, lead(uy) OVER w AS uy2 FROM (
    SELECT *, {_VX} AS ux, {_VY} AS uy FROM aoi_v) WINDOW w AS (PARTITION BY aoi_id, poly, ring ORDER BY seq))
    WHERE ux2 IS NOT NULL GROUP BY ALL) GROUP BY aoi_id"""


@query("polygon_area_km2", sql(AREA_SQL, "aoi_v"))
def area(spark, d):
    return X.aois(spark, d).select("aoi_id", G.polygon_area_km2(F.col("polys")).alias("area_km2"))


@query("coerce_numeric", sql("SELECT n_value, count(*) AS n_rows FROM (SELECT CASE WHEN l_orderkey % 23 = 0 THEN NULL "
                             "ELSE CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) END AS n_value FROM rawsight) GROUP BY n_value",
                             "rawsight"))
def numbers(spark, d):
    raw = X._raw_sightings(spark, d)
    return raw.groupBy(A.coerce_numeric(F.col("count_str")).alias("n_value")).agg(F.count("*").alias("n_rows"))


@query("coerce_date", sql("SELECT day_value, count(*) AS n_rows FROM (SELECT CASE WHEN dated THEN day END AS day_value "
                          "FROM rawsight) GROUP BY day_value", "rawsight"))
def days(spark, d):
    return X._raw_sightings(spark, d).groupBy(A.coerce_date(F.col("date_str")).alias("day_value")).agg(
        F.count("*").alias("n_rows"))


@query("coerce_count", sql("SELECT cnt AS n_birds, count(*) AS n_rows FROM rawsight GROUP BY cnt", "rawsight"))
def counts(spark, d):
    return X._raw_sightings(spark, d).groupBy(A.coerce_count(F.col("count_str")).alias("n_birds")).agg(
        F.count("*").alias("n_rows"))


@query("drop_missing_any", sql("""SELECT taxon, count(*) AS n_rows FROM rawsight WHERE dated AND species IS NOT NULL
    GROUP BY taxon""", "rawsight"))
def no_gaps(spark, d):
    df = X._raw_sightings(spark, d).withColumn("day", A.coerce_date(F.col("date_str")))
    return P.drop_missing_any(df, ["day", "species"]).groupBy("taxon").agg(F.count("*").alias("n_rows"))


@query("drop_missing_all", sql("""SELECT tile_id, count(*) AS n_rows FROM idx WHERE scl NOT IN (0, 1, 8, 9)
    GROUP BY tile_id""", "idx"))
def no_empty(spark, d):
    return P.drop_missing_all(H.pixel_indices(X.pixels(spark, d), "prefetch")).groupBy("tile_id").agg(
        F.count("*").alias("n_rows"))


@query("filter_years", sql("SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS n_rows FROM pix "
                           "WHERE year(time) BETWEEN 2020 AND 2025 GROUP BY 1", "pix"))
def years(spark, d):
    return B.filter_years(X.pixels(spark, d), date="time").groupBy(F.year("time").alias("year")).agg(
        F.count("*").alias("n_rows"))


@query("filter_taxon", sql("SELECT species AS scientific_name, count(*) AS n_rows FROM rawsight WHERE NOT is_ebird AND taxon = 'Aves' "
                           "GROUP BY species", "rawsight"))
def birds_only(spark, d):
    return B.filter_taxon(X.inat_raw(spark, d)).groupBy("scientific_name").agg(F.count("*").alias("n_rows"))


@query("nonfinite_to_zero", sql(f"""SELECT tile_id, {r6('sum(coalesce("MNDWI", 0))', 'total')}, count(*) AS n_rows
    FROM idx GROUP BY tile_id""", "idx"))
def finite(spark, d):
    base = _refl(spark, d)
    m = S.mndwi(F.col("green"), F.col("swir1"))
    bad = F.coalesce(F.when(F.col("green") + F.col("swir1") == 0, F.lit(float("inf"))), m, F.lit(float("nan")))
    return base.groupBy("tile_id").agg(rounded(F.sum(A.nonfinite_to_zero(bad))).alias("total"), F.count("*").alias("n_rows"))


@query("interaction_features", sql(
    "SELECT ix, iy, " + ", ".join(r6(f"avg({e})", n) for n, e in {
        **{n: f'"{a}" * "{b}"' for n, (a, b) in K.INTERACTIONS.items()},
        **{n: f'"{a}" / (abs("{b}") + 0.01e0)' for n, (a, b) in K.RATIOS.items()},
        **{n: f'"{a}" * "{a}"' for n, a in K.SQUARES.items()}}.items()) + " FROM sat GROUP BY ix, iy", "sat"))
def interactions(spark, d):
    names = [*K.INTERACTIONS, *K.RATIOS, *K.SQUARES]
    df = E.interaction_features(H.cell_dekads(B.filter_years(X.pixels(spark, d), date="time"), X.GRID, sparse=True))
    return df.groupBy("ix", "iy").agg(*[rounded(F.avg(c)).alias(c) for c in names])


@query("align_features", sql(f"""SELECT ix, iy, {r6('avg("NDVI")', 'NDVI')}, 0e0 AS not_measured, {r6('avg("EVI")', 'EVI')}
    FROM idx GROUP BY ix, iy""", "idx"))
def aligned(spark, d):
    df = X.indices(spark, d).groupBy("ix", "iy").agg(rounded(F.avg("EVI")).alias("EVI"), rounded(F.avg("NDVI")).alias("NDVI"))
    return E.align_features(df, ["NDVI", "not_measured", "EVI"], ["ix", "iy"])


@query("suitability_class", sql(f"""SELECT {suit_class('score', 'water_mask')} AS archetype, count(*) AS n_rows
    FROM idx GROUP BY 1""", "idx"))
def classes(spark, d):
    return X.indices(spark, d).groupBy(L.suitability_class(F.col("score"), F.col("water_mask")).alias("archetype")).agg(
        F.count("*").alias("n_rows"))


def _band(closed: bool) -> str:
    whens = " ".join(f"WHEN score >= {num(lo)} AND score {'<=' if i == 0 and closed else '<'} {num(hi)} THEN '{n}'"
                     for i, (n, lo, hi) in enumerate(K.PROBABILITY_BANDS))
    return f"CASE {whens} END"


@query("probability_band", sql(f"""SELECT {_band(True)} AS band, {_band(False)} AS half_open_band, count(*) AS n_rows
    FROM pix GROUP BY 1, 2""", "pix"))
def bands(spark, d):
    p = F.col("score")
    return X.pixels(spark, d).groupBy(L.probability_band(p).alias("band"),
                                      L.probability_band(p, False).alias("half_open_band")).agg(F.count("*").alias("n_rows"))


@query("describe_trend", sql(f"""SELECT ix, iy, {trend_text('"NDVI_trend"', 'Vegetation')} AS vegetation,
    {trend_text('"NDWI_trend"', 'Water presence')} AS water FROM prof""", "prof"))
def trend_sentences(spark, d):
    return X.profiles(spark, d).select("ix", "iy", L.describe_trend(F.col("NDVI_trend"), "Vegetation").alias("vegetation"),
                                       L.describe_trend(F.col("NDWI_trend"), "Water presence").alias("water"))


@query("diversity_level", sql(f"SELECT {diversity_text('shannon_diversity')} AS level, count(*) AS n_rows FROM bird GROUP BY 1",
                              "bird"))
def levels(spark, d):
    df = B.shannon_diversity(X.observations(spark, d))
    return df.groupBy(L.diversity_level(F.col("shannon_diversity")).alias("level")).agg(F.count("*").alias("n_rows"))


@query("coverage_text", sql(f"""SELECT ix, iy, {coverage_sql('p')} AS text FROM (SELECT ix, iy,
    100e0 * avg(CASE WHEN n_observations > 0 THEN 1e0 ELSE 0e0 END) AS p FROM mi GROUP BY ix, iy)""", "mi"))
def coverage_sentences(spark, d):
    p = 100.0 * F.avg((F.col("n_observations") > 0).cast("double"))
    return X.model_input(spark, d).groupBy("ix", "iy").agg(p.alias("p")).select("ix", "iy", L.coverage_text(F.col("p")).alias("text"))


@query("condition_text", sql(f"""SELECT cluster, trajectory, {condition_sql('trajectory', 'p')} AS text FROM (
    SELECT cluster, trajectory, 100e0 * count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS p
    FROM res GROUP BY cluster, trajectory)""", "res"))
def condition_sentences(spark, d):
    from pyspark.sql import Window
    n = H.habitat_results(X.profiles(spark, d)).groupBy("cluster", "trajectory").agg(F.count("*").alias("n"))
    p = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return n.withColumn("p", p).select("cluster", "trajectory", L.condition_text(F.col("trajectory"), F.col("p")).alias("text"))


def _shares(src: str) -> str:
    return ", ".join(f"100e0 * avg(CASE WHEN archetype = '{c}' THEN 1e0 ELSE 0e0 END) AS {k}" for k, c in
                     [("h", "Highly suitable"), ("m", "Moderately suitable"), ("u", "Unsuitable")]) + \
        ", avg(score) AS mean_p FROM " + src


@query("score_summary_text", sql(f"""SELECT site, {score_text('h', 'm', 'u', 'mean_p')} AS text FROM (SELECT site, {_shares(
    "(SELECT site, score, " + suit_class('score', 'water_mask') + " AS archetype FROM idx)")} GROUP BY site)""", "idx"))
def score_sentences(spark, d):
    df = X.indices(spark, d).withColumn("archetype", L.suitability_class(F.col("score"), F.col("water_mask")))

    def share(c):
        return 100.0 * F.avg((F.col("archetype") == c).cast("double"))

    g = df.groupBy("site").agg(share("Highly suitable").alias("h"), share("Moderately suitable").alias("m"),
                               share("Unsuitable").alias("u"), F.avg("score").alias("mean_p"))
    return g.select("site", L.score_summary_text(*[F.col(c) for c in ("h", "m", "u", "mean_p")]).alias("text"))


@query("cluster_label", sql(f"""SELECT ix, iy, {cluster_label_sql('flood_frequency', '"NDVI_mean"', '"NDVI_trend"')} AS label
    FROM prof""", "prof"))
def cell_labels(spark, d):
    return X.profiles(spark, d).select("ix", "iy", L.cluster_label(
        F.col("flood_frequency"), F.col("NDVI_mean"), F.col("NDVI_trend")).alias("label"))


@query("fill_zero", sql(f"""SELECT CAST(year(dekad) AS INTEGER) AS year, count(*) AS n_rows, CAST(sum(n_observations) AS BIGINT) AS n_observations,
    count(*) FILTER (WHERE n_observations = 0) AS n_zero, {r6('sum(shannon_diversity)', 'shannon')} FROM mi GROUP BY 1""", "mi"))
def zero_filled(spark, d):
    return X.model_input(spark, d).groupBy(F.year("dekad").alias("year")).agg(
        F.count("*").alias("n_rows"), F.sum("n_observations").alias("n_observations"),
        F.count(F.when(F.col("n_observations") == 0, 1)).alias("n_zero"), rounded(F.sum("shannon_diversity")).alias("shannon"))
