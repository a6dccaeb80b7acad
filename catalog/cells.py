"""Queries for cell aggregation, sightings metrics and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import ORACLES, query, rounded, tidy
from catalog.sqlkit import (CTES, amplitude_list, as_list, avgs, bird_list, daily_list, dekad, r6, rcols, season_list, sql,
                            stat_list, temporal, trend_list)
from marshline import constants as K
from marshline.functions import geometry as G
from marshline.operators import pixels as P, profiles as R, sightings as B
from marshline.plans import habitat as H
from marshline.session import stage

_I = K.INDICES


@query("coarsen_blocks", sql(f"""SELECT tile_id, time, bx, "by", n_pixels, {rcols(['NDVI', 'NDWI', 'water_mask'])} FROM (
    SELECT tile_id, time, px // 5 AS bx, py // 5 AS "by", count(*) AS n_pixels, {avgs(['NDVI', 'NDWI', 'water_mask'])} FROM idx GROUP BY ALL)
    JOIN (SELECT tile_id, (max(px) + 1) // 5 AS nx, (max(py) + 1) // 5 AS ny FROM idx GROUP BY tile_id) USING (tile_id)
    WHERE bx < nx AND "by" < ny""", "idx"))
def coarsen(spark, d):
    out = P.coarsen_blocks(H.pixel_indices(X.pixels(spark, d)), 5, ["NDVI", "NDWI", "water_mask"])
    return tidy(out, ["tile_id", "time", "bx", "by", "n_pixels"], ["NDVI", "NDWI", "water_mask"])


@query("cell_means", sql(f"SELECT ix, iy, dekad, {rcols(_I)} FROM (SELECT ix, iy, dekad, {avgs(_I)} FROM idx GROUP BY ALL)", "idx"))
def means(spark, d):
    return tidy(P.cell_means(X.indices(spark, d), ["ix", "iy", "dekad"]), ["ix", "iy", "dekad"], _I)


@query("temporal_median", sql("SELECT px, py, " + ", ".join(r6(f'median("{c}")', c) for c in ["NDVI", "NDWI", "EVI"])
                              + " FROM (SELECT px, py, " + ", ".join(
    f'CASE WHEN scl IN (4, 5, 6, 7, 11) THEN "{c}" END AS "{c}"' for c in ["NDVI", "NDWI", "EVI"]) + " FROM idx) GROUP BY px, py", "idx"))
def medians(spark, d):
    df = H.pixel_indices(X.pixels(spark, d), "live")
    return tidy(P.temporal_median(df, ["px", "py"], ["NDVI", "NDWI", "EVI"]), ["px", "py"], ["NDVI", "NDWI", "EVI"])


CTES["idxraw"] = (f"SELECT *, {dekad('time')} AS dekad FROM pix", ["pix"])


@query("dekadal_composite", sql("SELECT tile_id, px, py, dekad, " + ", ".join(r6(f"median({b})", b) for b in K.BANDS)
                                + " FROM idxraw WHERE scl NOT IN (0, 1, 2, 3, 8, 9, 10) GROUP BY tile_id, px, py, dekad", "idxraw"))
def composite(spark, d):
    return tidy(P.dekadal_composite(X.pixels(spark, d)), ["tile_id", "px", "py", "dekad"], K.BANDS)


@query("dedupe_overlaps", sql(f"SELECT ix, iy, dekad, {rcols(_I)} FROM sat", "sat"))
def dedupe(spark, d):
    return tidy(H.cell_dekads(B.filter_years(X.pixels(spark, d), date="time"), X.GRID, sparse=True), ["ix", "iy", "dekad"], _I)


@query("cell_bird_metrics", sql("SELECT ix, iy, dekad, n_observations, n_species, n_individuals FROM bird", "bird"))
def bird_counts(spark, d):
    return B.cell_bird_metrics(X.observations(spark, d))


@query("shannon_diversity", sql(f"SELECT ix, iy, dekad, {rcols(['shannon_diversity'])} FROM bird", "bird"))
def shannon(spark, d):
    return tidy(B.shannon_diversity(X.observations(spark, d)), ["ix", "iy", "dekad"], ["shannon_diversity"])


@query("top_orders", sql("SELECT * FROM toporder", "toporder"))
def top_orders(spark, d):
    return B.top_orders(X.observations(spark, d))


@query("top_order_pivot", sql("""SELECT b.ix, b.iy, b.dekad, 'n_' || replace(t."order", ' ', '_') AS order_column,
    count(o."order") AS n FROM bird b JOIN toporder t ON true LEFT JOIN obs o ON o.ix = b.ix AND o.iy = b.iy AND o.dekad = b.dekad
    AND o."order" = t."order" GROUP BY ALL""", "bird", "toporder", "obs"))
def order_pivot(spark, d):
    obs = X.observations(spark, d)
    wide = B.top_order_pivot(obs, B.top_order_names(obs))
    cols = [c for c in wide.columns if c.startswith("n_")]
    return wide.unpivot(["ix", "iy", "dekad"], cols, "order_column", "n")


@query("join_bird_metrics", sql(f"""SELECT ix, iy, dekad, {rcols(['NDVI'])}, n_observations, n_species, n_individuals,
    {rcols(['shannon_diversity'])} FROM mi""", "mi"))
def join_birds(spark, d):
    return tidy(X.model_input(spark, d), ["ix", "iy", "dekad", "n_observations", "n_species", "n_individuals"],
                ["NDVI", "shannon_diversity"])


_TEMP = ["year", "month", "day_of_year", "bird_season"]


@query("model_input", sql(f"""SELECT ix, iy, dekad, {rcols(_I)}, {', '.join(_TEMP)}, {rcols(['doy_sin', 'doy_cos'])}, n_observations,
    n_species, n_individuals, {rcols(['shannon_diversity'])} FROM mi""", "mi"))
def model_input(spark, d):
    return tidy(X.model_input(spark, d), ["ix", "iy", "dekad", *_TEMP, "n_observations", "n_species", "n_individuals"],
                [*_I, "doy_sin", "doy_cos", "shannon_diversity"])


def projected_pixels(spark, d):
    """The pixels as projected rasters deliver them: two of three tiles in metres of their zones, some without naming the zone."""
    px, zone = X.pixels(spark, d), F.col("tile_id") % 3
    code = F.when(zone == 0, 32615).when(zone == 1, 32616)
    x, y = G.to_utm(F.col("lon"), F.col("lat"), F.coalesce(code, F.lit(32615)))
    return px.withColumns({"x": F.when(code.isNull(), F.col("lon")).otherwise(x), "y": F.when(code.isNull(), F.col("lat")).otherwise(y),
                           "epsg": F.when(F.dayofmonth("time") % 2 == 0, code)}).drop("lon", "lat")


@query("locate_pixels", sql(f"""SELECT tile_id, count(*) AS n_rows, {r6('avg(lon)', 'lon')}, {r6('avg(lat)', 'lat')} FROM pix GROUP BY tile_id""", "pix"))
def located(spark, d):
    df = P.locate_pixels(projected_pixels(spark, d), epsg="epsg")
    return tidy(df.groupBy("tile_id").agg(F.count("*").alias("n_rows"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")), ["tile_id", "n_rows"], ["lon", "lat"])


@query("projected_model_input", ORACLES["model_input"])
def projected_input(spark, d):
    px = P.locate_pixels(projected_pixels(spark, d), epsg="epsg")
    mi = H.model_input(px, X.observations(spark, d), X.GRID, order_names=[], sparse=True)
    return tidy(mi, ["ix", "iy", "dekad", *_TEMP, "n_observations", "n_species", "n_individuals"], [*_I, "doy_sin", "doy_cos", "shannon_diversity"])


def _profile(name: str, pairs, fn):
    names = [n for n, _ in pairs]

    @query(name, sql(f"SELECT ix, iy, {rcols(names)} FROM (SELECT ix, iy, {as_list(pairs)} FROM mi GROUP BY ix, iy)", "mi"))
    def run(spark, d):
        return tidy(fn(X.model_input(spark, d)), ["ix", "iy"], names)


_profile("index_stats", stat_list(_I), R.index_stats)
_profile("seasonal_means", season_list(_I), R.seasonal_means)
_profile("trend_slope", trend_list(), R.trend_slope)
_profile("flood_frequency", [("flood_frequency", "avg(water_mask)")], R.flood_frequency)
_profile("hydroperiod_variability", [("hydroperiod_variability", 'stddev_samp("NDWI")')], R.hydroperiod_variability)
_profile("seasonal_amplitude", amplitude_list(), R.seasonal_amplitude)
_profile("bird_summary", bird_list() + [("has_bird_data", "CAST(sum(n_observations) > 0 AS INTEGER)")], R.bird_summary)

_YEARLY_STD = (f"SELECT ix, iy, {', '.join(f'stddev_samp(\"{c}\") AS \"{c}_interannual_std\"' for c in _I)} FROM "
               f"(SELECT ix, iy, year, {avgs(_I)} FROM mi GROUP BY ix, iy, year) GROUP BY ix, iy")


@query("interannual_std", sql(f"SELECT ix, iy, {rcols([f'{c}_interannual_std' for c in _I])} FROM ({_YEARLY_STD})", "mi"))
def yearly_std(spark, d):
    return tidy(R.interannual_std(X.model_input(spark, d)), ["ix", "iy"], [f"{c}_interannual_std" for c in _I])


@query("trend_slope_daily", sql("SELECT ix, iy, " + ", ".join(r6(e, n, 9) for n, e in daily_list("time"))
                                + " FROM idx GROUP BY ix, iy", "idx"))
def daily_slope(spark, d):
    return tidy(R.trend_slope_daily(X.indices(spark, d)), ["ix", "iy"], [f"{c}_trend" for c in K.DAILY_TREND_INDICES], 9)


@query("order_totals", sql("""SELECT c.ix, c.iy, 'n_' || t."order" || '_total' AS order_column, count(o."order") AS n
    FROM (SELECT DISTINCT ix, iy FROM mi) c JOIN toporder t ON true
    LEFT JOIN (SELECT obs.* FROM obs JOIN mi USING (ix, iy, dekad)) o ON o.ix = c.ix AND o.iy = c.iy AND o."order" = t."order"
    GROUP BY ALL""", "mi", "toporder", "obs"))
def order_sums(spark, d):
    names = B.top_order_names(X.observations(spark, d))
    wide = R.order_totals(X.model_input(spark, d, names))
    cols = [c for c in wide.columns if c.endswith("_total")]
    return wide.unpivot(["ix", "iy"], cols, "order_column", "n")


_FULL = (stat_list(_I) + season_list(_I) + trend_list() + [("flood_frequency", "avg(water_mask)"),
         ("hydroperiod_variability", 'stddev_samp("NDWI")')] + amplitude_list() + bird_list())
_STD = [f"{c}_interannual_std" for c in _I]
CTES["rawprof"] = (f"SELECT ix, iy, {as_list(_FULL)}, CAST(sum(n_observations) > 0 AS INTEGER) AS has_bird_data FROM mi GROUP BY ix, iy", ["mi"])
CTES["yearstd"] = (_YEARLY_STD, ["mi"])
CTES["rawall"] = ("SELECT * FROM rawprof JOIN yearstd USING (ix, iy)", ["rawprof", "yearstd"])
_FULL_NAMES = [n for n, _ in _FULL] + _STD
CTES["fullprof"] = ("SELECT ix, iy, has_bird_data, " + ", ".join(
    f'coalesce("{n}", median("{n}") OVER ()) AS "{n}"' for n in _FULL_NAMES) + " FROM rawall", ["rawall"])


@query("cell_profiles", sql(f"SELECT ix, iy, has_bird_data, {rcols(_FULL_NAMES)} FROM fullprof", "fullprof"))
def cell_profiles(spark, d):
    return tidy(H.cell_profiles(stage(X.model_input(spark, d), "model_input")), ["ix", "iy", "has_bird_data"], _FULL_NAMES)


@query("impute_column_median", sql("SELECT ix, iy, " + ", ".join(
    r6(f'coalesce(v, median(v) OVER ())', 'MNDWI_wet') for _ in [0]) + """ FROM (SELECT ix, iy,
    avg("MNDWI") FILTER (WHERE water_mask > 0.6) AS v FROM sat GROUP BY ix, iy)""", "sat"))
def impute(spark, d):
    sat = H.cell_dekads(B.filter_years(X.pixels(spark, d), date="time"), X.GRID, sparse=True)
    gaps = stage(sat.groupBy("ix", "iy").agg(F.avg(F.when(F.col("water_mask") > 0.6, F.col("MNDWI"))).alias("MNDWI_wet")), "gaps")
    return tidy(R.impute_column_median(gaps, ["MNDWI_wet"]), ["ix", "iy"], ["MNDWI_wet"])


@query("drop_empty_columns", sql(f"SELECT ix, iy, {r6('avg(\"NDVI\")', 'NDVI')} FROM idx GROUP BY ix, iy", "idx"))
def drop_empty(spark, d):
    df = X.indices(spark, d).groupBy("ix", "iy").agg(rounded(F.avg("NDVI")).alias("NDVI"),
                                                     F.avg(F.when(F.col("scl") > 99, F.col("NDVI"))).alias("never"))
    return R.drop_empty_columns(stage(df, "columns"))


_SUM = (stat_list([*_I, *K.BANDS], median=False) + season_list([*_I, *K.BANDS]) + [("flood_frequency", "avg(water_mask)"),
        ("hydroperiod_variability", 'stddev_samp("NDWI")')])
_SUM_NAMES = [n for n, _ in _SUM]


@query("cell_summary", sql(f"SELECT ix, iy, {rcols(_SUM_NAMES)}, {rcols([f'{c}_trend' for c in K.DAILY_TREND_INDICES], 9)} FROM ("
                           f"SELECT ix, iy, {as_list(_SUM + daily_list('time'))} FROM (SELECT *, {temporal('time')} FROM idx) GROUP BY ix, iy)", "idx"))
def summary(spark, d):
    df = R.cell_summary(H.temporal_features(X.indices(spark, d), "time"))
    return df.select("ix", "iy", *[rounded(n).alias(n) for n in _SUM_NAMES],
                     *[rounded(f"{c}_trend", 9).alias(f"{c}_trend") for c in K.DAILY_TREND_INDICES])


_TS = [*K.BANDS, *_I]


@query("cell_timeseries", sql(f"""SELECT source_tile, time, bx, "by", {rcols(_TS)}, {', '.join(_TEMP)}, {rcols(['doy_sin', 'doy_cos'])} FROM (
    SELECT *, 'tile' || tile_id || '_' || year(time) AS source_tile, {temporal('time')} FROM (
    SELECT tile_id, time, px // 5 AS bx, py // 5 AS "by", {avgs(_TS)} FROM idx GROUP BY ALL)
    JOIN (SELECT tile_id, (max(px) + 1) // 5 AS nx, (max(py) + 1) // 5 AS ny FROM idx GROUP BY tile_id) USING (tile_id)
    WHERE bx < nx AND "by" < ny)""", "idx"))
def timeseries(spark, d):
    return tidy(H.cell_timeseries(X.pixels(spark, d), 5), ["source_tile", "time", "bx", "by", *_TEMP], [*_TS, "doy_sin", "doy_cos"])


@query("dataset_summary", sql(f"""SELECT count(*) AS n_rows, count(DISTINCT (ix, iy)) AS n_cells, count(DISTINCT dekad) AS n_dates,
    min(dekad) AS first_date, max(dekad) AS last_date,
    {r6('100e0 * avg(CASE WHEN n_observations > 0 THEN 1e0 ELSE 0e0 END)', 'pct_with_birds')} FROM mi""", "mi"))
def data_summary(spark, d):
    return tidy(R.dataset_summary(X.model_input(spark, d)), ["n_rows", "n_cells", "n_dates", "first_date", "last_date"],
                ["pct_with_birds"])
