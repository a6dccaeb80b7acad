"""Latest cells and answers for drawn areas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from marshline import constants as K
from marshline.functions import geometry as G
from marshline.grid import GridSpec, assign_grid_cell, with_centers
from marshline.operators import aoi as A, pixels as P, scenes as C
from marshline.plans.habitat import pixel_indices


def latest_tile_cells(pixels: DataFrame, chosen: DataFrame, bbox, grid: GridSpec, now: dt.date,
                      nx: int = K.TILES_X, ny: int = K.TILES_Y, max_days: int = K.PREFETCH_DAYS) -> DataFrame:
    """Mean indices per tile and cell from each tile's chosen scene."""
    start = now - dt.timedelta(days=max_days)
    recent = C.in_window(pixels, start, now)
    picked = C.pixels_by_tile(recent, bbox, nx, ny).join(
        chosen.select("tile_id", "scene_id"), ["tile_id", "scene_id"], "left_semi")
    located = assign_grid_cell(pixel_indices(picked, "prefetch"), grid)
    return P.drop_missing_all(P.cell_means(located, ["tile_id", "ix", "iy"]))


def latest_cells(scenes: DataFrame, pixels: DataFrame, bbox, now: dt.date, grid: GridSpec | None = None,
                 nx: int = K.TILES_X, ny: int = K.TILES_Y, max_cloud: float = K.PREFETCH_AOI_CLOUD,
                 max_days: int = K.PREFETCH_DAYS) -> DataFrame:
    """Latest clear cell table: clearest scene per tile, masked, averaged, merged."""
    grid = grid or GridSpec(bbox)
    chosen = C.clearest_scene_per_tile(scenes, pixels, bbox, now, nx, ny, max_cloud, max_days)
    tiles = latest_tile_cells(pixels, chosen, bbox, grid, now, nx, ny, max_days)
    return with_centers(P.dedupe_overlaps(tiles, ["ix", "iy"]), grid)


def analyze_aoi(results: DataFrame, profiles: DataFrame, aois: DataFrame, grid: GridSpec,
                epsg: int = 32615, top_n: int = 5, horizon_years: int = 6) -> DataFrame:
    """One summary row per area that contains at least one scored cell."""
    measured = aois.select("aoi_id", "polys", G.polygon_area_km2(F.col("polys"), epsg).alias("area_km2"))
    matched = A.spatial_join(with_centers(results, grid), measured, grid)
    return A.summarise_aois(A.aoi_profile_join(matched, profiles, "left"), top_n, horizon_years)


def live_cells(scenes: DataFrame, pixels: DataFrame, aois: DataFrame, now: dt.date, grid: GridSpec,
               days: int = K.LIVE_DAYS, max_cloud: float = K.LIVE_MAX_CLOUD,
               limit: int | None = None) -> DataFrame:
    """Cells for areas straight from recent scenes, on each area's own grid.

    Each area uses all scenes of the window, or its newest ``limit`` if given:
    per-pixel medians over them, then cell means. Cells cover the area's bounding box.
    """
    start = now - dt.timedelta(days=days)
    window = F.lit(start), F.lit(now)
    clear = scenes.where(F.col("datetime").between(*window) & (F.col("cloud_cover") < max_cloud)).select(
        "scene_id", "datetime")
    recent = C.in_window(pixels, start, now).join(clear, "scene_id")
    framed = aois.withColumn("_b", G.polygon_bounds(F.col("polys"))).withColumn(
        "mid_lat", (F.col("_b.south") + F.col("_b.north")) / 2).drop("_b")
    inside = A.spatial_join(recent, framed, grid, "lon", "lat", refine=False)
    newest = Window.partitionBy("aoi_id").orderBy(F.desc("datetime"), F.asc("scene_id"))
    used = C.newest_per(inside.select("aoi_id", "scene_id", "datetime").distinct(), newest, limit)
    dates = C.middle_scene_date(used, ["aoi_id"]).withColumnRenamed("middle_date", "acquisition_date")
    masked = pixel_indices(inside, "live").join(used.select("aoi_id", "scene_id"), ["aoi_id", "scene_id"], "left_semi")
    medians = P.temporal_median(masked, ["aoi_id", "mid_lat", "lon", "lat"], hot_rows=None)
    lon_size = F.lit(grid.cell_km) / (F.lit(K.KM_PER_DEG_LON) * F.cos(F.radians("mid_lat")))
    keyed = medians.withColumn("cell_lon", lon_size).withColumns({
        "ix": F.floor(F.col("lon") / F.col("cell_lon")), "iy": grid.iy(F.col("lat"))})
    cells = P.drop_missing_all(P.cell_means(keyed, ["aoi_id", "cell_lon", "ix", "iy"]))
    return cells.withColumns({
        "cell_x": F.col("ix") * F.col("cell_lon") + F.col("cell_lon") / 2,
        "cell_y": grid.center_y(F.col("iy"))}).drop("cell_lon").join(dates, "aoi_id")


def aoi_cells(cells: DataFrame, aois: DataFrame, grid: GridSpec, cells_date: dt.date,
              live: DataFrame | None = None) -> DataFrame:
    """Cells to score per area: stored ones, or live ones where none is stored."""
    stored = A.spatial_join(cells, aois.select("aoi_id", "polys"), grid).withColumns({
        "acquisition_date": F.lit(cells_date), "n_scenes": F.lit(None).cast("long"), "source": F.lit("cache")})
    if live is None:
        return stored
    covered = stored.select("aoi_id").distinct()
    fresh = live.join(covered, "aoi_id", "left_anti").withColumn("source", F.lit("live"))
    return stored.unionByName(fresh, allowMissingColumns=True)


def score_aoi(cells: DataFrame, aois: DataFrame, grid: GridSpec, cells_date: dt.date, score,
              live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scored cells of every area and one summary row per area.

    ``score`` turns cells with ``acquisition_date`` into scored cells, such as
    ``SuitabilityModel.score``.
    """
    todo = aoi_cells(cells, aois, grid, cells_date, live)
    scored = score(todo)
    return scored, A.score_summary(scored)
