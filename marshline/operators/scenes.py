"""Scene catalogue search and bookkeeping of tiles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline import constants as K
from marshline.operators.pixels import cloud_fraction, complete
from marshline.grid import tile_ids


def bbox_intersects(bbox) -> Column:
    w, s, e, n = bbox
    return (F.col("west") <= e) & (F.col("east") >= w) & (F.col("south") <= n) & (F.col("north") >= s)


def search_scenes(scenes: DataFrame, bbox, start: dt.date, end: dt.date, max_cloud: float = K.LIVE_MAX_CLOUD,
                  limit: int | None = None, inclusive: bool = False) -> DataFrame:
    """Scenes that touch ``bbox`` in a date range under a cloud limit, newest first; only ``limit`` of them if given."""
    clear = F.col("cloud_cover") <= max_cloud if inclusive else F.col("cloud_cover") < max_cloud
    found = (scenes.where(F.col("datetime").between(F.lit(start), F.lit(end)) & clear & bbox_intersects(bbox))
             .orderBy(F.desc("datetime"), "scene_id"))
    return found if limit is None else found.limit(limit)


def in_window(df: DataFrame, start: dt.date, end: dt.date, date: str = "time") -> DataFrame:
    """Rows in a date range; a ``year`` column is tested too, so tables partitioned by year are pruned."""
    rows = df.where(F.col(date).between(F.lit(start), F.lit(end)))
    return rows.where(F.col("year").between(start.year, end.year)) if "year" in df.columns else rows


def scenes_by_tile(scenes: DataFrame, bbox, nx: int, ny: int) -> DataFrame:
    """One row per scene and study tile it touches, found by grid arithmetic."""
    ids = tile_ids(F.col("west"), F.col("east"), F.col("south"), F.col("north"), bbox, nx, ny)
    return scenes.drop("tile_id").withColumn("tile_id", F.explode(ids))


def pixels_by_tile(pixels: DataFrame, bbox, nx: int, ny: int) -> DataFrame:
    """Pixels with the study tile they lie in; pixels outside are dropped."""
    ids = tile_ids(F.col("lon"), F.col("lon"), F.col("lat"), F.col("lat"), bbox, nx, ny)
    return pixels.drop("tile_id").withColumn("tile_id", F.explode(ids))


def newest_per(scenes: DataFrame, newest, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of the window, or all rows without a limit."""
    if limit is None:
        return scenes
    return scenes.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit).drop("rank")


def clearest_scene_per_tile(scenes: DataFrame, pixels: DataFrame, bbox, now: dt.date,
                            nx: int = K.TILES_X, ny: int = K.TILES_Y,
                            max_cloud: float = K.PREFETCH_AOI_CLOUD, max_days: int = K.PREFETCH_DAYS,
                            scene_cloud: float = K.PREFETCH_SCENE_CLOUD,
                            candidates: int | None = None) -> DataFrame:
    """Newest scene per tile whose cloud share inside the tile is low enough.

    All recent scenes are considered, or the newest ``candidates`` per tile if
    given. The list of recent scenes cuts the pixel scan down before it is
    aggregated.
    """
    start = now - dt.timedelta(days=max_days)
    recent = scenes.where(F.col("datetime").between(F.lit(start), F.lit(now))
                          & (F.col("cloud_cover") < scene_cloud))
    newest = Window.partitionBy("tile_id").orderBy(F.desc("datetime"), F.asc("scene_id"))
    shortlist = newest_per(scenes_by_tile(recent, bbox, nx, ny), newest, candidates).select(
        "tile_id", "scene_id", "datetime", "cloud_cover")
    seen = pixels_by_tile(
        in_window(pixels, start, now).where(F.col("scl").isNotNull()), bbox, nx, ny)
    share = cloud_fraction(seen.join(shortlist.select("tile_id", "scene_id"), ["tile_id", "scene_id"], "left_semi"),
                           ["tile_id", "scene_id"])
    clear = shortlist.join(share, ["tile_id", "scene_id"]).where(F.col("cloud_fraction") * 100 <= max_cloud)
    return (clear.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") == 1)
            .select("tile_id", "scene_id", "datetime", "cloud_cover", "cloud_fraction"))


def middle_scene_date(scenes: DataFrame, keys: list[str] = (), date: str = "datetime") -> DataFrame:
    """Element ``n // 2`` of the sorted scene dates, per key.

    Scenes are counted per date first, so only distinct dates are ordered.
    """
    groups = list(keys) or ["_all"]
    src = scenes if keys else scenes.withColumn("_all", F.lit(0))
    daily = src.groupBy(*groups, date).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    ranked = daily.withColumns({"upper": F.sum("c").over(upto), "n": F.sum("c").over(whole)})
    middle = F.floor(F.col("n") / F.lit(2))
    return (ranked.where((middle < F.col("upper")) & (middle >= F.col("upper") - F.col("c")))
            .select(*keys, F.col(date).alias("middle_date"), F.col("n").alias("n_scenes")))


def tile_metadata(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per tile: source scene and date, cell count and index coverage."""
    stats = cells.groupBy("tile_id").agg(
        F.count("*").alias("cells"), F.bround(F.avg(complete().cast("double")), 3).alias("coverage"))
    return chosen.join(stats, "tile_id", "left").select(
        "tile_id", "scene_id", F.col("datetime").alias("source_date"), "cloud_cover",
        F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def cache_metadata(merged: DataFrame, tiles: DataFrame, **settings) -> DataFrame:
    """One row describing a refresh: totals, date range and per-tile details.

    The tile list has one entry per study tile.
    """
    head = merged.agg(F.count("*").alias("n_cells"),
                      F.bround(F.coalesce(F.avg(complete().cast("double")), F.lit(0.0)), 3).alias("index_coverage"))
    detail = tiles.agg(F.struct(
        F.count("*").alias("n_scenes"), F.min("source_date").alias("start_date"),
        F.max("source_date").alias("end_date"),
        F.sort_array(F.collect_list(F.struct("tile_id", "scene_id", "source_date", "cloud_cover", "cells", "coverage")))
        .alias("tiles")).alias("d")).scalar()
    return head.withColumn("_d", detail).select(
        "n_cells", "index_coverage", "_d.*", *[F.lit(v).alias(k) for k, v in settings.items()])


def pending_tiles(wanted: DataFrame, manifest: DataFrame, keys: list[str] = ("tile_id", "period"),
                  reprocess: bool = False) -> DataFrame:
    """Work not yet submitted or done; failed or cancelled work counts as open."""
    if reprocess:
        return wanted
    done = manifest.where(F.col("status").isNotNull() & ~F.col("status").isin("error", "canceled"))
    return wanted.join(done, list(keys), "left_anti")


def prefer_enriched_source(df: DataFrame, flag: str = "is_enriched") -> DataFrame:
    """Only rows of index-enriched files when any exist, else all raw ones."""
    any_enriched = df.agg(F.coalesce(F.max(F.col(flag).cast("int")), F.lit(0))).scalar()
    return df.where(F.col(flag).cast("int") == any_enriched)


def union_tiles(parts: list[DataFrame]) -> DataFrame:
    """Stack tile tables; each part is expected to carry its ``source_tile``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def stack_scenes_over_time(parts: list[DataFrame]) -> DataFrame:
    """Stack scenes along time; bands one scene lacks are missing there."""
    return union_tiles(parts)
