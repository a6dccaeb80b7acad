"""Queries for sources, sinks, the scene catalogue and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import fixtures as X
from catalog.registry import query, rounded, tidy
from catalog.sqlkit import CTES, IDX, avgs, r6, rcols, sql, tiles_sql
from marshline import constants as K
from marshline.operators import pixels as P, scenes as C, sightings as B
from marshline.plans import areas
from marshline.session import new_path
from marshline.sources import manifest as M, tables as T

_SIGHT_COUNTS = f"""count(*) AS n_rows, count(species) AS n_named, {r6('sum(lat)', 'sum_lat', 4)}"""


def _sight_counts(df, key, lat="lat"):
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.count("species").alias("n_named"),
                               rounded(F.sum(F.col(lat).cast("double")), 4).alias("sum_lat"))


@query("read_delimited_sightings", sql(f"SELECT type AS family, {_SIGHT_COUNTS} FROM rawsight WHERE is_ebird GROUP BY type",
                                       "rawsight"))
def read_delimited(spark, d):
    path = new_path(spark, "ebird")
    X.ebird_raw(spark, d).write.csv(path, header=True, sep="\t", emptyValue="")
    return _sight_counts(T.read_delimited_sightings(spark, path), "family", "decimalLatitude")


@query("unwrap_quoted_lines", "SELECT p_name || ',' || p_brand AS line, count(*) AS n_rows FROM part GROUP BY 1")
def unwrap(spark, d):
    lines = X.table(spark, d, "part").select(F.concat(F.lit('"'), "p_name", F.lit(","), "p_brand", F.lit('",,, \t')).alias("value"))
    return B.unwrap_quoted_lines(lines).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n_rows"))


@query("resolve_column_aliases", sql(f"SELECT type AS family, {_SIGHT_COUNTS}, count(DISTINCT brand) AS n_orders FROM rawsight "
                                     "WHERE is_ebird GROUP BY type", "rawsight"))
def aliases(spark, d):
    df = B.resolve_column_aliases(X.ebird_raw(spark, d))
    return df.groupBy("family").agg(F.count("*").alias("n_rows"), F.count("species").alias("n_named"),
                                    rounded(F.sum(F.col("lat").cast("double")), 4).alias("sum_lat"),
                                    F.count_distinct("order").alias("n_orders"))


@query("read_inat_sightings", sql(f"SELECT taxon, {_SIGHT_COUNTS} FROM rawsight WHERE NOT is_ebird GROUP BY taxon", "rawsight"))
def read_inat(spark, d):
    path = new_path(spark, "inat")
    X.inat_raw(spark, d).withColumn("license", F.lit("CC-BY")).write.csv(path, header=True)
    df = T.read_inat_sightings(spark, path).withColumnsRenamed({"scientific_name": "species", "iconic_taxon_name": "taxon"})
    return _sight_counts(df, "taxon", "latitude")


_YEARLY = f"CAST(year(dekad) AS INTEGER) AS year, count(*) AS n_rows, {r6('avg(\"NDVI\")', 'ndvi')}, CAST(sum(n_observations) AS BIGINT) AS n_birds"


def _yearly(df):
    return df.groupBy(F.year("dekad").alias("year")).agg(
        F.count("*").alias("n_rows"), rounded(F.avg("NDVI")).alias("ndvi"), F.sum("n_observations").alias("n_birds"))


@query("read_model_input", sql(f"SELECT {_YEARLY} FROM mi GROUP BY 1", "mi"))
def read_mi(spark, d):
    path = new_path(spark, "model_input")
    T.write_table(X.model_input(spark, d), path)
    return _yearly(T.read_model_input(spark, path))


@query("read_pixels", sql(f"SELECT tile_id, CAST(year(time) AS INTEGER) AS year, count(*) AS n_rows, {r6('avg(nir)', 'nir')} FROM pix "
                          "WHERE tile_id IN (0, 4) AND year(time) IN (2021, 2023) GROUP BY 1, 2", "pix"))
def read_px(spark, d):
    path = new_path(spark, "pixels")
    T.write_table(X.pixels(spark, d).withColumn("year", F.year("time")), path, partition_by=["tile_id", "year"])
    return T.read_pixels(spark, path, [0, 4], [2021, 2023]).groupBy("tile_id", "year").agg(
        F.count("*").alias("n_rows"), rounded(F.avg("nir")).alias("nir"))


@query("prefer_enriched_source", sql("SELECT tile_id, count(*) AS n_rows FROM pix WHERE flag = 'R' GROUP BY tile_id", "pix"))
def enriched(spark, d):
    df = X.pixels(spark, d).withColumn("is_enriched", F.col("flag") == "R")
    return C.prefer_enriched_source(df).groupBy("tile_id").agg(F.count("*").alias("n_rows"))


@query("search_scenes", sql("""SELECT scene_id, datetime, cloud_cover FROM scn WHERE cloud_cover < 30
    AND datetime BETWEEN DATE '2025-05-31' AND DATE '2025-06-30' AND west <= -90.45e0 AND east >= -90.55e0
    AND south <= 29.07e0 AND north >= 29.02e0 ORDER BY datetime DESC, scene_id""", "scn"))
def search(spark, d):
    return C.search_scenes(X.scenes(spark, d), (-90.55, 29.02, -90.45, 29.07), X.NOW - dt.timedelta(days=30), X.NOW).select(
        "scene_id", "datetime", "cloud_cover")


@query("clip_scene_pixels", sql("""SELECT tile_id, count(*) AS n_rows, count(swir1) AS n_swir1 FROM pix WHERE lon BETWEEN -90.55e0 AND -90.45e0
    AND lat BETWEEN 29.02e0 AND 29.07e0 GROUP BY tile_id""", "pix"))
def clip(spark, d):
    return P.clip_scene_pixels(X.pixels(spark, d), (-90.55, 29.02, -90.45, 29.07)).groupBy("tile_id").agg(
        F.count("*").alias("n_rows"), F.count("swir1").alias("n_swir1"))


@query("resample_match", sql(f"""SELECT f.tile_id, count(*) AS n_rows, CAST(sum(c.swir1) AS BIGINT) AS swir1, {r6('avg(f.green)', 'green')}
    FROM (SELECT tile_id, time, px, py, avg(green) AS green FROM pix GROUP BY ALL) f
    LEFT JOIN (SELECT tile_id, time, px // 2 AS cpx, py // 2 AS cpy, max(swir1) AS swir1 FROM pix GROUP BY ALL) c
    ON f.tile_id = c.tile_id AND f.time = c.time AND f.px // 2 = c.cpx AND f.py // 2 = c.cpy GROUP BY f.tile_id""", "pix"))
def resample(spark, d):
    px = X.pixels(spark, d)
    fine = px.groupBy("tile_id", "time", "px", "py").agg(F.avg("green").alias("green"))
    coarse = px.groupBy("tile_id", "time", F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py")).agg(
        F.max("swir1").alias("swir1"))
    return P.resample_match(fine, coarse, ["tile_id", "time"], ["swir1"]).groupBy("tile_id").agg(
        F.count("*").alias("n_rows"), F.sum("swir1").alias("swir1"), rounded(F.avg("green")).alias("green"))


@query("pending_tiles", sql("""SELECT tile_id, period FROM (SELECT DISTINCT tile_id, time AS period FROM pix) w
    WHERE NOT EXISTS (SELECT 1 FROM scn WHERE scn.tile_id = w.tile_id AND scn.datetime = w.period AND scn.status_code = 'F')""",
                            "pix", "scn"))
def pending(spark, d):
    wanted = X.pixels(spark, d).select("tile_id", F.col("time").alias("period")).distinct()
    status = F.when(F.col("status_code") == "F", "finished").when(F.col("status_code") == "P", "error")
    manifest = X.scenes(spark, d).select("tile_id", F.col("datetime").alias("period"), status.alias("status"))
    return C.pending_tiles(wanted, manifest)


@query("tile_manifest", sql("""SELECT tile_id, time AS period, CASE WHEN max(CAST(scl IN (4, 5, 6, 7, 11) AS INTEGER)) = 1 THEN 'finished' ELSE 'error' END AS status,
    CASE WHEN max(CAST(scl IN (4, 5, 6, 7, 11) AS INTEGER)) = 1 THEN 1 ELSE 2 END AS attempt,
    CASE WHEN max(CAST(scl IN (4, 5, 6, 7, 11) AS INTEGER)) = 1 THEN count(*) END AS n_pixels FROM pix GROUP BY tile_id, time""", "pix"))
def manifest_loop(spark, d):
    """Tiles are counted until none is open; those without a clear pixel are tried twice."""
    pixels = X.pixels(spark, d).withColumn("period", F.col("time"))
    keys, path = ["tile_id", "period"], new_path(spark, "tiles")
    wanted = pixels.select(*keys).distinct()

    def work(todo):
        clear = F.max(F.coalesce(F.col("scl").isin(*K.SCL_KEEP["live"]), F.lit(False)))
        return pixels.join(todo, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n_pixels"), clear.alias("clear"))

    while M.process_pending(wanted, path, work, F.col("clear"), max_attempts=2):
        pass
    done = M.read_tiles(spark, path, wanted).select(*keys, "n_pixels")
    return M.read_manifest(spark, path, wanted).join(done, keys, "left").select(*keys, "status", "attempt", "n_pixels")


@query("write_table", sql(f"SELECT {_YEARLY} FROM mi GROUP BY 1", "mi"))
def write_csv(spark, d):
    path = new_path(spark, "csv")
    mi = X.model_input(spark, d)
    T.write_table(mi, path, "csv")
    return _yearly(T.read_model_input(spark, path, "csv", mi.schema))


@query("write_report", sql(f"""SELECT count(*) AS n_rows, min(dekad) AS first_date, max(dekad) AS last_date,
    {r6('100e0 * avg(CASE WHEN n_observations > 0 THEN 1e0 ELSE 0e0 END)', 'pct_with_birds')} FROM mi""", "mi"))
def report(spark, d):
    from marshline.operators.profiles import dataset_summary
    path = new_path(spark, "report")
    one = dataset_summary(X.model_input(spark, d))
    T.write_report(one.select(F.struct(*one.columns).alias("summary")), path)
    back = spark.read.schema("summary struct<n_rows: bigint, first_date: date, last_date: date, pct_with_birds: double>").json(path)
    return tidy(back.select("summary.*"), ["n_rows", "first_date", "last_date"], ["pct_with_birds"])


@query("union_sightings", sql("SELECT source, count(*) AS n_rows, count(\"order\") AS n_orders, count(species) AS n_named, "
                              "CAST(sum(\"count\") AS BIGINT) AS n_birds FROM obs GROUP BY source", "obs"))
def union_obs(spark, d):
    return X.observations(spark, d).groupBy("source").agg(
        F.count("*").alias("n_rows"), F.count("order").alias("n_orders"), F.count("species").alias("n_named"),
        F.sum("count").alias("n_birds"))


@query("union_tiles", sql("""SELECT 'tile' || tile_id AS source_tile, count(*) AS n_rows, count(swir1) AS n_swir1
    FROM (SELECT tile_id, CASE WHEN tile_id % 2 = 0 THEN swir1 END AS swir1 FROM pix) GROUP BY 1""", "pix"))
def stack_tiles(spark, d):
    px = X.pixels(spark, d).withColumn("source_tile", F.concat(F.lit("tile"), F.col("tile_id").cast("string")))
    even, odd = px.where(F.col("tile_id") % 2 == 0), px.where(F.col("tile_id") % 2 == 1).drop("swir1")
    return C.union_tiles([even, odd]).groupBy("source_tile").agg(F.count("*").alias("n_rows"), F.count("swir1").alias("n_swir1"))


@query("stack_scenes_over_time", sql("""SELECT time, count(*) AS n_rows, count(nir) AS n_nir
    FROM (SELECT time, CASE WHEN flag <> 'N' THEN nir END AS nir FROM pix) GROUP BY time""", "pix"))
def stack_scenes(spark, d):
    px = X.pixels(spark, d)
    return C.stack_scenes_over_time([px.where("flag <> 'N'"), px.where("flag = 'N'").drop("nir")]).groupBy("time").agg(
        F.count("*").alias("n_rows"), F.count("nir").alias("n_nir"))


# --- scenes and latest cells ---------------------------------------------------
_RECENT = f"BETWEEN DATE '{X.NOW - dt.timedelta(days=180)}' AND DATE '{X.NOW}'"
CTES |= {
    "recent_scn": (f"SELECT * FROM scn WHERE cloud_cover < 40 AND datetime {_RECENT}", ["scn"]),
    "scn_tile": (tiles_sql("recent_scn", "west", "east", "south", "north", "scene_id, datetime, cloud_cover"), ["recent_scn"]),
    "short": ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY datetime DESC, scene_id) AS rn "
              "FROM scn_tile)", ["scn_tile"]),
    "recent_idx": (f"SELECT * FROM idx WHERE time {_RECENT}", ["idx"]),
    "idx_tile": (tiles_sql("recent_idx", "lon", "lon", "lat", "lat", f"scene_id, scl, ix, iy, {IDX}"), ["recent_idx"]),
    "share": ("SELECT tile, scene_id, coalesce(avg(CASE WHEN scl > 0 THEN CAST(scl IN (8, 9, 10) AS INTEGER) END), 1e0) AS cf "
              "FROM idx_tile JOIN short USING (tile, scene_id) GROUP BY tile, scene_id", ["idx_tile", "short"]),
    "chosen": ("SELECT * FROM (SELECT short.*, cf, row_number() OVER (PARTITION BY tile ORDER BY datetime DESC, scene_id) AS r2 "
               "FROM short JOIN share USING (tile, scene_id) WHERE cf * 100 <= 15) WHERE r2 = 1", ["short", "share"]),
    "tile_cells": ("SELECT tile, ix, iy, " + ", ".join(
        f'avg(CASE WHEN scl NOT IN (0, 1, 8, 9) THEN "{c}" END) AS "{c}"' for c in K.INDICES)
        + " FROM idx_tile JOIN chosen USING (tile, scene_id) GROUP BY tile, ix, iy HAVING avg(CASE WHEN scl NOT IN (0, 1, 8, 9) "
          "THEN water_mask END) IS NOT NULL", ["idx_tile", "chosen"]),
    "latest_merged": (f"SELECT ix, iy, {avgs(K.INDICES)} FROM tile_cells GROUP BY ix, iy", ["tile_cells"]),
}
_ALL = " AND ".join(f'"{c}" IS NOT NULL' for c in K.INDICES)


def chosen_scenes(spark, d):
    return C.clearest_scene_per_tile(X.scenes(spark, d), X.pixels(spark, d), X.BOX, X.NOW)


@query("cloud_fraction", sql(f"""SELECT tile_id, {r6('coalesce(avg(CASE WHEN scl > 0 THEN CAST(scl IN (8, 9, 10) AS INTEGER) END), 1e0)',
    'cloud_fraction')} FROM pix GROUP BY tile_id""", "pix"))
def clouds(spark, d):
    return tidy(P.cloud_fraction(X.pixels(spark, d), ["tile_id"]), ["tile_id"], ["cloud_fraction"])


@query("clearest_scene_per_tile", sql(f"SELECT tile AS tile_id, scene_id, datetime, cloud_cover, {r6('cf', 'cloud_fraction')} FROM chosen",
                                      "chosen"))
def clearest(spark, d):
    return tidy(chosen_scenes(spark, d), ["tile_id", "scene_id", "datetime", "cloud_cover"], ["cloud_fraction"])


@query("middle_scene_date", sql("""SELECT tile_id, datetime AS middle_date, n AS n_scenes FROM (SELECT tile_id, datetime,
    row_number() OVER (PARTITION BY tile_id ORDER BY datetime) - 1 AS pos, count(*) OVER (PARTITION BY tile_id) AS n FROM scn)
    WHERE pos = n // 2""", "scn"))
def middle(spark, d):
    return C.middle_scene_date(X.scenes(spark, d), ["tile_id"])


@query("tile_metadata", sql(f"""SELECT tile AS tile_id, scene_id, datetime AS source_date, cloud_cover, coalesce(cells, 0) AS cells,
    coalesce(coverage, 0e0) AS coverage FROM chosen LEFT JOIN (SELECT tile, count(*) AS cells,
    round_even(avg(CASE WHEN {_ALL} THEN 1e0 ELSE 0e0 END), 3) AS coverage FROM tile_cells GROUP BY tile) USING (tile)""",
                            "chosen", "tile_cells"))
def metadata(spark, d):
    chosen = chosen_scenes(spark, d)
    cells = areas.latest_tile_cells(X.pixels(spark, d), chosen, X.BOX, X.GRID, X.NOW)
    return C.tile_metadata(cells, chosen)


@query("latest_cells", sql(f"SELECT ix, iy, {rcols(K.INDICES)} FROM latest_merged", "latest_merged"))
def latest(spark, d):
    out = areas.latest_cells(X.scenes(spark, d), X.pixels(spark, d), X.BOX, X.NOW, X.GRID)
    return tidy(out, ["ix", "iy"], K.INDICES)


@query("cache_metadata", sql(f"""SELECT n_cells, index_coverage, n_scenes, start_date, end_date FROM (SELECT count(*) AS n_cells,
    round_even(coalesce(avg(CASE WHEN {_ALL} THEN 1e0 ELSE 0e0 END), 0e0), 3) AS index_coverage FROM latest_merged),
    (SELECT count(*) AS n_scenes, min(datetime) AS start_date, max(datetime) AS end_date FROM chosen)""", "latest_merged", "chosen"))
def cache_meta(spark, d):
    from marshline.session import stage
    chosen = stage(chosen_scenes(spark, d), "chosen")
    cells = stage(areas.latest_tile_cells(X.pixels(spark, d), chosen, X.BOX, X.GRID, X.NOW), "tile_cells")
    out = C.cache_metadata(P.dedupe_overlaps(cells, ["ix", "iy"]), C.tile_metadata(cells, chosen),
                           strategy="clearest single scene per tile")
    return out.select("n_cells", "index_coverage", "n_scenes", "start_date", "end_date")


@query("index_coverage", sql(f"""SELECT tile_id, {r6(f'avg(CASE WHEN {_ALL} THEN 1e0 ELSE 0e0 END)', 'coverage')}
    FROM idx GROUP BY tile_id""", "idx"))
def coverage(spark, d):
    return tidy(P.index_coverage(X.indices(spark, d), ["tile_id"]), ["tile_id"], ["coverage"])
