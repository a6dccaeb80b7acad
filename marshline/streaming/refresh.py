"""Incremental refreshes as Structured Streaming jobs.

Each micro-batch overwrites its own ``batch_id=<n>`` folder, so a batch retried
after a failure replaces its output instead of adding to it. Every ``compact_every`` batches
the folders so far are merged into one, ``upto=<n>``, which appears by an atomic rename; readers
take the last of these and the batches after it, so history is summed once and a crash at any
point leaves the same answer.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from marshline import constants as K
from marshline.functions.dates import assign_dekad
from marshline.grid import GridSpec, assign_grid_cell, with_centers
from marshline.operators import pixels as P, scenes as C
from marshline.operators.sightings import CELL_DEKAD, species_roll_up
from marshline.plans.habitat import pixel_indices
from marshline.sources.folders import children, publish, remove


def live_folders(spark: SparkSession, out: str) -> list[str]:
    """The folders that count: the last merged one and the batches after it."""
    names = [n.split("=") for n in children(spark, out) if "=" in n]
    merged = max((int(n) for kind, n in names if kind == "upto"), default=-1)
    return ([f"{out}/upto={merged}"] if merged >= 0 else []) + [
        f"{out}/batch_id={n}" for n in sorted(int(n) for kind, n in names if kind == "batch_id") if n > merged]


def _fold(batch: DataFrame, batch_id: int, out: str, merge: Callable[[DataFrame], DataFrame], compact_every: int) -> None:
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    live = live_folders(spark, out)
    if len(live) > compact_every:
        fresh = f"{out}/_merging/{uuid.uuid4().hex}"
        merge(spark.read.parquet(*live)).write.parquet(fresh)
        publish(spark, fresh, f"{out}/upto={batch_id}")
        for old in live:
            remove(spark, old)


def _live(spark: SparkSession, out: str) -> DataFrame:
    live = live_folders(spark, out)
    if not live:
        raise FileNotFoundError(f"nothing was folded into {out}")
    return spark.read.parquet(*live)


#: Which delivery a pixel came with; the newest one of a scene counts.
DELIVERY = ["delivered", "file"]


def newest_deliveries(sums: DataFrame) -> DataFrame:
    """The sums of each scene's newest file; a scene that comes again replaces what it was."""
    last = sums.groupBy("scene_id").agg(F.max(F.struct(*DELIVERY)).alias("_d")).select("scene_id", *[F.col(f"_d.{c}").alias(c) for c in DELIVERY])
    return sums.join(last, ["scene_id", *DELIVERY], "left_semi")


def scene_cell_sums(pixels: DataFrame, bbox, grid: GridSpec, nx: int, ny: int) -> DataFrame:
    """Additive state of a pixel batch per tile, scene, date, delivery and cell."""
    masked = pixel_indices(C.pixels_by_tile(pixels, bbox, nx, ny), "prefetch")
    known = F.col("scl") > 0
    return assign_grid_cell(masked, grid).groupBy("tile_id", "scene_id", "time", *DELIVERY, "ix", "iy").agg(
        *[F.sum(c).alias(f"{c}_sum") for c in K.INDICES], *[F.count(c).alias(f"{c}_n") for c in K.INDICES],
        F.count(F.when(known, 1)).alias("n_known"),
        F.count(F.when(known & F.col("scl").isin(K.SCL_CLOUD), 1)).alias("n_cloudy"))


def stream_latest_cells(spark: SparkSession, source: str, schema, out: str, checkpoint: str, bbox,
                        grid: GridSpec, nx: int = K.TILES_X, ny: int = K.TILES_Y,
                        max_files: int | None = None, compact_every: int = 16) -> StreamingQuery:
    """Fold new pixel files into additive per-scene cell sums.

    The file source remembers processed files, so a re-run touches only new
    ones. No state is kept between batches; nothing is ever late. A file holds all pixels
    of its scenes: a scene that is delivered again, as it was or corrected, replaces the earlier delivery (the newest file
    counts, of equally new ones the last by name). The sums carry file and time, so they are the ledger.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    files = reader.parquet(source).select("*", F.col("_metadata.file_modification_time").alias("delivered"), F.col("_metadata.file_path").alias("file"))
    return (files.writeStream
            .foreachBatch(lambda b, i: _fold(scene_cell_sums(b, bbox, grid, nx, ny), i, out, newest_deliveries, compact_every))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_latest_cells(spark: SparkSession, out: str, scenes: DataFrame, bbox, now: dt.date, grid: GridSpec,
                      nx: int = K.TILES_X, ny: int = K.TILES_Y, max_cloud: float = K.PREFETCH_AOI_CLOUD,
                      max_days: int = K.PREFETCH_DAYS, scene_cloud: float = K.PREFETCH_SCENE_CLOUD,
                      candidates: int | None = None) -> DataFrame:
    """Latest cell table from the folded sums: same answer as the batch plan."""
    start = now - dt.timedelta(days=max_days)
    sums = newest_deliveries(_live(spark, out)).where(F.col("time").between(F.lit(start), F.lit(now)))
    newest = Window.partitionBy("tile_id").orderBy(F.desc("datetime"), F.asc("scene_id"))
    recent = scenes.where(F.col("datetime").between(F.lit(start), F.lit(now)) & (F.col("cloud_cover") < scene_cloud))
    shortlist = C.newest_per(C.scenes_by_tile(recent, bbox, nx, ny), newest, candidates).select("tile_id", "scene_id", "datetime")
    share = F.coalesce(F.try_divide(F.sum("n_cloudy"), F.sum("n_known")), F.lit(1.0))
    seen = sums.groupBy("tile_id", "scene_id").agg(share.alias("cloud_fraction"))
    chosen = (shortlist.join(seen, ["tile_id", "scene_id"]).where(F.col("cloud_fraction") * 100 <= max_cloud)
              .withColumn("rank", F.row_number().over(newest)).where(F.col("rank") == 1))
    cells = (sums.join(chosen, ["tile_id", "scene_id"], "left_semi").groupBy("tile_id", "ix", "iy")
             .agg(*[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in K.INDICES]))
    return with_centers(P.dedupe_overlaps(P.drop_missing_all(cells), ["ix", "iy"]), grid)


def stream_bird_metrics(spark: SparkSession, source: str, schema, out: str, checkpoint: str, grid: GridSpec,
                        max_files: int | None = None, compact_every: int = 16) -> StreamingQuery:
    """Fold new sighting files into additive counts per day, cell and species.

    ``source`` rows have ``ts, lon, lat, species, count``. No state is kept
    between batches and there is no watermark: a sighting counts however late it
    arrives. Species stays in the key, which keeps species numbers and diversity
    exact after the roll-up to dekads.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def merge(counts: DataFrame) -> DataFrame:
        return counts.groupBy("day", "ix", "iy", "species").agg(F.sum("n").alias("n"), F.sum("individuals").alias("individuals"))

    def fold(batch: DataFrame, batch_id: int) -> None:
        seen = assign_grid_cell(batch, grid).groupBy(F.to_date("ts").alias("day"), "ix", "iy", "species")
        _fold(seen.agg(F.count("*").alias("n"), F.sum("count").alias("individuals")), batch_id, out, merge, compact_every)

    return (reader.parquet(source).writeStream.foreachBatch(fold)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_bird_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Bird metrics per cell and dekad from the counts of all batches."""
    species = _live(spark, out).withColumn("dekad", assign_dekad(F.col("day"))).groupBy(*CELL_DEKAD, "species").agg(
        F.sum("n").alias("n"), F.sum("individuals").alias("individuals"))
    return species_roll_up(species)
