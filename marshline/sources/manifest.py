"""Tiles that are processed once each, whatever is interrupted.

A run writes its tiles to a folder of its own and then publishes one folder of manifest records by an atomic rename. Tiles count only through their
records, so what a run wrote before it died is never read and its tiles are open again. Records are only ever added; the last attempt of a tile
counts. Tiles that came back unusable are recorded as errors and are open again until ``max_attempts``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marshline.operators.scenes import pending_tiles
from marshline.sources.folders import children, publish

KEYS = ("tile_id", "period")


def read_manifest(spark: SparkSession, path: str, wanted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last record of each tile: keys, attempt, status, folder. ``wanted`` gives the keys' types where nothing is recorded yet."""
    runs = children(spark, f"{path}/manifest")
    if not runs:
        return wanted.select(*keys, F.lit(0).alias("attempt"), F.lit("").alias("status"), F.lit("").alias("folder")).where("false")
    records = spark.read.parquet(*[f"{path}/manifest/{r}" for r in runs])
    last = records.groupBy(*keys).agg(F.max(F.struct("attempt", "folder", "status")).alias("_r"))
    return last.select(*keys, "_r.attempt", "_r.status", "_r.folder")


def process_pending(wanted: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], usable: Column, keys: tuple[str, ...] = KEYS,
                    max_attempts: int = 3, reprocess: bool = False) -> int:
    """Run ``work`` on the tiles of ``wanted`` that are open and record what came of them; the number of tiles tried.

    ``work`` gets the keys and returns rows with them; a tile is finished if one of its rows is ``usable``.
    """
    spark, run = wanted.sparkSession, uuid.uuid4().hex
    known = read_manifest(spark, path, wanted, keys)
    tried = known.where(F.col("attempt") >= max_attempts).where("status = 'error'")
    todo = pending_tiles(wanted.select(*keys).distinct(), known, list(keys), reprocess)
    todo = todo if reprocess else todo.join(tried, list(keys), "left_anti")
    todo = todo.join(known.select(*keys, "attempt"), list(keys), "left").select(*keys, (F.coalesce("attempt", F.lit(0)) + 1).alias("attempt"))
    asked = f"{path}/asked/{run}"
    todo.write.parquet(asked)  # fixed before the work begins
    todo = spark.read.schema(todo.schema).parquet(asked)
    n = todo.count()
    if not n:
        return 0
    folder = f"{path}/data/{run}"
    work(todo.select(*keys)).write.parquet(folder)
    good = spark.read.parquet(folder).groupBy(*keys).agg(F.max(usable.cast("int")).alias("_good"))
    records = todo.join(good, list(keys), "left").select(
        *keys, "attempt", F.when(F.col("_good") == 1, "finished").otherwise("error").alias("status"), F.lit(run).alias("folder"))
    records.write.parquet(f"{path}/staged/{run}")
    publish(spark, f"{path}/staged/{run}", f"{path}/manifest/{run}")
    return n


def read_tiles(spark: SparkSession, path: str, wanted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The rows of all finished tiles, each from its last attempt; other runs' rows of a tile are left out."""
    done = read_manifest(spark, path, wanted, keys).where("status = 'finished'")
    runs = [r["folder"] for r in done.select("folder").distinct().collect()]  # one a run
    if not runs:
        raise FileNotFoundError(f"no tile is finished in {path}")
    parts = [spark.read.parquet(f"{path}/data/{r}").join(done.where(F.col("folder") == r).select(*keys), list(keys), "left_semi") for r in runs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
