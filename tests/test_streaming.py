"""Streams give the batch answer, also when data arrives in several runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF
from marshline import GridSpec
from marshline.functions.dates import assign_dekad
from marshline.grid import assign_grid_cell
from marshline.operators import sightings as B
from marshline.streaming import refresh as R


def test_late_sightings_count(spark, tmp_path):
    rows = [(dt.datetime(2024, 5, d), -90.5, 29.5, "a", 1) for d in (1, 2, 3)] + [(dt.datetime(2024, 1, 5), -90.5, 29.5, "a", 2)]
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    schema = "ts timestamp, lon double, lat double, species string, `count` long"
    for row in rows:  # the last file is months late
        spark.createDataFrame([row], schema).write.mode("append").parquet(src)
        R.stream_bird_metrics(spark, src, spark.createDataFrame([], schema).schema, out, chk, GridSpec()).awaitTermination()
    got = R.read_bird_metrics(spark, out).agg(F.sum("n_observations"), F.sum("n_individuals")).first()
    assert tuple(got) == (4, 5)


def test_bird_metrics_over_two_runs(spark, tmp_path):
    grid = GridSpec()
    rows = [(dt.datetime(2024, 1, 1 + i % 28, i % 24), -90.5 + 0.01 * (i % 3), 29.5, "abc"[i % 3] if i % 7 else None, 1 + i % 2)
            for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, lon double, lat double, species string, `count` long").orderBy("ts")
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    for part in (df.where("ts < '2024-01-12'"), df.where("ts >= '2024-01-12'")):
        part.coalesce(1).write.mode("append").parquet(src)
        R.stream_bird_metrics(spark, src, df.schema, out, chk, grid).awaitTermination()
    got = {tuple(r) for r in R.read_bird_metrics(spark, out).collect()}
    batch = assign_grid_cell(df, grid).withColumn("dekad", assign_dekad(F.to_date("ts"))).withColumn("order", F.lit(None).cast("string"))
    assert got == {tuple(r) for r in B.bird_metrics(batch).collect()} and got


PIXELS = "scene_id string, time date, lon double, lat double, blue int, green int, red int, nir int, swir1 int, swir2 int, scl int"


def pixel_rows(scene, day, red):
    return [(scene, dt.date(2024, 5, day), -90.5 + 0.004 * i, 29.5 + 0.003 * j, 500, 700, red + i, 3000 + j, 1500, 900, 4) for i in range(6) for j in range(4)]


def test_scenes_delivered_again_replace_themselves(spark, tmp_path):
    """Twice the same, corrected, and with merged folders: always the sums of each scene's newest file."""
    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    schema = spark.createDataFrame([], PIXELS).schema
    box = (-91.0, 29.0, -90.0, 30.0)
    newest = {}
    for n, (scene, day, red) in enumerate([("a", 1, 400), ("b", 2, 450), ("a", 1, 400), ("b", 2, 999), ("c", 3, 420), ("b", 2, 470)]):
        part = spark.createDataFrame(pixel_rows(scene, day, red), schema)
        part.coalesce(1).write.mode("append").parquet(src)
        newest[scene] = part
        R.stream_latest_cells(spark, src, schema, out, chk, box, GridSpec(), compact_every=2).awaitTermination()
        got = R.newest_deliveries(R._live(spark, out)).drop(*R.DELIVERY)
        whole = None
        for p in newest.values():
            whole = p if whole is None else whole.unionByName(p)
        want = R.scene_cell_sums(whole.withColumns({"delivered": F.lit(1), "file": F.lit("x")}), box, GridSpec(), 3, 3).drop(*R.DELIVERY)
        key = lambda rows: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
        assert key(got.select(*want.columns).collect()) == key(want.collect())
        assert len(R.live_folders(spark, out)) <= 3
    assert any("upto=" in f for f in R.live_folders(spark, out))


def test_a_batch_that_is_written_again_after_a_merge_counts_once(spark, tmp_path):
    out = str(tmp_path / "out")
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    for i in (0, 1, 2, 2, 3):  # batch 2 is tried twice; the merge comes with it
        R._fold(spark.createDataFrame([("x", 1), (f"b{i}", 1)], "k string, n long"), i, out, merge, compact_every=2)
    assert {r["k"]: r["n"] for r in merge(R._live(spark, out)).collect()} == {"x": 4, "b0": 1, "b1": 1, "b2": 1, "b3": 1}


@pytest.mark.parametrize("name,rows", [("stream_latest_cells", 500), ("stream_bird_metrics", 100)])
def test_more_rows_arrive_as_more_files(spark, tmp_path, monkeypatch, name, rows):
    from catalog import load
    want = [tuple(r) for r in load().QUERIES[name](spark, SF).collect()]
    from catalog import models
    monkeypatch.setattr(models, "FILE_ROWS", rows)
    monkeypatch.setattr(models, "new_path", lambda spark, kind: str(tmp_path / kind))
    assert {tuple(r) for r in load().QUERIES[name](spark, SF).collect()} == set(want)
    source = spark.read.parquet(str(next(tmp_path.glob("*_in"))))
    sizes = [r["count"] for r in source.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * rows  # four files whatever the table, before
