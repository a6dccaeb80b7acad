"""Tiles are finished exactly once, whatever is interrupted."""

import pytest
from pyspark.sql import functions as F

from marshline.sources import manifest as M

KIND = "tile_id int, period string"


def wanted(spark):
    return spark.createDataFrame([(t, p) for t in range(4) for p in ("2024-01", "2024-02")], KIND)


def work(bad=(), mark=0):
    def fetch(todo):
        rows = todo.crossJoin(todo.sparkSession.range(3).withColumnRenamed("id", "px"))
        return rows.withColumns({"ok": ~F.col("tile_id").isin(*bad) if bad else F.lit(True), "mark": F.lit(mark)})
    return fetch


def tiles(spark, path):
    return {(r["tile_id"], r["period"]): (r["n"], r["mark"]) for r in M.read_tiles(spark, path, wanted(spark)).groupBy("tile_id", "period").agg(
        F.count("*").alias("n"), F.max("mark").alias("mark")).collect()}


def test_a_run_that_dies_before_it_commits_is_run_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert M.process_pending(wanted(spark).where("tile_id < 2"), path, work(), F.col("ok")) == 4
    whole = M.publish

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(M, "publish", dies)
    with pytest.raises(RuntimeError):
        M.process_pending(wanted(spark), path, work(mark=1), F.col("ok"))
    assert len(tiles(spark, path)) == 4  # what was written is not read
    monkeypatch.setattr(M, "publish", whole)
    assert M.process_pending(wanted(spark), path, work(mark=2), F.col("ok")) == 4
    got = tiles(spark, path)
    assert len(got) == 8 and {n for n, _ in got.values()} == {3} and {got[t, "2024-01"][1] for t in range(4)} == {0, 2}
    assert M.process_pending(wanted(spark), path, work(), F.col("ok")) == 0


def test_unusable_tiles_are_open_until_their_attempts_end(spark, tmp_path):
    path = str(tmp_path)
    for attempt, open_tiles in ((1, 8), (2, 2), (3, 0)):
        assert M.process_pending(wanted(spark), path, work(bad=(3,)), F.col("ok"), max_attempts=2) == open_tiles
    last = M.read_manifest(spark, path, wanted(spark))
    assert {(r["status"], r["attempt"]) for r in last.where("tile_id = 3").collect()} == {("error", 2)} and last.count() == 8
    assert M.process_pending(wanted(spark), path, work(mark=5), F.col("ok"), reprocess=True) == 8
    assert set(tiles(spark, path).values()) == {(3, 5)}


def test_nothing_is_finished_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        M.read_tiles(spark, str(tmp_path), wanted(spark))
    assert M.process_pending(wanted(spark).limit(0), str(tmp_path), work(), F.col("ok")) == 0
