"""Registered queries against SQL on the given tables, and plan shape."""

import sys
from pathlib import Path

import pytest

from conftest import SF

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import compare  # noqa: E402
import plans  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SAMPLE = ["spectral_indices", "read_delimited_sightings", "clearest_scene_per_tile", "latest_cells", "model_input", "dekadal_composite",
          "top_order_pivot", "cell_profiles", "conservation_priority", "build_training_set", "feature_thresholds", "classifier_metrics",
          "analyze_aoi", "score_summary", "stream_latest_cells", "stream_bird_metrics"]


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "NDVI" in df.columns and df.limit(1).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    why = compare.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert why == ""


@pytest.mark.parametrize("name", ["model_input", "cell_profiles", "analyze_aoi", "spatial_join", "latest_cells", "sample_negatives"])
def test_no_cross_joins_or_python(spark, name):
    found = plans.nodes(entry.queries()[name](spark, SF))
    assert not {"cartesian", "nested loop", "python"} & set(found)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from marshline.sources.tables import read_pixels
    df = spark.range(100).selectExpr("id % 3 as tile_id", "2020 + id % 4 as year", "id as nir", "id as red", "id as swir1")
    df.write.partitionBy("tile_id", "year").parquet(str(tmp_path / "p"))
    plan = read_pixels(spark, str(tmp_path / "p"), [1], [2021]).select("nir")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_id" in plan and "ReadSchema: struct<nir:bigint>" in plan
