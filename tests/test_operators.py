"""Table operators on small tables, against brute force where possible."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marshline import GridSpec, constants as K
from marshline.functions import geometry as G
from marshline.grid import with_centers
from marshline.operators import aoi as A, pixels as P, profiles as R, scenes as C, scoring as S, sightings as B
from marshline.plans import habitat as H
from marshline.sources import tables as T

DAY = dt.date(2024, 5, 11)


def obs(spark, rows):
    return spark.createDataFrame(rows, "ix long, iy long, dekad date, species string, `order` string, `count` long")


def test_bird_metrics_edges(spark):
    rows = [(1, 1, DAY, "owl", "Strig iformes", 2)] * 5 + [(2, 1, DAY, None, None, 1)] * 3
    rows += [(3, 1, DAY, "a", "X", 1), (3, 1, DAY, "a", None, 1), (3, 1, DAY, "b", "X", 4), (3, 1, DAY, None, "X", 1)]
    out = {r["ix"]: r for r in B.bird_metrics(obs(spark, rows), ["Strig iformes", "X"]).collect()}
    assert abs(out[1]["shannon_diversity"] + 1e-10) < 1e-15 and out[1]["n_individuals"] == 10 and out[1]["n_Strig_iformes"] == 5
    assert (out[2]["n_observations"], out[2]["n_species"], out[2]["shannon_diversity"]) == (3, 0, 0.0)
    want = -(2 / 3 * math.log(2 / 3 + 1e-10) + 1 / 3 * math.log(1 / 3 + 1e-10))
    assert abs(out[3]["shannon_diversity"] - want) < 1e-12
    assert (out[3]["n_species"], out[3]["n_observations"], out[3]["n_X"]) == (2, 4, 3)


def test_top_orders_ties_by_name(spark):
    rows = [(1, 1, DAY, "s", o, 1) for o in "bbaacd"]
    assert B.top_order_names(obs(spark, rows), 3) == ["a", "b", "c"]


def test_delimited_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'decimalLatitude,DecimalLongitude,eventDate,species,extra,,\n"29.1,-90.1,2024-01-02,Owl,x",,\n'
        "29.2,-90.2,2024-01-03\n29.3,-90.3,2024-01-04,Duck,x,too,many\n\n29.4,-90.4,2024-01-05,NA,x\n")
    raw = T.read_delimited_sightings(spark, str(tmp_path / "a.csv"))
    rows = [tuple(r) for r in B.resolve_column_aliases(raw).select("lat", "species", "order").orderBy("lat").collect()]
    assert rows == [("29.1", "Owl", None), ("29.2", None, None), ("29.4", None, None)]
    (tmp_path / "b.tsv").write_text("latitude\tlongitude\tdate\tspecies\n29.1\t-90\t2024-01-01\ta, b\n")
    assert T.read_delimited_sightings(spark, str(tmp_path / "b.tsv")).first()["species"] == "a, b"


def test_alias_errors_and_last_match(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "latitude string, decimalLatitude string, longitude string, date string")
    assert B.resolve_column_aliases(df).first()["lat"] == "2"
    with pytest.raises(ValueError):
        B.resolve_column_aliases(df.drop("date"))


def test_unwrap(spark):
    df = spark.createDataFrame([('"1,2,3",,  \t',), ("a,b,",), ('"',), ('""',)], "value string")
    assert [r[0] for r in B.unwrap_quoted_lines(df).collect()] == ["1,2,3", "a,b", "", ""]


def test_coarsen_trims_edges(spark):
    rows = [(0, DAY, x, y, float(x)) for x in range(7) for y in range(5)] + [(0, DAY, 0, 0, None)]
    df = spark.createDataFrame(rows, "tile_id int, time date, px long, py long, v double")
    out = {(r["bx"], r["by"]): r["v"] for r in P.coarsen_blocks(df, 2, ["v"]).collect()}
    assert out == {(bx, by): 2 * bx + 0.5 if (bx, by) != (0, 0) else 0.5 for bx in range(3) for by in range(2)}
    assert P.coarsen_factor(1, 10, True) == 100 and P.coarsen_factor(1, 0.009, False) == 1 and P.coarsen_factor(1, 0.0001, False) == 90


def test_cloud_fraction(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 8), (2, 4), (2, 0), (2, 10), (2, 5)], "k int, scl int")
    assert {r["k"]: r["cloud_fraction"] for r in P.cloud_fraction(df, ["k"]).collect()} == {1: 1.0, 2: 0.5}


def profile_input(spark):
    rows = []
    for i in range(8):
        rows.append((1, 1, dt.date(2020 + i // 2, 1 + (i % 2) * 6, 1), 0.1 * i))
    rows += [(2, 1, DAY, 0.1 * i) for i in range(8)] + [(3, 1, dt.date(2020 + i, 1, 1), 0.1 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "ix long, iy long, dekad date, NDVI double")
    return H.temporal_features(df)


def test_trend_guards(spark):
    df = profile_input(spark)
    out = {r["ix"]: r["NDVI_trend"] for r in R.trend_slope(df, ["NDVI"]).collect()}
    assert out[2] is None and out[3] is None
    part = df.where("ix = 1").toPandas()
    days = (pd.to_datetime(part["dekad"]) - pd.Timestamp("2020-01-01")).dt.days
    assert abs(out[1] - np.polyfit(days, part["NDVI"], 1)[0] * 365.25) < 1e-12
    daily = {r["ix"]: r["NDVI_trend"] for r in R.trend_slope_daily(df, ["NDVI"], date="dekad").collect()}
    assert daily[2] is None and daily[3] is not None


def test_finish_profiles(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None, 0), (2, 1, None, None, 1), (3, 1, 4.0, None, 1)],
                               "ix long, iy long, a double, b double, has_bird_data int")
    out = R.finish_profiles(df)
    assert out.columns == ["ix", "iy", "a", "has_bird_data"]
    assert out.where("ix = 2").first()["a"] == 2.5


def test_constant_scale_and_weights(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "ix int, v double")
    assert {r["s"] for r in S.minmax_scale(df, "v", "s").collect()} == {0.0}
    t = spark.createDataFrame([(1.0, None, 2.0)], "NDVI_trend double, EVI_trend double, other_trend double")
    assert abs(S.trend_composite(t).first()["trend_composite"] - (0.30 * 1 + 0.05 * 2) / 0.55) < 1e-12


def test_suitability_without_birds(spark):
    sc = spark.createDataFrame([(0, 0.2), (1, None), (2, 0.6)], "cluster int, median_diversity double")
    got = {r[0]: round(r[1], 9) for r in S.habitat_suitability(sc).collect()}
    assert got == {0: 0.0, 1: 50.0, 2: 100.0}
    none = spark.createDataFrame([(0, None), (1, None)], "cluster int, median_diversity double")
    assert {r[1] for r in S.habitat_suitability(none).collect()} == {0.0}


def test_trajectory_shares(spark):
    df = spark.range(1000).select(F.col("id").alias("ix"), (F.col("id") * 7919 % 1000).cast("double").alias("trend_composite"))
    n = {r[0]: r[1] for r in S.trajectory(df).groupBy("trajectory").count().collect()}
    assert n == {"improving": 250, "degrading": 250, "stable": 500}


def test_priority_range_and_formula(spark):
    df = spark.createDataFrame([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0)], "habitat_suitability double, trend_score double")
    got = [r["conservation_priority"] for r in S.conservation_priority(df).collect()]
    assert got[1] == 100.0 and got[0] == 0.0 and abs(got[2] - (0.4 - 0.3) / 0.7 * 100) < 1e-9


def _square(x, y, w):
    pts = [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]
    return f'{{"features":[{{"geometry":{{"type":"Polygon","coordinates":[{pts}]}}}}]}}'


def test_spatial_join_all_sizes(spark):
    """Areas from below one cell to thousands of cells, against brute force."""
    grid = GridSpec()
    boxes = [(i, -90.6 + 0.013 * i, 28.9 + 0.021 * i, w) for i, w in enumerate([0.004, 0.05, 0.3, 2.0, 30.0, 0.0001])]
    aois = spark.createDataFrame([(i, _square(x, y, w)) for i, x, y, w in boxes], "aoi_id int, g string").select(
        "aoi_id", G.parse_aoi(F.col("g")).alias("polys"))
    pts = with_centers(spark.range(4000).select((F.col("id") % 80 - 8790).alias("ix"), (F.floor(F.col("id") / 80) + 3195).alias("iy")), grid)
    want = {(i, r["ix"], r["iy"]) for r in pts.collect() for i, x, y, w in boxes
            if x < r["cell_x"] < x + w and y < r["cell_y"] < y + w}
    cols = ["aoi_id", "ix", "iy"]
    assert {tuple(r) for r in A.spatial_join(pts, aois, grid).select(*cols).collect()} == want
    limit, A.BROADCAST_EDGES = A.BROADCAST_EDGES, 0  # the route for large area tables
    try:
        assert {tuple(r) for r in A.spatial_join(pts, aois, grid).select(*cols).collect()} == want
    finally:
        A.BROADCAST_EDGES = limit


def test_condition_ties_and_empty_area(spark):
    df = spark.createDataFrame([(1, "stable"), (1, "improving"), (2, "stable")], "aoi_id int, trajectory string")
    got = {r["aoi_id"]: (r["condition"], r["condition_pct"]) for r in A.aoi_condition(df).collect()}
    assert got == {1: ("improving", 50.0), 2: ("stable", 100.0)}


def test_pending_and_enriched(spark):
    wanted = spark.createDataFrame([(0, "2024"), (1, "2024"), (2, "2024"), (3, "2024")], "tile_id int, period string")
    manifest = spark.createDataFrame([(0, "2024", "finished"), (1, "2024", "error"), (2, "2024", None)], "tile_id int, period string, status string")
    assert {r[0] for r in C.pending_tiles(wanted, manifest).collect()} == {1, 2, 3}
    assert C.pending_tiles(wanted, manifest, reprocess=True).count() == 4
    src = spark.createDataFrame([(1, False), (2, False)], "a int, is_enriched boolean")
    assert C.prefer_enriched_source(src).count() == 2
    assert C.prefer_enriched_source(src.union(spark.createDataFrame([(3, True)], "a int, is_enriched boolean"))).count() == 1


def test_best_k_first_on_tie(spark):
    df = spark.createDataFrame([(5, 0.0, 0.1), (4, 0.0, 0.1), (6, 10.0, 0.0)], "k int, bic double, silhouette double")
    assert S.best_k(df).first()["k"] == 4


def test_geojson_ring_is_closed(spark):
    import json
    df = spark.createDataFrame([(-8780, 3200, 41.25, 0.4125, "Marginal", 1.06)],
                               "ix long, iy long, suitability_pct double, suitability_probability double, archetype string, predicted_diversity double")
    f = json.loads(A.cells_to_geojson(df, GridSpec()).first()["feature"])
    ring = f["geometry"]["coordinates"][0]
    assert len(ring) == 5 and ring[0] == ring[-1]
    assert f["properties"] == {"suitability": 41.2, "probability": 0.412, "archetype": "Marginal", "predicted_diversity": 1.1}


def test_rasters_are_located_by_their_own_coordinates(spark):
    """Degrees, a named zone, a zone guessed from the extent, a raster without a time; points within a millimetre."""
    rows, want = [], {}
    points = [(-90.4 + 0.001 * i, 29.2 + 0.002 * i) for i in range(5)]
    for raster, (zone, named) in {"deg": (None, None), "named": (32616, 32616), "west": (32615, None), "east": (32616, None), "south": (32715, 32715)}.items():
        for i, (lon, lat) in enumerate(points):
            rows.append((raster, None if raster == "deg" else "2024-01-01", i, lon, -lat if raster == "south" else lat, zone, named))
            want[raster, i] = rows[-1][3:5]
    df = spark.createDataFrame(rows, "tile_id string, time string, id int, lo double, la double, zone int, named int")
    x, y = G.to_utm(F.col("lo"), F.col("la"), F.coalesce("zone", F.lit(32615)))
    flat = F.col("zone").isNull()
    given = df.select("tile_id", "time", "id", F.when(flat, F.col("lo")).otherwise(x).alias("x"), F.when(flat, F.col("la")).otherwise(y).alias("y"), F.col("named").alias("epsg"))
    got = P.locate_pixels(given, epsg="epsg")
    assert got.columns == ["tile_id", "time", "id", "lon", "lat"]
    for r in got.collect():
        lon, lat = want[r["tile_id"], r["id"]]
        assert abs(r["lon"] - lon) < 1e-8 and abs(r["lat"] - lat) < 1e-8
    assert P.locate_pixels(given.limit(0), epsg="epsg").count() == 0 and got.count() == 25


def test_header_is_found_without_grouping_the_lines_after_it(spark, tmp_path, monkeypatch):
    """Odd lines before a header, several files, and no more rows grouped than those lines."""
    lead = ["", ",,  ", '""', '"', '"",, ']
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text("\n".join([*lead[:i + 2], '"a,b",,', *(f"{j},x" for j in range(12_000)), ""]))
    taken = []
    plain = T.unwrap_quoted_lines
    monkeypatch.setattr(T, "unwrap_quoted_lines", lambda df: taken.append(df) or plain(df))
    got = T.read_delimited_sightings(spark, str(tmp_path))
    assert got.columns == ["a", "b"] and got.where("b = 'x'").count() == 36_000
    assert [df.count() for df in taken if "_line" in df.columns] == [3 + 4 + 5]
    (tmp_path / "3.txt").write_text("a;b\n1;2\n")
    with pytest.raises(ValueError):
        T.read_delimited_sightings(spark, str(tmp_path))
