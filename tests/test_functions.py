"""Column functions on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marshline import GridSpec, constants as K
from marshline.functions import casting as A, dates as D, geometry as G, labels as L
from marshline.grid import split_periods, tile_ids
from marshline.operators import pixels as P


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def bands(spark, rows):
    cols = ["blue", "green", "red", "nir", "swir1", "swir2", "scl"]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))


def test_zero_and_missing_bands(spark):
    df = P.spectral_indices(P.scale_reflectance(bands(spark, [
        (500, 0, 600, 0, 700, 800, 4), (500, 600, 400, 450, None, 800, 4)])))
    dead, gap = df.orderBy("green").collect()
    assert dead["NDWI"] is None and dead["GCVI"] is None and dead["NDVI"] == -1.0
    assert gap["MNDWI"] is None and gap["wetland_moisture_index"] is None and gap["water_mask"] == 0.0
    kept = P.spectral_indices(P.scale_reflectance(bands(spark, [(500, 600, 400, 450, None, 800, 4)])), keep_unknown_water=True)
    assert kept.first()["water_mask"] is None


def test_indices_need_all_bands(spark):
    df = spark.createDataFrame([(0.1, 0.2)], "red double, nir double")
    assert P.spectral_indices(df).columns == ["red", "nir"]


def test_scl_policies(spark):
    df = bands(spark, [(1, 1, 1, 1, 1, 1, s) for s in [*range(12), None]]).withColumn("v", F.lit(1.0))

    def kept(policy):
        return {r["scl"] for r in P.scl_mask(df, policy, ["v"]).where("v IS NOT NULL").collect()}

    assert kept("live") == {4, 5, 6, 7, 11}
    assert kept("prefetch") == {2, 3, 4, 5, 6, 7, 10, 11, None}
    assert kept("composite") == {4, 5, 6, 7, 11, None}


def test_canonical_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4.0, 5.0)], "B02 int, swir16 int, nir08 int, longitude double, lat double")
    assert P.canonical_bands(df).columns == ["blue", "swir1", "nir_narrow", "x", "y"]


@pytest.mark.parametrize("day,start", [(1, 1), (10, 1), (11, 11), (20, 11), (21, 21), (31, 21)])
def test_dekad_edges(spark, day, start):
    got = one(spark, d=D.assign_dekad(F.lit(dt.date(2024, 1, day))))["d"]
    assert got == dt.date(2024, 1, start)


def test_season_edges(spark):
    names = one(spark, **{f"m{m}": D.bird_season(F.lit(m)) for m in range(1, 13)})
    assert [names[f"m{m}"] for m in (2, 3, 5, 6, 7, 8, 10, 11)] == [
        "winter", "spring_migration", "spring_migration", "breeding", "breeding", "fall_migration", "fall_migration", "winter"]


def test_tolerant_casts(spark):
    got = one(spark, n=A.coerce_numeric(F.lit("abc")), nan=A.coerce_numeric(F.lit("NaN")), ok=A.coerce_numeric(F.lit(" 1.5 ")),
              c0=A.coerce_count(F.lit("X")), c1=A.coerce_count(F.lit("7.9")), c2=A.coerce_count(F.lit(None).cast("string")),
              d0=A.coerce_date(F.lit("not-a-date")), d1=A.coerce_date(F.lit("2024-02-29T10:00:00Z")),
              d2=A.coerce_date(F.lit("2024/03/01")), inf=A.nonfinite_to_zero(F.lit(float("-inf"))))
    assert got == {"n": None, "nan": None, "ok": 1.5, "c0": 1, "c1": 7, "c2": 1, "d0": None, "d1": dt.date(2024, 2, 29),
                   "d2": dt.date(2024, 3, 1), "inf": 0.0}


def test_labels_at_edges(spark):
    p = {str(v): L.suitability_class(F.lit(v), F.lit(0.5)) for v in (0.15, 0.4, 0.7, 1.0, 0.149)}
    assert list(one(spark, **p).values()) == ["Marginal", "Moderately suitable", "Highly suitable", "Highly suitable", "Unsuitable"]
    got = one(spark, water=L.suitability_class(F.lit(0.9), F.lit(0.51)), top=L.probability_band(F.lit(1.0)),
              hole=L.probability_band(F.lit(1.0), top_closed=False), div=L.diversity_level(F.lit(0.3)),
              nodata=L.diversity_level(F.lit(None).cast("double")), even=L.percent(F.lit(2.5)))
    assert got == {"water": "Open water", "top": "Highly suitable", "hole": None, "div": "Low", "nodata": "No survey data", "even": 2}


def test_sentences(spark):
    got = one(spark, stable=L.describe_trend(F.lit(0.004), "Vegetation"), down=L.describe_trend(F.lit(-0.02), "Water presence"),
              cov=L.coverage_text(F.lit(0.0)), label=L.cluster_label(F.lit(0.5), F.lit(0.3), F.lit(-0.02)))
    assert got == {"stable": "Stable", "down": "Water presence has declined ~12% over 6 years", "cov": K.COVERAGE_NONE,
                   "label": "Seasonally flooded — moderate vegetation (browning)"}


SQUARE = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[3,1],[3,3],[1,3],[1,1]]]}}]}'
TWO = ('{"features":[{"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]]],'
       '[[[5,5],[6,5],[6,6],[5,6],[5,5]]]]}}]}')


def inside(spark, geojson, pts):
    edges = G.polygon_edges(G.parse_aoi(F.lit(geojson)))
    return list(one(spark, **{f"p{i}": G.points_in_polygon(F.lit(float(x)), F.lit(float(y)), edges) for i, (x, y) in enumerate(pts)}).values())


def test_point_in_polygon(spark):
    pts = [(0.5, 0.5), (2, 2), (0, 0), (2, 0), (4, 2), (1, 2), (5, 2), (3.5, 3.5)]
    assert inside(spark, SQUARE, pts) == [True, False, False, False, False, False, False, True]
    assert inside(spark, TWO, [(0.5, 0.5), (5.5, 5.5), (3, 3)]) == [True, True, False]


def test_parse_aoi_without_feature(spark):
    assert one(spark, a=G.parse_aoi(F.lit('{"features":[]}')))["a"] is None


def test_bbox_within(spark):
    polys = G.parse_aoi(F.lit(TWO))
    got = one(spark, a=G.bbox_within(polys, (0, 0, 6, 6)), b=G.bbox_within(polys, (0, 0, 5.9, 6)))
    assert got == {"a": True, "b": False}


def test_utm_known_points_and_round_trip(spark):
    x, y = G.to_utm(F.lit(-93.0), F.lit(30.0), 32615)
    got = one(spark, x=x, y=y)
    assert abs(got["x"] - 500000) < 1e-6
    assert abs(got["y"] - 0.9996 * 3320113.398) < 0.05  # meridian arc to 30 degrees
    df = spark.range(400).select((F.col("id") % 20 * 0.3 - 96).alias("lon"), (F.floor(F.col("id") / 20) * 3.9 - 38).alias("lat"))
    zone = F.when(F.col("lat") < 0, 32715).otherwise(32615)
    x, y = G.to_utm(F.col("lon"), F.col("lat"), zone)
    p = df.select("lon", "lat", zone.alias("z"), x.alias("x"), y.alias("y"))
    lo, la = G.to_lonlat(F.col("x"), F.col("y"), F.col("z"))
    err = p.agg(F.max(F.abs(lo - F.col("lon"))), F.max(F.abs(la - F.col("lat")))).first()
    assert max(err) < 1e-9


def test_polygon_area(spark):
    def rect(w, s, e, n, hole=""):
        ring = f"[[{w},{s}],[{e},{s}],[{e},{n}],[{w},{n}],[{w},{s}]]"
        return f'{{"features":[{{"geometry":{{"type":"Polygon","coordinates":[{ring}{hole}]}}}}]}}'
    plain = G.polygon_area_km2(G.parse_aoi(F.lit(rect(-93.05, 29.45, -92.95, 29.55))))
    hole = ",[[-93.02,29.48],[-92.98,29.48],[-92.98,29.52],[-93.02,29.52],[-93.02,29.48]]"
    holed = G.polygon_area_km2(G.parse_aoi(F.lit(rect(-93.05, 29.45, -92.95, 29.55, hole))))
    got = one(spark, a=plain, b=holed)
    assert abs(got["a"] - 107.4) < 0.3
    assert abs(got["b"] - got["a"] * 0.84) < 0.2


def test_grid_and_tiles(spark):
    g = GridSpec()
    assert abs(g.mid_lat - 29.5168965) < 1e-9
    assert g.buffered[0] == g.bounds[0] - 5 / 111.0
    box = (0.0, 0.0, 3.0, 3.0)
    got = one(spark, inner=tile_ids(F.lit(0.5), F.lit(0.5), F.lit(1.5), F.lit(1.5), box),
              edge=tile_ids(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(0.5), box),
              out=tile_ids(F.lit(4.0), F.lit(4.0), F.lit(0.5), F.lit(0.5), box),
              wide=tile_ids(F.lit(0.5), F.lit(1.5), F.lit(0.5), F.lit(0.6), box))
    assert got == {"inner": [1], "edge": [0, 3], "out": [], "wide": [0, 3]}


def test_periods(spark):
    rows = split_periods(spark, [2023, 2025], quarterly=True).orderBy("start_date").collect()
    assert len(rows) == 8 and rows[0]["end_date"] == dt.date(2023, 3, 31) and rows[4]["start_date"] == dt.date(2025, 1, 1)
    assert split_periods(spark, [2024]).collect()[0]["end_date"] == dt.date(2024, 12, 31)
