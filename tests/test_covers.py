"""The area join against brute force on every edge."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshline.grid import GridSpec
from marshline.operators import aoi as A, covers as C

GRID = GridSpec()


def brute(rings, px, py):
    """Even-odd crossings over all edges, points on an edge excluded, with the operator's own arithmetic."""
    odd, on = np.zeros(len(px), bool), np.zeros(len(px), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x1, y1) == (x2, y2):
                continue
            if y1 != y2:
                odd ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
            cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
            on |= (cross == 0) & (px >= min(x1, x2)) & (px <= max(x1, x2)) & (py >= min(y1, y2)) & (py <= max(y1, y2))
    return odd & ~on


def circle(cx, cy, r, n, wobble=0.0):
    return [(cx + r * (1 + wobble * math.sin(9 * t)) * math.cos(t), cy + r * (1 + wobble * math.sin(9 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]


SHAPES = {
    "ring with a hole": [circle(-90.2, 29.5, 0.3, 60), circle(-90.2, 29.5, 0.1, 7)],
    "comb": [[(-90.5, 29.0), (-90.5, 29.2)] + [p for i in range(40) for p in ((-90.49 + i * 0.01, 29.2), (-90.485 + i * 0.01, 29.01))] + [(-90.0, 29.0)]],
    "star": [[(-90.0 + (0.4 if i % 2 else 0.02) * math.cos(i), 29.6 + (0.4 if i % 2 else 0.02) * math.sin(i)) for i in range(51)]],
    "two parts": [circle(-90.55, 29.9, 0.02, 4), circle(-89.2, 29.1, 0.01, 5)],
    "sliver": [[(-90.3, 29.3), (-89.7, 29.3000001), (-89.7, 29.3)]],
    "open line": [[(-90.0, 29.0), (-90.1, 29.1)]],
    "whole degrees": [[(-90.0, 29.0), (-89.0, 29.0), (-89.0, 30.0), (-90.0, 30.0)]],
}


def area_rows(shapes):
    return [(i, [[[(x, y) for x, y in ring] for ring in rings]], name) for i, (name, rings) in enumerate(shapes.items())]


def joined(spark, shapes, px, py, **named):
    aois = spark.createDataFrame(area_rows(shapes), "aoi_id int, polys array<array<array<struct<x:double,y:double>>>>, name string")
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py))] + [(-1, None, 29.5), (-2, float("nan"), 29.5)], "id int, lon double, lat double")
    return A.spatial_join(pts, aois, GRID, "lon", "lat", **named)


@pytest.mark.parametrize("route", [0, 10**9])
def test_shapes(spark, route, monkeypatch):
    monkeypatch.setattr(A, "BROADCAST_EDGES", route)
    rng = np.random.default_rng(0)
    px, py = rng.uniform(-90.7, -88.9, 4000), rng.uniform(28.9, 30.1, 4000)
    corners = np.array([p for rings in SHAPES.values() for ring in rings for p in ring])
    middles = (corners[:-1] + corners[1:]) / 2
    px, py = np.concatenate([px, corners[:, 0], middles[:, 0], rng.choice(corners[:, 0], 300)]), np.concatenate([py, corners[:, 1], middles[:, 1], rng.choice(corners[:, 1], 300)])
    got = {(r["name"], r["id"]) for r in joined(spark, SHAPES, px, py).collect()}
    want = {(name, i) for name, rings in SHAPES.items() for i in np.flatnonzero(brute(rings, px, py)).tolist()}
    assert got == want and len({n for n, _ in want}) >= 5
    assert joined(spark, SHAPES, px, py).columns == ["id", "lon", "lat", "aoi_id", "name"]


def test_an_area_of_100_000_edges(spark):
    shape = {"coast": [circle(-90.0, 29.5, 0.4, 100_000, wobble=0.2)]}
    rng = np.random.default_rng(1)
    t = rng.uniform(0, 2 * math.pi, 500)
    near = 0.4 * (1 + 0.2 * np.sin(9 * t)) * (1 + rng.normal(scale=1e-5, size=500))
    px, py = np.concatenate([rng.uniform(-90.6, -89.4, 500), -90.0 + near * np.cos(t)]), np.concatenate([rng.uniform(28.9, 30.1, 500), 29.5 + near * np.sin(t)])
    got = sorted(r["id"] for r in joined(spark, shape, px, py).select("id").collect())
    assert got == np.flatnonzero(brute(shape["coast"], px, py)).tolist()
    aois = spark.createDataFrame(area_rows(shape), "aoi_id int, polys array<array<array<struct<x:double,y:double>>>>, name string")
    slabs = C.slab_cover(aois, GRID).select(F.explode("_slabs").alias("s")).select(F.size("s.near").alias("n"))
    row = slabs.agg(F.max("n"), F.avg("n"), (F.avg((F.col("n") == 0).cast("int"))).alias("free")).first()
    assert row[0] < 200 and row[1] < 8 and row["free"] > 0.3  # few edges a test, and many slabs that need none


def test_areas_that_hold_nothing(spark):
    assert joined(spark, {"nowhere": [circle(10.0, 50.0, 0.1, 8)]}, np.array([-90.0]), np.array([29.5])).count() == 0
    empty = spark.createDataFrame([], "aoi_id int, polys array<array<array<struct<x:double,y:double>>>>, name string")
    pts = spark.createDataFrame([(1, -90.0, 29.5)], "id int, lon double, lat double")
    assert A.spatial_join(pts, empty, GRID, "lon", "lat").count() == 0


def test_equal_outlines_are_covered_once_and_equal_points_tested_once(spark, monkeypatch):
    rings, seen = SHAPES["ring with a hole"], []
    many = {f"{k} {i}": v for i in range(30) for k, v in (("a", rings), ("b", SHAPES["comb"]))}
    rng = np.random.default_rng(2)
    px, py = (rng.choice(rng.uniform(a, b, 40), 2000) for a, b in ((-90.6, -89.9), (29.0, 29.8)))
    monkeypatch.setattr(A, "slab_cover", lambda aois, grid: seen.append(aois.count()) or C.slab_cover(aois, grid))
    got = {(r["name"], r["id"]) for r in joined(spark, many, px, py).collect()}
    assert got == {(n, i) for n, r in many.items() for i in np.flatnonzero(brute(r, px, py)).tolist()} and seen == [2]
    aois = spark.createDataFrame([*area_rows(many), (0, [[[*map(tuple, SHAPES["comb"][0])]]], "again")], "aoi_id int, polys array<array<array<struct<x:double,y:double>>>>, name string")
    pts = spark.createDataFrame([(i % 7 or None, float(a), float(b)) for i, (a, b) in enumerate(zip(px, py))], "site int, lon double, lat double")
    plain = A.spatial_join(pts, aois, GRID, "lon", "lat").groupBy("aoi_id").agg(F.count("*"), F.count_distinct("site"))
    assert {tuple(r) for r in A.point_counts(pts, aois, GRID, "site").collect()} == {tuple(r) for r in plain.collect()} and plain.count() == 60
