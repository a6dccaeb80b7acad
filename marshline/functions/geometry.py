"""Polygons and UTM coordinates as Column expressions.

A geometry is ``polys: array<array<array<struct<x,y>>>>`` (polygons, rings,
points). All tests work on its flattened ``edges``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

AOI_SCHEMA = (
    "struct<features: array<struct<geometry: struct<type: string, coordinates: string>>>>"
)
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"


def parse_aoi(geojson: Column) -> Column:
    """First feature's polygons from a GeoJSON FeatureCollection string.

    NULL when there is no feature or its geometry is not a (multi)polygon.
    """
    geom = F.get(F.from_json(geojson, AOI_SCHEMA)["features"], F.lit(0))["geometry"]
    kind, coords = geom["type"], geom["coordinates"]
    raw = (F.when(kind == "Polygon", F.array(F.from_json(coords, _POLYGON)))
           .when(kind == "MultiPolygon", F.from_json(coords, _MULTI)))
    return F.transform(raw, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))


def points(polys: Column) -> Column:
    return F.flatten(F.flatten(polys))


def polygon_bounds(polys: Column) -> Column:
    """``struct<west,south,east,north>`` of a geometry."""
    xs = F.transform(points(polys), lambda p: p["x"])
    ys = F.transform(points(polys), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
                    F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def bbox_within(polys: Column, bounds: tuple[float, float, float, float]) -> Column:
    """True when every vertex lies in ``bounds`` (edges included)."""
    w, s, e, n = bounds
    return F.forall(points(polys), lambda p: p["x"].between(w, e) & p["y"].between(s, n))


def _ring_edges(ring: Column) -> Column:
    """Consecutive vertex pairs; an open ring is closed by its first vertex."""
    first = F.slice(ring, 1, 1)
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), first)
    return F.filter(
        F.zip_with(ring, nxt, lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))),
        lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]),
    )


def polygon_edges(polys: Column) -> Column:
    """All edges of all rings as ``array<struct<x1,y1,x2,y2>>``."""
    return F.flatten(F.transform(F.flatten(polys), _ring_edges))


def points_in_polygon(x: Column, y: Column, edges: Column) -> Column:
    """Strict containment: even-odd crossings, points on an edge excluded.

    Holes and multipolygons need no special case under the even-odd rule.
    """
    def on_edge(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return ((cross == 0)
                & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return spans & (x < at)

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, on_edge)


# --- Universal Transverse Mercator (WGS 84, Krueger series) -------------------

# WGS 84 ellipsoid and UTM constants.
_A, _F = 6378137.0, 1 / 298.257223563
_K0, _E0 = 0.9996, 500000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
# Series coefficients in the third flattening, to fourth order.
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]


def _central_meridian(epsg: Column) -> Column:
    """Degrees; northern zones are EPSG 326zz, southern 327zz."""
    return (epsg % 100) * 6.0 - 183.0


def _false_northing(epsg: Column) -> Column:
    return F.when(F.floor(epsg / F.lit(100)) == 327, 1e7).otherwise(0.0)


def _as_col(epsg) -> Column:
    return epsg if isinstance(epsg, Column) else F.lit(int(epsg))


def to_utm(lon: Column, lat: Column, epsg) -> tuple[Column, Column]:
    """Easting and northing in metres of a lon/lat point."""
    epsg = _as_col(epsg)
    phi = F.radians(lat)
    dlam = F.radians(lon - _central_meridian(epsg))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return (F.lit(_E0) + _K0 * _RECT * x, _false_northing(epsg) + _K0 * _RECT * y)


def to_lonlat(x: Column, y: Column, epsg) -> tuple[Column, Column]:
    """Longitude and latitude of a projected point."""
    epsg = _as_col(epsg)
    xi = (y - _false_northing(epsg)) / F.lit(_K0 * _RECT)
    eta = (x - F.lit(_E0)) / F.lit(_K0 * _RECT)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lam) + _central_meridian(epsg), F.degrees(phi)


def polygon_area_km2(polys: Column, epsg=32615) -> Column:
    """Planar area in square kilometres of the projected rings, one decimal.

    The first ring of each polygon is its shell, the others are holes.
    """
    def ring_area(ring: Column) -> Column:
        pts = F.transform(ring, lambda p: F.struct(
            to_utm(p["x"], p["y"], epsg)[0].alias("x"), to_utm(p["x"], p["y"], epsg)[1].alias("y")))
        parts = F.transform(_ring_edges(pts), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
        return F.abs(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)) / 2

    def poly_area(poly: Column) -> Column:
        areas = F.transform(poly, ring_area)
        total = F.aggregate(areas, F.lit(0.0), lambda acc, v: acc + v)
        return 2 * F.element_at(areas, 1) - total

    whole = F.aggregate(F.transform(polys, poly_area), F.lit(0.0), lambda acc, v: acc + v)
    return F.bround(whole / 1e6, 1)
