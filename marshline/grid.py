"""The analysis grid: integer cell keys over lon/lat degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marshline import constants as K


@dataclass(frozen=True)
class GridSpec:
    """Cell sizes in degrees for square cells of ``cell_km`` at one latitude.

    Cells are keyed by the integers ``(ix, iy)``; centre coordinates are derived
    from them, so joins and groupings never compare floating point centres.
    """

    bounds: tuple[float, float, float, float] = K.AOI_BOUNDS
    cell_km: float = K.CELL_KM

    @property
    def mid_lat(self) -> float:
        return (self.bounds[1] + self.bounds[3]) / 2.0

    @property
    def cell_lon(self) -> float:
        return self.cell_km / (K.KM_PER_DEG_LON * math.cos(math.radians(self.mid_lat)))

    @property
    def cell_lat(self) -> float:
        return self.cell_km / K.KM_PER_DEG_LAT

    @property
    def buffered(self) -> tuple[float, float, float, float]:
        """Bounds widened so that sightings just outside the area count."""
        d = K.BUFFER_KM / K.BUFFER_KM_PER_DEG
        w, s, e, n = self.bounds
        return (w - d, s - d, e + d, n + d)

    def ix(self, lon: Column) -> Column:
        return F.floor(lon / F.lit(self.cell_lon)).cast("long")

    def iy(self, lat: Column) -> Column:
        return F.floor(lat / F.lit(self.cell_lat)).cast("long")

    def center_x(self, ix: Column) -> Column:
        return ix.cast("double") * F.lit(self.cell_lon) + F.lit(self.cell_lon / 2)

    def center_y(self, iy: Column) -> Column:
        return iy.cast("double") * F.lit(self.cell_lat) + F.lit(self.cell_lat / 2)


def assign_grid_cell(df: DataFrame, grid: GridSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add the cell key ``ix, iy`` of each point."""
    return df.withColumns({"ix": grid.ix(F.col(lon)), "iy": grid.iy(F.col(lat))})


def with_centers(df: DataFrame, grid: GridSpec) -> DataFrame:
    """Add the cell centre ``cell_x, cell_y`` in degrees."""
    return df.withColumns(
        {"cell_x": grid.center_x(F.col("ix")), "cell_y": grid.center_y(F.col("iy"))}
    )


def cell_polygon(ix: Column, iy: Column, grid: GridSpec) -> Column:
    """Closed five-point ring ``array<struct<x,y>>`` around a cell centre."""
    cx, cy = grid.center_x(ix), grid.center_y(iy)
    hx, hy = F.lit(grid.cell_lon / 2), F.lit(grid.cell_lat / 2)

    def corner(sx: int, sy: int) -> Column:
        x = cx + hx if sx > 0 else cx - hx
        y = cy + hy if sy > 0 else cy - hy
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Inclusive range test against ``(west, south, east, north)``."""
    w, s, e, n = bbox
    return lon.between(F.lit(w), F.lit(e)) & lat.between(F.lit(s), F.lit(n))


def split_bbox_tiles(spark, bbox, nx: int = K.TILES_X, ny: int = K.TILES_Y) -> DataFrame:
    """One row per tile of an ``nx`` by ``ny`` split, ids running up each column."""
    w, s, e, n = bbox
    dx, dy = (e - w) / nx, (n - s) / ny
    i, j = F.col("i"), F.col("j")
    tiles = spark.range(nx * ny).select(
        F.col("id").cast("int").alias("tile_id"),
        F.floor(F.col("id") / F.lit(ny)).cast("double").alias("i"),
        (F.col("id") % F.lit(ny)).cast("double").alias("j"),
    ).select(
        "tile_id",
        (F.lit(w) + i * F.lit(dx)).alias("west"),
        (F.lit(s) + j * F.lit(dy)).alias("south"),
        (F.lit(w) + (i + 1) * F.lit(dx)).alias("east"),
        (F.lit(s) + (j + 1) * F.lit(dy)).alias("north"),
    )

    def pt(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    return tiles.withColumn(
        "ring",
        F.array(pt("west", "south"), pt("east", "south"), pt("east", "north"),
                pt("west", "north"), pt("west", "south")),
    )


def tile_ids(lon_lo: Column, lon_hi: Column, lat_lo: Column, lat_hi: Column, bbox,
             nx: int = K.TILES_X, ny: int = K.TILES_Y) -> Column:
    """Ids of every tile an extent touches, by arithmetic instead of a join.

    Edges are inclusive, so a point lying exactly on a shared edge belongs to
    both tiles. Empty when the extent misses the bounding box.
    """
    w, s, e, n = bbox

    def span(lo: Column, hi: Column, origin: float, step: float, count: int) -> Column:
        first = F.greatest(F.ceil((lo - F.lit(origin)) / F.lit(step)) - 1, F.lit(0).cast("long"))
        last = F.least(F.floor((hi - F.lit(origin)) / F.lit(step)), F.lit(count - 1).cast("long"))
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    cols = span(lon_lo, lon_hi, w, (e - w) / nx, nx)
    rows = span(lat_lo, lat_hi, s, (n - s) / ny, ny)
    hit = (lon_hi >= w) & (lon_lo <= e) & (lat_hi >= s) & (lat_lo <= n)
    ids = F.flatten(F.transform(cols, lambda i: F.transform(rows, lambda j: (i * ny + j).cast("int"))))
    return F.when(hit, ids).otherwise(F.array().cast("array<int>"))


def split_periods(spark, years: list[int], quarterly: bool = False) -> DataFrame:
    """One row per year, or per quarter, with inclusive start and end dates."""
    months = 3 if quarterly else 12
    lo, hi = min(years), max(years)
    starts = spark.range(1).select(
        F.explode(F.expr(
            f"sequence(make_date({lo},1,1), make_date({hi},12,1), interval {months} month)"
        )).alias("start_date")
    )
    return starts.where(F.year("start_date").isin([int(y) for y in years])).select(
        F.year("start_date").cast("int").alias("year"),
        (F.quarter("start_date") if quarterly else F.lit(None)).cast("int").alias("quarter"),
        "start_date",
        F.date_sub(F.add_months("start_date", months), 1).alias("end_date"),
    )
