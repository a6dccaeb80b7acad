"""Covers of areas by index cells and slabs, so that a point meets few edges or none.

The plane is cut into index cells, and each area into horizontal slabs of its own height, about as many as it has edges. An edge belongs to the slabs that it
touches, so slabs hold few edges however many the area has. For each slab and index cell the edges are told apart: those to the left of the cell
never count for its points; those to the right that pass the whole slab count for all its points, so only their parity is kept; the others are listed and
tested. Where none is listed, the slab is wholly inside or wholly outside of the area within that cell, and no point there needs a test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marshline.functions import geometry as G
from marshline.grid import GridSpec
from marshline.session import stage

# Index cell sizes, in grid cells. An area is indexed at the smallest size at
# which its bounding box spans at most MAX_SPAN index cells each way.
INDEX_SIZES = [1, 8, 64, 512, 4096]
MAX_SPAN = 16
# Slack in degrees and in slabs: edges this near a border count as touching it, so rounding moves no point past its edges.
_SLACK = 1e-9
# Counts as so many crossings for a point on an edge.
_ON = 1 << 20


def indexed(aois: DataFrame, grid: GridSpec) -> DataFrame:
    """Areas with ``edges``, ``bounds`` and the index size ``_size`` and index cells ``_cx0.._cy1`` of their bounding boxes."""
    b = F.col("bounds")
    boxed = aois.withColumns({"edges": G.polygon_edges(F.col("polys")), "bounds": G.polygon_bounds(F.col("polys"))})
    cells = boxed.withColumns({"_x0": grid.ix(b["west"]), "_x1": grid.ix(b["east"]), "_y0": grid.iy(b["south"]), "_y1": grid.iy(b["north"])})

    def at(c: str, size: Column) -> Column:
        return F.floor(F.col(c) / size)

    size = None
    for s in INDEX_SIZES[:-1]:
        s_ = F.lit(s)
        fits = (at("_x1", s_) - at("_x0", s_) <= MAX_SPAN) & (at("_y1", s_) - at("_y0", s_) <= MAX_SPAN)
        size = F.when(fits, s) if size is None else size.when(fits, s)
    z = F.col("_size")
    return (cells.withColumn("_size", size.otherwise(INDEX_SIZES[-1]))
            .withColumns({f"_c{a}{i}": at(f"_{a}{i}", z) for a in "xy" for i in "01"}).drop("_x0", "_x1", "_y0", "_y1", "polys"))


def box_cover(aois: DataFrame, grid: GridSpec) -> DataFrame:
    """One row per area and index cell its bounding box touches (at most 17 x 17)."""
    return (indexed(aois, grid).withColumn("_cx", F.explode(F.sequence("_cx0", "_cx1"))).withColumn("_cy", F.explode(F.sequence("_cy0", "_cy1")))
            .drop("_cx0", "_cx1", "_cy0", "_cy1", "edges").withColumn("_cost", F.lit(4)))


def slab_cover(aois: DataFrame, grid: GridSpec) -> DataFrame:
    """One row per area and index cell that it reaches into, with the slabs of the area there in order (``_slabs`` from number ``_first`` on)."""
    b, e = F.col("bounds"), F.col("_e")
    rise = F.aggregate("edges", F.lit(0.0), lambda acc, x: acc + F.abs(x["y2"] - x["y1"]))
    # With this height an edge touches three slabs on average, so slabs and cells stay in proportion to the edges.
    height = F.greatest(rise / F.greatest(2 * F.size("edges"), F.lit(1)), F.lit(1e-7))
    areas = stage(indexed(aois, grid).withColumns({"_area": F.monotonically_increasing_id(), "_height": height}), "areas")

    def slab(y: Column) -> Column:
        return (y - F.col("south")) / F.col("_height")

    last = F.floor(slab(F.col("north")))
    sized = areas.select("_area", "_height", b["south"].alias("south"), b["north"].alias("north"), "edges")
    touched = (sized.select("*", F.explode("edges").alias("_e")).select(
        "_area", "_e", F.explode(F.sequence(F.greatest(F.floor(slab(F.least(e["y1"], e["y2"])) - _SLACK), F.lit(0)),
                                            F.least(F.floor(slab(F.greatest(e["y1"], e["y2"])) + _SLACK), last))).alias("_s"))
               .groupBy("_area", "_s").agg(F.collect_list("_e").alias("_own")))
    slabs = (areas.select("_area", "_height", "_size", "_cx0", "_cx1", "_cy0", "_cy1", b["south"].alias("south"), b["north"].alias("north"))
             .withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), last))).join(touched, ["_area", "_s"], "left"))
    low, high = F.col("south") + F.col("_s") * F.col("_height") - _SLACK, F.col("south") + (F.col("_s") + 1) * F.col("_height") + _SLACK
    rows = slabs.withColumns({"_low": low, "_high": high}).withColumn("_cx", F.explode(F.sequence("_cx0", "_cx1")))
    left = F.col("_cx") * F.col("_size") * F.lit(grid.cell_lon) - _SLACK
    right = (F.col("_cx") + 1) * F.col("_size") * F.lit(grid.cell_lon) + _SLACK

    def passes(x: Column) -> Column:
        return (F.least(x["x1"], x["x2"]) > right) & (F.least(x["y1"], x["y2"]) < F.col("_low")) & (F.greatest(x["y1"], x["y2"]) > F.col("_high"))

    own = F.coalesce("_own", F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    z = F.col("_size")
    parts = rows.select(
        "_area", "_size", "_cx", "_s", (F.size(F.filter(own, passes)) % 2).alias("odd"),
        F.filter(own, lambda x: (F.greatest(x["x1"], x["x2"]) >= left) & ~passes(x)).alias("near"),
        F.explode(F.sequence(F.greatest(F.col("_cy0"), F.floor(grid.iy(F.col("_low")) / z)), F.least(F.col("_cy1"), F.floor(grid.iy(F.col("_high")) / z)))).alias("_cy"))
    cells = (parts.groupBy("_area", "_size", "_cx", "_cy").agg(F.array_sort(F.collect_list(F.struct("_s", "odd", "near"))).alias("_slabs"))
             .where(F.exists("_slabs", lambda s: (s["odd"] == 1) | (F.size(s["near"]) > 0))))
    cost = F.aggregate("_slabs", F.lit(0), lambda acc, s: acc + 1 + F.size(s["near"]))
    return cells.select("_area", "_cx", "_cy", F.col("_slabs")[0]["_s"].alias("_first"), cost.alias("_cost"), "_slabs").join(
        areas.drop("_cx0", "_cx1", "_cy0", "_cy1", "edges"), "_area").drop("_area")


def inside(x: Column, y: Column) -> Column:
    """Strict containment of a point that met a row of ``slab_cover``: even-odd crossings, points on an edge excluded."""
    place = F.floor((y - F.col("bounds")["south"]) / F.col("_height")) - F.col("_first")
    slab = F.get(F.col("_slabs"), place.cast("int"))

    def count(acc: Column, e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        on = ((cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
              & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))
        return acc + F.when(on, _ON).when(spans & (x < at), 1).otherwise(0)

    crossings = F.when(F.size(slab["near"]) == 0, slab["odd"]).otherwise(F.aggregate(slab["near"], slab["odd"], count))
    return F.coalesce((crossings < _ON) & (crossings % 2 == 1), F.lit(False))
