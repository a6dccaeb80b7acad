"""Connected components of a table of links, by alternating large and small stars.

Every step is a grouped minimum with map-side combining and an equi join. The minima of hubs are staged before they are joined, so both
sides of that join are plain exchanges, which adaptive execution can split: a hub with millions of neighbours is no single task. Links
are staged in the shared folder after each round, which cuts lineage and survives lost executors. Rounds end when all links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marshline.session import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another; component is its smallest reachable node.

    Links may repeat, come in either direction or join a node to itself. Links with a null end are none.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down and no node that edges lead to has one itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    mixed = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1")
    return mixed.isEmpty()
