"""Merkle manifest of a table: leaves by row, a tree for each group, and one tree over the groups' roots.

H is the lowercase hex SHA-256 of its inputs, digests as hex text. A leaf is H of its fields, each written as UTF-8 byte count, colon and
value, or as a dash where it is null. Within a group, leaves ascend by the order column. While a level has several nodes, each run of ``arity``
consecutive ones (the last run may be shorter, even a single node) becomes their H; the last node is the group's root, a lone leaf its own.
The groups' roots, ascending by group with null first, form the top tree in the same way.

Every level is one self-join of its nodes: a node computes the indices of its siblings (``idx ^ 1`` in a binary tree, else the other slots of its
run by slot offset) and meets their digests by an equi join; the rows of slot zero, which then hold their whole run, emit the parents. Going
down again, each node joins its parent's path, so a leaf ends with the digests to its left and right on every level up to the root.

Leaves are numbered by a range sort and offsets of (group, partition) counts, so a group of any size is spread over many tasks and no window sees a
group's rows. Join keys are (group, index) or (group, run), which no group makes hot. Levels are staged in the shared folder; the driver holds one
row count and the root, and runs one round for each level, log(rows) in all.

Defined results: leaves with equal order values ascend by leaf digest (null order values come first); repeated rows are leaves of their own. A null group is a group. Long texts
are hashed whole. An empty table gives an empty result. Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marshline.session import stage

PATH = "array<struct<left:binary,right:binary>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """H of the fields, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def digest_of(*digests: Column) -> Column:
    """H of digests given as bytes, as bytes."""
    return F.unhex(F.sha2(hexed(F.concat(*digests)).cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with a column g) with idx, their place in g by ``order`` from 0 on, and n, the rows of g."""
    keys = ["g", *order]
    dealt = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # rows that are equal can be dealt to several tasks
    sorted_rows = dealt.repartitionByRange(*keys, "_salt").sortWithinPartitions(*keys).drop("_salt")
    placed = stage(sorted_rows.withColumn("_pos", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_pos", 33)
    sizes = placed.groupBy("g", part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    own = Window.partitionBy("g")  # one row a partition that holds the group
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return (placed.withColumn("_part", part).join(starts, ["g", "_part"])
            .withColumn("idx", F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_shift"))


def sibling_indices(idx: Column, arity: int) -> Column:
    """The indices of a node's siblings, whether they exist or not."""
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    slot = idx % arity
    return F.transform(F.array(*[F.lit(k).cast("long") for k in range(1, arity)]), lambda k: idx - slot + (slot + k) % arity)


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (g, idx, n, digest, ...) of one level with the digests to the left and to the right in their runs."""
    key = ["g", "idx"]
    probes = nodes.select("g", "idx", F.explode(sibling_indices(F.col("idx"), arity)).alias("sibling"))
    facts = nodes.select("g", F.col("idx").alias("sibling"), "digest")
    met = probes.join(facts, ["g", "sibling"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("sibling", "digest"))).alias("_run"))

    def joined(keep) -> Column:
        return F.aggregate(F.filter("_run", lambda x: keep(x["sibling"])), F.lit(bytearray()), lambda acc, x: F.concat(acc, x["digest"]))

    none = F.lit(bytearray())
    return nodes.join(met, key, "left").select(
        *nodes.columns, F.coalesce(joined(lambda s: s < F.col("idx")), none).alias("left"), F.coalesce(joined(lambda s: s > F.col("idx")), none).alias("right"))


def grow(nodes: DataFrame, largest: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels that have several nodes, lowest first, with siblings; and (g, height, digest) of the node left in each group.

    ``largest``: the most nodes that a group has.
    """
    levels, tops = [], None
    while True:
        ended = nodes.where("n = 1").select("g", F.lit(len(levels)).alias("height"), "digest")
        tops = ended if tops is None else tops.unionByName(ended)
        if largest <= 1:
            return levels, tops
        level = stage(with_siblings(nodes.where("n > 1"), arity), "level")
        levels.append(level)
        parents = level.where(F.col("idx") % arity == 0).select(
            "g", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest_of(F.col("digest"), F.col("right")).alias("digest"))
        nodes, largest = parents, -(-largest // arity)


def descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level's nodes, those without siblings excepted, with the path of each: its left and right digests from there to the root.

    ``tops`` (g, height, digest, path): each group's root with the path above it. The root's digest comes along as ``subroot``.
    """
    above = None
    for height in range(len(levels), 0, -1):
        level = levels[height - 1]
        roots = tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("_run"), F.col("path").alias("_above"), F.col("digest").alias("subroot"))
        parents = roots if above is None else roots.unionByName(above.select("g", F.col("idx").alias("_run"), F.col("path").alias("_above"), "subroot"))
        own = F.array(F.struct("left", "right"))
        above = (level.withColumn("_run", F.expr(f"idx div {arity}")).join(parents, ["g", "_run"])
                 .withColumn("path", F.concat(own, "_above")).drop("_run", "_above", "left", "right"))
    return above


def manifest(df: DataFrame, fields: Sequence[str], group: str = "source", order: str = "doc_id", arity: int = 16,
             **more: Column) -> DataFrame:
    """``order``, leaf, subroot and root (bytes) and the path of every row: its siblings' digests to the left and right on each level, as bytes.

    ``more``: further columns to carry along, computed from ``df``.
    """
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("g"),  # null first
                     F.col(f"`{order}`").alias("_order"), leaf_digest(*[F.col(f"`{c}`") for c in fields]).alias("digest"),
                     *[c.alias(f"_more_{k}") for k, c in more.items()])
    leaves = stage(numbered(rows, ["_order", "digest"]), "numbered")
    largest = leaves.agg(F.max("n")).first()[0] or 0
    carried = ["_order", *[f"_more_{k}" for k in more]]
    levels, tops = grow(leaves, largest, arity)
    tops = stage(tops, "subroots")
    first = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("group"), "height", F.col("digest")), ["group"])
    first = stage(first, "tops")
    groups = first.agg(F.max("n")).first()[0] or 0
    upper, end = grow(first, groups, arity)
    root = end.select("digest").first()  # one row
    nothing = F.array().cast(PATH)
    whole = first.withColumn("path", nothing) if groups <= 1 else descend(upper, end.withColumn("path", nothing), arity)
    whole = stage(whole.select(F.col("group").alias("g"), "height", "digest", "path"), "paths")
    lone = (leaves.where("n = 1").select("g", *carried, "digest")
            .join(whole.where("height = 0").select("g", "path", F.col("digest").alias("subroot")), "g"))
    picked = [*carried, "digest", "subroot", "path"]
    out = lone.select(*picked)
    if levels:
        out = out.unionByName(descend(levels, whole, arity).select(*picked))
    return out.select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot",
                      F.lit(bytearray(root[0]) if root else None).cast("binary").alias("root"), "path", *[F.col(f"_more_{k}").alias(k) for k in more])


def proof_digest(path: Column) -> Column:
    """H of all siblings, level by level, left to right, as bytes."""
    joined = F.aggregate(path, F.lit(bytearray()), lambda acc, p: F.concat(acc, p["left"], p["right"]))
    return F.unhex(F.sha2(hexed(joined).cast("binary"), 256))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path, as bytes."""
    return F.aggregate(path, leaf, lambda acc, p: digest_of(p["left"], acc, p["right"]))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
