"""Near-duplicate documents by fast similarity sketches.

A document's set holds its distinct k-word shingles. Its sketch has t
coordinates. In round i each element is hashed to a bin and a value i + fraction, and a coordinate keeps its least value; in
rounds t to 2t every element goes to the one bin i - t, so no coordinate stays
empty. Two sets agree in a coordinate with the probability of their Jaccard
similarity, with concentration as for independent hashes, at a cost of about n + t log t.

Bands of coordinates become bucket keys. Links are found in two steps, so that a large group of near copies costs no
all-pairs comparison and yet no link between groups is lost:

1. every member of a bucket is compared with the bucket's smallest one, on the full sets;
2. documents in buckets that still hold several components are compared block by block within families (documents joined by
   such buckets), all pairs across components, without making pairs into rows.

Documents with equal sets are one class from the start and are represented by their smallest id.

With 56 bands of 8, a pair at similarity 0.8 shares no bucket with probability 3e-5, one at 0.85 with 2e-8.

Defined results: null or wordless text has the empty set and no links; so has a row with a null id, whose component is null and which is
kept. Repeated rows each give a row, with the component of their class. The id is taken to identify a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marshline.llm.arrow import by_bytes, filled, map_arrow, screen
from marshline.llm.graph import components
from marshline.llm.words import mix, set_keys, shingles
from marshline.session import stage

CALL_BYTES = 1 << 20
#: Set elements and documents in a block of a family at most, and columns of an incidence matrix at a time.
BLOCK_SHINGLES, BLOCK_DOCS, SLICE = 80_000, 500, 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEED, _FOLD = 0xA0761D6478BD642F, np.uint64(0xE7037ED1A0B428DB)


def sketches(values: np.ndarray, ends: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each nonempty set; rows of empty sets stay unset."""
    sets = len(ends) - 1
    out = np.full((sets, t), _EMPTY)
    flat = out.reshape(-1)
    size = np.diff(ends)
    owner, left = np.repeat(np.arange(sets), size), values
    for i in range(2 * t):
        if not len(left):
            break
        h = mix(left + np.uint64((i + 1) * _SEED & 0xFFFFFFFFFFFFFFFF))
        key = np.uint64(i << 32) | (h & np.uint64(0xFFFFFFFF))
        place = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + place, key)
        if i & (i - 1) == 0 or i % 16 == 0:  # a set that is full gains nothing from later rounds
            open_sets = (out == _EMPTY).any(axis=1)
            if not open_sets[owner].all():
                go_on = open_sets[owner]
                owner, left = owner[go_on], left[go_on]
    return out


def bands(sketch: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """Bucket keys, one column per band; the band's number is part of the key."""
    parts = sketch.reshape(len(sketch), n_bands, rows)
    key = np.broadcast_to(mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _FOLD), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _FOLD ^ parts[:, :, r])
    return key.view(np.int64)


def signatures(df: DataFrame, key: str, text: str, k: int, n_bands: int, rows: int) -> DataFrame:
    """_id, n_shingles, the set's 128-bit key (_k1, _k2; null for the empty set) and its bucket keys."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", CALL_BYTES):
            values, ends = shingles(filled(b.column("_text")), k)
            k1, k2 = set_keys(values, ends)
            none = np.diff(ends) == 0
            none_or_no_id = none | b.column("_id").is_null().to_numpy(zero_copy_only=False)
            buckets = bands(sketches(values, ends, n_bands * rows), n_bands, rows)
            n = len(buckets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(buckets.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), pa.array(np.diff(ends)), pa.array(k1, mask=none_or_no_id), pa.array(k2, mask=none_or_no_id), lists],
                names=["_id", "n_shingles", "_k1", "_k2", "_buckets"])

    return map_arrow(df.select(F.col(key).alias("_id"), F.col(text).alias("_text")), run,
                     f"_id {kind}, n_shingles long, _k1 long, _k2 long, _buckets array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    kind = dict(pairs.dtypes)["a"]
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    wanted = stage(wanted, "wanted")
    found = texts.where(screen(wanted, "_id")("_id")).join(wanted, "_id", "left_semi").select("_id", "_text")
    rows = (pairs.join(found.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")
            .join(found.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a").select("a", "b", "_ta", "_tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_tb", CALL_BYTES):
            hubs = filled(b.column("_ta")).dictionary_encode()  # a hub comes with many partners
            hub_sets, hub_ends = shingles(hubs.dictionary, k)
            sets, ends = shingles(filled(b.column("_tb")), k)
            keep = []
            for i, h in enumerate(hubs.indices.to_pylist()):
                x, y = hub_sets[hub_ends[h]:hub_ends[h + 1]], sets[ends[i]:ends[i + 1]]
                both = len(x) + len(y)
                merged = np.sort(np.concatenate([x, y]))
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(bool(both) and 100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows, run, f"a {kind}, b {kind}")


def links_in_families(docs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between documents of one family ``_f`` and different components ``_c``; of several in two blocks, enough to join the components.

    A family is dealt into blocks of about BLOCK_SHINGLES elements or BLOCK_DOCS documents and each pair of blocks is one small task whose comparisons are a
    product of incidence matrices: no pair becomes a row, and no task holds a family.
    """
    kind = dict(docs.dtypes)["_rep"]
    own = texts.where(screen(docs, "_rep")("_id")).join(docs.select(F.col("_rep").alias("_id")), "_id").select("_id", "_text")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "_text", CALL_BYTES):
            sets, ends = shingles(filled(b.column("_text")), k)
            raw = [sets[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(raw, pa.binary())], names=["_rep", "_set"])

    held = map_arrow(own, sets_of, f"_rep {kind}, _set binary").dropDuplicates(["_rep"])
    size = docs.groupBy("_f").agg(F.ceil(F.greatest(F.sum("_n") / BLOCK_SHINGLES, F.count("*") / BLOCK_DOCS)).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("_rep"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = (docs.join(size, "_f").join(held, "_rep").select("_f", "_rep", "_c", "_set", block.alias("_own"), other.alias("_other"))
             .select("_f", "_rep", "_c", "_set", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j")))

    def compare(group: pa.Table) -> pa.Table:
        ids, parts = group.column("_rep").to_pylist(), group.column("_c").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("_set").to_pylist()]
        n = np.array([len(x) for x in sets])
        common = intersections(sets)
        fit = np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1)
        root = {c: c for c in parts}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, y in zip(*np.nonzero(fit)):
            u, v = top(parts[x]), top(parts[y])
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((ids[x], ids[y]))
        a, b = zip(*out) if out else ((), ())
        kind_of = group.schema.field("_rep").type
        return pa.table({"a": pa.array(a, kind_of), "b": pa.array(b, kind_of)})

    return dealt.groupBy("_f", "_i", "_j").applyInArrow(compare, f"a {kind}, b {kind}")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets. Elements of one set only are left out; the rest go by slices of columns."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, held_by = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held_by > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, col = owner[keep], number[column[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((n, n), np.float32)
    for c in range(0, int(shared.sum()), SLICE):
        a, b = np.searchsorted(col, [c, c + SLICE])
        held = np.zeros((n, SLICE), np.float32)
        held[row[a:b], col[a:b] - c] = 1
        total += held @ held.T
    return total.astype(np.int64)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, percent: int = 80,
                    n_bands: int = 56, rows: int = 8) -> DataFrame:
    """``key``, n_shingles, component_id and kept of every row."""
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    docs = stage(signatures(df, key, text, k, n_bands, rows), "signatures")
    # Groups are written before they are joined back: adaptive execution splits a hot key only between two plain exchanges.
    classes = stage(docs.where("_k1 is not null").groupBy("_k1", "_k2").agg(
        F.min("_id").alias("_rep"), (F.count("*") > 1).alias("_many")), "classes")
    # One row of each class has its buckets: the class's smallest id (repeated rows are collapsed). Most classes have one row and stay put.
    several = classes.where("_many").select("_k1", "_k2", "_rep")
    maybe = screen(several, "_k1", "_k2")("_k1", "_k2")
    filled_sets = docs.where("_k1 is not null").withColumnRenamed("n_shingles", "_n")
    alone = filled_sets.where(~maybe).select(F.col("_id").alias("_rep"), "_n", "_buckets")
    first = (filled_sets.where(maybe).join(several.withColumnRenamed("_rep", "_low"), ["_k1", "_k2"], "left").where("_low is null or _id = _low")
             .select(F.col("_id").alias("_rep"), "_n", "_buckets"))
    firsts = alone.unionByName(first).select("_rep", "_n", F.explode(F.array_distinct("_buckets")).alias("_bucket"))
    members = stage(_shared_buckets(firsts), "buckets")
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    hub = stage(members.groupBy("_bucket").agg(F.min(F.struct("_rep", "_n")).alias("_h"))
                .select("_bucket", F.col("_h._rep").alias("a"), F.col("_h._n").alias("na")), "hubs")
    stars = stage(members.join(hub, "_bucket").where("_rep > a").withColumnRenamed("_n", "nb").where(fits)
                  .select("a", F.col("_rep").alias("b")).distinct(), "pairs")
    links = stage(verified(stars, texts, k, percent), "links")
    found = components(links)
    # What is left: documents in a bucket with another component. They are compared in blocks, within families that share buckets.
    of = F.coalesce(F.col("component"), F.col("_rep"))
    labelled = members.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").select("_bucket", "_rep", "_n", of.alias("_c"))
    labelled = stage(labelled, "labelled")
    mixed = stage(labelled.groupBy("_bucket").agg(F.min("_c").alias("lo"), F.max("_c").alias("hi"), F.min("_rep").alias("_low")).where("lo < hi"), "mixed")
    rest = stage(labelled.join(mixed.select("_bucket", "_low"), "_bucket").select("_rep", "_n", "_c", "_low").distinct(), "mixed")
    if not rest.isEmpty():
        families = components(rest.select(F.col("_rep").alias("a"), F.col("_low").alias("b"))).select(F.col("node").alias("_rep"), F.col("component").alias("_f"))
        docs_left = stage(rest.select("_rep", "_n", "_c").distinct().join(families, "_rep"), "families")
        more = stage(links_in_families(docs_left, texts, k, percent), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    named = classes.join(found.withColumnRenamed("node", "_rep"), "_rep", "left").select(
        "_k1", "_k2", F.coalesce("component", "_rep").alias("_component"))
    slim = docs.select("_id", "n_shingles", "_k1", "_k2")
    joined = (slim.where("_k1 is not null").join(named, ["_k1", "_k2"]).drop("_k1", "_k2")
              .unionByName(slim.where("_k1 is null").drop("_k1", "_k2"), allowMissingColumns=True))
    component = F.coalesce("_component", "_id")
    return joined.select(F.col("_id").alias(key), "n_shingles", component.alias("component_id"),
                         F.col("_id").eqNullSafe(component).alias("kept"))


def _shared_buckets(rows: DataFrame) -> DataFrame:
    """Rows of buckets that hold more than one class."""
    shared = stage(rows.groupBy("_bucket").agg(F.min("_rep").alias("lo"), F.max("_rep").alias("hi")).where("lo < hi").select("_bucket"), "shared")
    return rows.where(screen(shared, "_bucket")("_bucket")).join(shared, "_bucket", "left_semi")
