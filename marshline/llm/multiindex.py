"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves and each half is quantized by its own codebook; the codewords of both halves form a
product grid of cells. A vector searches the cells around it in the order of their summed excess distance (multi-sequence
traversal) and stops at the excess within which the target recall is reached: the quantile, over a sample, of the excess
of the cell of a neighbour at just the similarity threshold. Candidates are verified by cosine in double precision.

Codebooks and the stopping excess are fitted on a bounded sample (``sample`` vectors, chosen by hash); every vector is indexed and every vector
searches. The codebooks grow with the number of vectors, so cells keep their size, up to ``max_words`` words.

A cell's vectors and the vectors that search it are dealt into blocks, and each pair of blocks is one task group of bounded size,
which gives counts of links and the least linked vector, never rows of pairs. Bitwise equal vectors are one class.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing. Only vectors of equal length are
compared. Repeated rows (same id) are vectors of their own in the counts. A null id has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marshline.llm.arrow import map_arrow
from marshline.llm.graph import components
from marshline.session import stage

BASE_BLOCK, PROBE_BLOCK = 1024, 2048


def keyed(df: DataFrame, key: str, vector: str) -> DataFrame:
    """_id, 128-bit key of the vector (null if it cannot link), its length and its components as bytes of doubles."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raws, sizes = [], [], []
            for v in b.column("_v"):
                x = np.array(v.as_py() or [np.nan], dtype=np.float64)  # null components become nan
                good = np.isfinite(x).all() and x.any()
                raw = x.tobytes() if good else None
                raws.append(raw)
                sizes.append(len(x) if good else None)
                keys.append(xxhash.xxh3_128_intdigest(raw) if good else None)
            half = [None if k is None else (k >> 64) - (1 << 63) for k in keys], [None if k is None else (k & (1 << 64) - 1) - (1 << 63) for k in keys]
            yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(h, pa.int64()) for h in half), pa.array(sizes, pa.int32()), pa.array(raws, pa.binary())],
                                             names=["_id", "_k1", "_k2", "_dim", "_raw"])

    return map_arrow(df.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")), run,
                     f"_id {kind}, _k1 long, _k2 long, _dim int, _raw binary")


def unit(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1), 0)


def codebook(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm on the distinct rows of a sample."""
    x = np.unique(x, axis=0)
    words = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([squares(x[i:i + 4096], words).argmin(axis=1) for i in range(0, len(x), 4096)])
        sums, n = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(sums, own, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


class MultiIndex:
    """Two codebooks and the excess at which a search stops."""

    def __init__(self, sample: np.ndarray, words: int, similarity: float, recall: float):
        self.cut = max(sample.shape[1] // 2, 1)
        self.books = [codebook(h, words) for h in self.halves(sample)]
        rng = np.random.default_rng(11)
        some = sample[rng.permutation(len(sample))[:4096]]
        side = rng.normal(size=some.shape)
        side -= (side * some).sum(axis=1, keepdims=True) * some
        norm = np.sqrt((side * side).sum(axis=1, keepdims=True))
        near = similarity * some + np.sqrt(1 - similarity ** 2) * side / np.where(norm > 0, norm, 1)
        excess = sum(e[np.arange(len(some)), o] for e, o in zip(self.excess(some), self.own(near)))
        self.stop = float(np.quantile(excess, recall)) + 1e-9 if len(some) else 0.0

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.cut], x[:, self.cut:]] if x.shape[1] > 1 else [x]

    def excess(self, x: np.ndarray) -> list[np.ndarray]:
        far = [squares(h, w) for h, w in zip(self.halves(x), self.books)]
        return [f - f.min(axis=1, keepdims=True) for f in far]

    def own(self, x: np.ndarray) -> list[np.ndarray]:
        return [squares(h, w).argmin(axis=1) for h, w in zip(self.halves(x), self.books)]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each vector's cell, and the cells it visits, nearest first. Of two cells, the vectors of the lower one visit the higher."""
        excess = self.excess(x)
        if len(excess) == 1:
            excess.append(np.zeros((len(x), 1)))
        wide = excess[1].shape[1]
        own = excess[0].argmin(axis=1) * wide + excess[1].argmin(axis=1)
        visits = []
        for e, f, mine in zip(*excess, own.tolist()):
            a, b = np.flatnonzero(e <= self.stop), np.flatnonzero(f <= self.stop)
            total = e[a][:, None] + f[b]
            i, j = np.nonzero(total <= self.stop)
            cell = a[i] * wide + b[j]
            order = np.argsort(total[i, j], kind="stable")
            cell = cell[order]
            visits.append(cell[cell >= mine])
        return own, visits


def least_linked(link: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest number that each row and column reaches by links of the block. ``rows`` and ``cols`` number the vectors."""
    top = np.iinfo(np.int64).max
    while True:
        by_row = np.minimum(rows, np.where(link, cols, top).min(axis=1))
        by_col = np.minimum(cols, np.where(link, by_row[:, None], top).min(axis=0))
        if (by_row == rows).all() and (by_col == cols).all():
            return rows, cols
        rows, cols = by_row, by_col


def block_links(classes: DataFrame, index, similarity: float) -> DataFrame:
    """(_rep, links, _low) from each pair of blocks: how many vectors a class is linked with there, and the least of its component there."""
    kind = dict(classes.dtypes)["_rep"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, visits = index.value.cells(unit(b.column("_raw").to_pylist()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_rep", "_n", "_raw")), pa.array(own), pa.array(visits, pa.list_(pa.int64()))],
                                                 names=["_rep", "_n", "_raw", "_own", "_cells"])

    placed = stage(map_arrow(classes.select("_rep", "_n", "_raw"), place, f"_rep {kind}, _n long, _raw binary, _own long, _cells array<long>"), "placed")
    base = placed.groupBy(F.col("_own").alias("_cell")).agg(F.ceil(F.count("*") / BASE_BLOCK).cast("int").alias("_nb"))
    probes = placed.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.ceil(F.count("*") / PROBE_BLOCK).cast("int").alias("_np"))
    sizes = stage(base.join(probes, "_cell"), "cells")
    salt = F.xxhash64(F.lit(1), "_rep")
    kept = placed.withColumn("_cell", F.col("_own")).join(sizes, "_cell").select(
        "_cell", F.pmod(salt, F.col("_nb")).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_np") - 1)).alias("_p"),
        F.lit(False).alias("_probe"), "_rep", "_n", "_raw", F.lit(True).alias("_home"))
    sent = placed.select("_rep", "_n", "_raw", "_own", F.explode("_cells").alias("_cell")).join(sizes, "_cell").select(
        "_cell", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_b"), F.pmod(salt, F.col("_np")).cast("int").alias("_p"),
        F.lit(True).alias("_probe"), "_rep", "_n", "_raw", (F.col("_own") == F.col("_cell")).alias("_home"))

    def compare(group: pa.Table) -> pa.Table:
        kind_of = group.schema.field("_rep").type
        probe = group.column("_probe").to_numpy()
        p, b = (group.filter(pa.array(m)) for m in (probe, ~probe))
        if not p.num_rows or not b.num_rows:
            return pa.table({"_rep": pa.array([], kind_of), "links": pa.array([], pa.int64()), "_low": pa.array([], kind_of)})
        ids = [t.column("_rep").to_numpy() for t in (p, b)]
        number = np.unique(np.concatenate(ids), return_inverse=True)
        rows, cols = number[1][:len(ids[0])], number[1][len(ids[0]):]
        link = unit(p.column("_raw").to_pylist()) @ unit(b.column("_raw").to_pylist()).T >= similarity
        home = p.column("_home").to_numpy()
        link &= ~home[:, None] | (rows[:, None] < cols)  # a pair of one cell is met from both sides
        n = [t.column("_n").to_numpy() for t in (p, b)]
        counts = np.zeros(len(number[0]), np.int64)
        np.add.at(counts, rows, link @ n[1])
        np.add.at(counts, cols, link.T @ n[0])
        low = np.arange(len(number[0]))
        by_row, by_col = least_linked(link, rows.astype(np.int64), cols.astype(np.int64))
        np.minimum.at(low, rows, by_row)
        np.minimum.at(low, cols, by_col)
        hit = np.flatnonzero(counts)
        return pa.table({"_rep": pa.array(number[0][hit], kind_of), "links": pa.array(counts[hit]), "_low": pa.array(number[0][low[hit]], kind_of)})

    # A vector that is both probe and base in one group may have two lows; both hold, and the component joins them.
    return kept.unionByName(sent).groupBy("_cell", "_b", "_p").applyInArrow(compare, f"_rep {kind}, links long, _low {kind}")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", similarity: float = 0.95, recall: float = 0.9995,
                 sample: int = 20_000, max_words: int = 1024) -> DataFrame:
    """``key``, n_links, component_id and kept of every row."""
    rows = stage(keyed(df, key, vector), "vectors")
    good = rows.where("_k1 is not null")
    named = good.groupBy("_k1", "_k2", "_dim").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), F.first("_raw").alias("_raw"))
    named = named.where("_rep is not null")
    classes = stage(named, "classes")
    found = None
    for dim, n in classes.groupBy("_dim").count().collect():  # vector lengths, one as a rule
        own = classes.where(F.col("_dim") == dim)
        drawn = own.where(F.pmod(F.xxhash64(F.lit(5), "_k1"), F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).select("_raw").toArrow()
        if not drawn.num_rows:
            drawn = own.select("_raw").limit(1).toArrow()
        words = int(min(max(np.sqrt(n / 12), 4), max_words))
        index = df.sparkSession.sparkContext.broadcast(MultiIndex(unit(drawn.column("_raw").to_pylist()), words, similarity, recall))
        part = block_links(own, index, similarity)
        found = part if found is None else found.unionByName(part)
    slim = rows.select("_id", "_k1", "_k2")
    alone = slim.where("_k1 is null").select(
        F.col("_id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:  # no vector can link
        return alone
    links = stage(found, "links")
    parts = components(links.select(F.col("_rep").alias("a"), F.col("_low").alias("b")))
    counts = links.groupBy("_rep").agg(F.sum("links").alias("links"))
    judged = (classes.select("_k1", "_k2", "_rep", "_n").join(counts, "_rep", "left").join(parts.withColumnRenamed("node", "_rep"), "_rep", "left")
              .select("_k1", "_k2", (F.col("_n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "_rep").alias("component_id")))
    linked = slim.where("_k1 is not null").join(judged, ["_k1", "_k2"], "left").select(
        F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.col("_id").eqNullSafe(F.when(F.col("_id").isNotNull(), F.col("component_id"))).alias("kept"))
    return linked.unionByName(alone)
