"""Gradient boosting on histograms, a base fit and all folds grown together.

Features are binned once to bytes (at most 256 bins, cut at quantiles) and stored in blocks of rows. Trees grow level by level: one pass over the blocks adds up, for
every fit, the counts, gradients and curvatures in the bins of each open node, and only these histograms are summed up to the driver: fits x
nodes x drawn features x bins x 3 numbers, whatever the number of rows. The rule for splits, leaves and draws is that of stochastic gradient
boosting with Friedman's criterion: each node looks at ``sqrt`` of the features, each tree at a share of the rows, leaves of log loss take a Newton step.

A model takes thousands of passes that wait for one another, and planning a query takes longer than a pass over a small table (measured on a busy machine: 164 ms a pass
as a DataFrame, 75 ms like this). The passes therefore run over an RDD of numpy blocks, summed up by ``treeReduce``; all else is DataFrames. Blocks
carry each row's score under every fit. After ``REFRESH`` trees the scores are brought forward into new blocks, which are kept in memory and on
disk and can be computed again from the stored bins and the trees; every ``CHECKPOINT`` trees they are written to the shared folder, which cuts their lineage.
A table of at most ``LOCAL_ROWS`` rows is a single block: nothing has to be summed between tasks, so the same steps run within a task, one for each fit.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from marshline.session import shared_dir, stage
from marshline.workers import map_arrow, matrix, prepare

BINS, BLOCK_ROWS, TASK_ROWS, REFRESH, CHECKPOINT = 256, 1 << 16, 1 << 13, 3, 99
#: Tables of up to so many rows (12 MB of blocks) are boosted as one block, which tasks share, and every fit is a task.
LOCAL_ROWS = 1 << 18
#: So many tasks may send their histograms to the driver; those of more are summed by tasks first.
DIRECT = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Boosted:
    """Trees as full binary arrays: node i has children 2 i + 1 and 2 i + 2; ``feature`` is -1 at a leaf."""

    features: list[str]
    cuts: list[np.ndarray]
    start: float
    step: float
    loss: str
    feature: np.ndarray  # trees x inner nodes
    bin: np.ndarray  # rows with at most this bin go left
    value: np.ndarray  # trees x all nodes
    importance: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.feature)

    @property
    def importances(self) -> np.ndarray:
        total = self.importance.sum()
        return self.importance / total if total > 0 else self.importance

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = binned_rows(x, self.cuts)
        return self.start + self.step * sum_of_trees(binned, self.feature, self.bin, self.value)

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return sigmoid(raw) if self.loss == "log" else raw

    def to_dict(self) -> dict:
        return {k: [c.tolist() for c in v] if k == "cuts" else v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    @classmethod
    def from_dict(cls, d: dict) -> "Boosted":
        arrays = {k: np.array(d[k], np.int64 if k in ("feature", "bin") else float) for k in ("feature", "bin", "value", "importance")}
        return cls(**{**d, **arrays, "cuts": [np.array(c, float) for c in d["cuts"]]})


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def binned_rows(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(cuts)), np.uint8)


def leaves_of(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of one tree in which each row ends; nodes below the given arrays are open."""
    inner = len(feature)
    stop = np.full(2 * inner + 1, -1, np.int32)
    stop[:inner] = feature
    # Rows that have reached a leaf go on to its left children, whose leaf is looked up at the end.
    home = np.arange(2 * inner + 1)
    for i in range(inner):
        if stop[i] < 0:
            home[2 * i + 1:2 * i + 3] = home[i]
            stop[2 * i + 1:2 * i + 3] = -1
    f = np.maximum(stop[:inner], 0)
    c = np.where(stop[:inner] >= 0, cut, BINS).astype(np.int16)
    flat, at = binned.ravel(), np.arange(0, binned.size, binned.shape[1] or 1)
    node = np.zeros(len(binned), np.int64)
    for _ in range(int(np.log2(inner + 1))):
        node = 2 * node + 1 + (flat.take(at + f.take(node)) > c.take(node))
    return home.take(node)


def sum_of_trees(binned: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros(len(binned))
    for f, c, v in zip(feature, cut, value):
        out += v[leaves_of(binned, f, c)]
    return out


def drawn(ids: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Which rows a tree looks at; a row's draw depends on its number, the tree and the seed only."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(tree) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) * _ODD
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)) / float(1 << 53) < share


def node_features(seed: int, fit: int, tree: int, level: int, features: int, take: int) -> np.ndarray:
    """The features that each node of a level looks at."""
    rng = np.random.default_rng([seed, fit, tree, level])
    return np.stack([rng.permutation(features)[:take] for _ in range(1 << level)])


@dataclass
class Block:
    bins: np.ndarray  # rows x features
    target: np.ndarray
    fold: np.ndarray
    ids: np.ndarray
    scores: np.ndarray  # fits x rows


def gradients(target: np.ndarray, scores: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    if loss == "square":
        return target - scores, np.ones(len(scores))
    p = sigmoid(scores)
    return target - p, p * (1 - p)


def tree_rows(block: Block, i: int, fit: dict, loss: str, tree: int, seed: int, share: float) -> tuple[np.ndarray, ...]:
    """Bins, gradients and curvatures of the rows that a tree of the ``i``-th fit looks at."""
    rows = np.flatnonzero(drawn(block.ids, tree, seed, share) & (block.fold != fit["without"]))
    bins = block.bins[rows]
    scores = block.scores[i][rows]
    for f, c, v in fit["recent"]:
        scores = scores + fit["step"] * v[leaves_of(bins, f, c)]
    return bins, *gradients(block.target[rows], scores, loss)


def level_histograms(block: Block, fits: list[dict], loss: str, tree: int, level: int, seed: int, share: float, kept: dict | None = None) -> list[np.ndarray]:
    """For each fit: (count, gradient, curvature) by open node of the level, drawn feature and bin.

    The rows of a tree are the same on all its levels; who asks for them one after another may pass a dictionary that keeps those of the last tree.
    """
    kept = {} if kept is None else kept
    out = []
    for i, fit in enumerate(fits):
        if kept.get(i, (None,))[0] != tree:
            kept[i] = tree, tree_rows(block, i, fit, loss, tree, seed, share)
        bins, gradient, curvature = kept[i][1]
        upper, nodes = (1 << level) - 1, 1 << level
        place = leaves_of(bins, *(x[:upper] for x in fit["growing"])) - upper if level else np.zeros(len(bins), np.int64)
        first, flat = np.arange(0, bins.size, bins.shape[1]), bins.ravel()
        if level:
            at = np.flatnonzero(place >= 0)  # rows of leaves further up are out
            if len(at) < len(place):
                place, first, gradient, curvature = place[at], first[at], gradient[at], curvature[at]
        hist = np.empty((3, nodes, fit["drawn"].shape[1], BINS))
        for j, feature in enumerate(fit["drawn"].T):
            key = place * BINS + flat.take(first + feature.take(place))
            for total, weights in zip(hist, (None, gradient, curvature)):
                total[:, j] = np.bincount(key, weights, nodes * BINS).reshape(nodes, BINS)
        out.append(hist)
    return out


def choose_splits(hist: np.ndarray, chosen: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """For each node the best feature and bin (-1: none), its gain, and count, gradient and curvature of node, left and right child."""
    left = np.cumsum(hist, axis=3)
    total = left[..., -1:]
    right = total - left
    n, g = left[0], left[1]
    m, h = right[0], right[1]
    ok = (n >= min_leaf) & (m >= min_leaf)
    gap = g / np.maximum(n, 1) - h / np.maximum(m, 1)
    gain = np.where(ok, n * m / np.maximum(n + m, 1) * gap * gap, -1.0)
    nodes, take = gain.shape[:2]
    best = gain.reshape(nodes, -1).argmax(axis=1)
    slot, cut = best // BINS, best % BINS
    at = np.arange(nodes)
    worth = gain[at, slot, cut]
    found = worth > 1e-12
    return (np.where(found, chosen[at, slot], -1), cut, np.where(found, worth, 0), total[:, at, slot, 0], left[:, at, slot, cut], right[:, at, slot, cut])


def quantile_cuts(df: DataFrame, features: list[str], bins: int = BINS, accuracy: int = 10_000) -> list[np.ndarray]:
    """Cut points of each feature; values up to a cut have its bin or a lower one. At most ``bins`` - 1 numbers a feature reach the driver."""
    probs = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), probs, accuracy).alias(f"c{i}") for i, f in enumerate(features)],
                 *[F.max(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        cuts = np.unique(np.array(row[f"c{i}"] or [], float))
        out.append(cuts[cuts < row[f"m{i}"]] if len(cuts) else cuts)
    return out


def blocks_of(df: DataFrame, features: list[str], target: str, fold: str | None, cuts: list[np.ndarray]) -> DataFrame:
    """Rows in blocks: bins, targets, folds and row numbers as bytes."""
    rows = df.select(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"), F.col(target).cast("double").alias("y"),
                     (F.lit(-1) if fold is None else F.col(fold).cast("int")).alias("fold"), F.monotonically_increasing_id().alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            parts = [np.concatenate(p) for p in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["bins", "target", "fold", "id"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append((binned_rows(matrix(b.column(0)), cuts), b.column(1).to_numpy(zero_copy_only=False).astype(float),
                         b.column(2).to_numpy(zero_copy_only=False).astype(np.int32), b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)))
            n += b.num_rows
            if n >= BLOCK_ROWS:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return map_arrow(rows, run, "bins binary, target binary, fold binary, id binary")


def _opened(row, width: int, starts: list[float]) -> Block:
    y = np.frombuffer(row["target"], float)
    return Block(np.frombuffer(row["bins"], np.uint8).reshape(len(y), width), y, np.frombuffer(row["fold"], np.int32), np.frombuffer(row["id"], np.int64),
                 np.repeat(np.array(starts)[:, None], len(y), axis=1))


def _forward(block: Block, recent: list[list[tuple]], step: float) -> Block:
    scores = np.stack([s + step * sum_of_trees(block.bins, *(np.array(x) for x in zip(*trees))) if trees else s for s, trees in zip(block.scores, recent)])
    return Block(block.bins, block.target, block.fold, block.ids, scores)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


@dataclass
class Plan:
    """What a boosting run is asked for; the same for all its fits."""

    width: int
    loss: str
    trees: int
    depth: int
    step: float
    subsample: float
    min_leaf: int
    seed: int

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1


def grow(plan: Plan, fits: list[tuple[int, int]], histograms: Callable, forward: Callable) -> list[dict]:
    """Trees and importances of the fits, given as (number, fold left out).

    ``histograms(asked, tree, level)`` gives the summed histograms of each fit; ``forward(recent, tree)`` is told the trees since scores were brought forward and
    returns those that scores still lack.
    """
    take = max(1, int(np.sqrt(plan.width)))
    done = [{"feature": [], "bin": [], "value": [], "importance": np.zeros(plan.width)} for _ in fits]
    recent: list[list[tuple]] = [[] for _ in fits]
    for t in range(plan.trees):
        grown = [(np.full(plan.inner, -1, np.int64), np.zeros(plan.inner, np.int64), np.zeros(2 * plan.inner + 1)) for _ in fits]
        for level in range(plan.depth):
            asked = [{"without": k, "recent": recent[i], "step": plan.step, "growing": grown[i][:2],
                      "drawn": node_features(plan.seed, number, t, level, plan.width, take)} for i, (number, k) in enumerate(fits)]
            here, split = np.arange(1 << level) + (1 << level) - 1, False
            for i, hist in enumerate(histograms(asked, t, level)):
                f, cut, gain, total, left, right = choose_splits(hist, asked[i]["drawn"], plan.min_leaf)
                feature, bins, value = grown[i]
                if level == 0:
                    value[0] = total[1, 0] / total[2, 0] if total[2, 0] > 1e-12 else 0.0
                feature[here], bins[here] = f, cut
                on = f >= 0
                for side, child in ((left, 2 * here + 1), (right, 2 * here + 2)):
                    value[child[on]] = np.where(side[2, on] > 1e-12, side[1, on] / np.maximum(side[2, on], 1e-12), 0.0)
                np.add.at(done[i]["importance"], f[on], gain[on])
                split |= bool(on.any())
            if not split:
                break
        for i, own in enumerate(grown):
            recent[i].append(own)
            for name, x in zip(("feature", "bin", "value"), own):
                done[i][name].append(x)
        recent = forward(recent, t)
    return done


def _in_one_block(stored: DataFrame, plan: Plan, without: list[int], starts: list[float]) -> list[dict]:
    """The fits of a table of at most ``LOCAL_ROWS`` rows, a task each: passes over a single block need no exchange."""
    spark = stored.sparkSession
    rows = stored.toArrow().to_pylist()
    shared = spark.sparkContext.broadcast({k: b"".join(r[k] for r in rows) for k in ("bins", "target", "fold", "id")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                block, kept = _opened(shared.value, plan.width, starts[i:i + 1]), {}

                def histograms(asked, t, level):
                    return level_histograms(block, asked, plan.loss, t, level, plan.seed, plan.subsample, kept)

                def forward(recent, t):
                    block.scores[0] += plan.step * sum_of_trees(block.bins, *(np.array(x) for x in zip(*recent[0])))
                    return [[]]

                done, = grow(plan, [(i, without[i])], histograms, forward)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(done)], pa.binary())], names=["fit", "model"])

    fits = spark.range(0, len(without), 1, len(without))
    found = map_arrow(fits, run, "fit long, model binary").toArrow().to_pylist()
    shared.destroy()
    return [pickle.loads(r["model"]) for r in sorted(found, key=lambda r: r["fit"])]


def _in_passes(stored: DataFrame, plan: Plan, without: list[int], starts: list[float], rows: int) -> list[dict]:
    """The fits of a table of any size, all fits in each pass over its blocks."""
    shared_dir(stored.sparkSession)  # names the folder of checkpoints
    tasks = max(1, min(stored.rdd.getNumPartitions(), -(-rows // TASK_ROWS)))  # a pass over a few rows costs less than starting a task
    blocks = stored.coalesce(tasks).rdd.map(lambda r: _opened(r, plan.width, starts)).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [blocks]

    def histograms(asked, t, level):
        packed = pickle.dumps(asked, pickle.HIGHEST_PROTOCOL)  # many small arrays travel as one

        def add(part):
            asked, total = pickle.loads(packed), None
            for b in part:
                own = level_histograms(b, asked, plan.loss, t, level, plan.seed, plan.subsample)
                total = own if total is None else _added(total, own)
            return [] if total is None else [total]

        added = kept[-1].mapPartitions(add)
        return added.reduce(_added) if tasks <= DIRECT else added.treeReduce(_added)

    def forward(recent, t):
        if (t + 1) % REFRESH or t + 1 == plan.trees:
            return recent
        packed = pickle.dumps(recent, pickle.HIGHEST_PROTOCOL)
        fresh = kept[-1].map(lambda b: _forward(b, pickle.loads(packed), plan.step)).persist(StorageLevel.MEMORY_AND_DISK)
        if (t + 1) % CHECKPOINT == 0:
            fresh.checkpoint()
            fresh.count()
        kept.append(fresh)  # the blocks before still feed these, those before them are free
        if len(kept) > 2:
            kept.pop(0).unpersist()
        return [[] for _ in recent]

    try:
        return grow(plan, list(enumerate(without)), histograms, forward)
    finally:
        for used in kept:
            used.unpersist()


def boost(df: DataFrame, features: list[str], target: str, loss: str, trees: int, depth: int, step: float, subsample: float, min_leaf: int,
          fold: str | None = None, folds: int = 0, base: bool = True, seed: int = 42) -> list[Boosted]:
    """The base fit on all rows (if ``base``), then one fit for each fold on the rows outside it.

    Missing feature values count as 0. Rows with a missing target are left out.
    """
    prepare(df.sparkSession)
    df = df.where(F.col(target).isNotNull())
    cuts = quantile_cuts(df, features)
    stored = stage(blocks_of(df, features, target, fold, cuts), "bins")
    y = F.col(target).cast("double")
    without = ([-2] if base else []) + list(range(folds))  # -2: no fold is left out
    sums = df.agg(F.count(y).alias("n"), F.sum(y).alias("s"), *[x for k in range(folds) for x in (
        F.count(F.when(F.col(fold) != k, y)).alias(f"n{k}"), F.sum(F.when(F.col(fold) != k, y)).alias(f"s{k}"))]).first()
    starts = []
    for k in without:
        n, s = (sums["n"], sums["s"]) if k < 0 else (sums[f"n{k}"], sums[f"s{k}"])
        mean = s / n if n else 0.0
        if loss == "log":
            mean = min(max(mean, 1e-6), 1 - 1e-6)
            mean = float(np.log(mean / (1 - mean)))
        starts.append(float(mean))
    rows = sums["n"]
    plan = Plan(len(features), loss, trees if rows else 0, depth, step, subsample, min_leaf, seed)
    done = _in_one_block(stored, plan, without, starts) if rows <= LOCAL_ROWS else _in_passes(stored, plan, without, starts, rows)
    kinds = (("feature", np.int64, plan.inner), ("bin", np.int64, plan.inner), ("value", float, 2 * plan.inner + 1))
    return [Boosted(list(features), cuts, s, step, loss, *(np.array(d[n], kind).reshape(-1, size) for n, kind, size in kinds), d["importance"])
            for s, d in zip(starts, done)]


def predicted(models: list[Boosted], features: list[str], fold: Column | None = None) -> Column:
    """Predictions as an array with one number a model; with ``fold``, of the model of the row's own fold only."""
    columns = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])

    @F.pandas_udf("array<double>")
    def score(x, own):
        import pandas as pd
        values, own = np.array(x.tolist(), float), own.to_numpy()
        if (own >= 0).any():
            out = np.zeros((len(values), 1))
            for k in np.unique(own):
                out[own == k, 0] = models[k].predict(values[own == k])
        else:
            out = np.stack([m.predict(values) for m in models], axis=1)
        return pd.Series(out.tolist())

    return score(columns, F.lit(-1) if fold is None else fold.cast("int"))
