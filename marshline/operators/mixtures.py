"""Gaussian mixtures with full covariances, many fits at once.

Expectation maximisation in log space: densities are normalised by log-sum-exp, so no number of dimensions makes them vanish, and every
covariance gets a floor on its diagonal. All fits (each number of clusters, each start) share their scans: an iteration is one pass over the
rows, in which a task adds up the sufficient statistics of every fit that has not converged. A task hands on one row of statistics for each fit; they are
summed by fit, and only the sums reach the driver: fits x clusters x (1 + d + d (d + 1) / 2) numbers, whatever the number of rows. Memberships never leave a task's batch.

Starts: k-means++ and Lloyd's rounds on ``SAMPLE`` rows chosen by hash (all rows, where there are fewer); one scan then assigns every row to
its nearest centre, and the first covariances come from all rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from marshline.workers import map_arrow, matrix, prepare

#: Rows that starts are drawn from, and rows in one product of matrices.
SAMPLE, CHUNK = 4096, 512
FLOOR, TOLERANCE = 1e-6, 1e-3


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = float("nan")
    iterations: int = 0
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def to_dict(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    @classmethod
    def from_dict(cls, d: dict) -> "Mixture":
        return cls(**{k: np.array(v) if isinstance(v, list) else v for k, v in d.items()})

    def factors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whitening matrices side by side, the whitened means, and the log densities at the means with weights."""
        d = self.means.shape[1]
        lower = np.linalg.cholesky(self.covariances)
        white = np.linalg.inv(lower).transpose(0, 2, 1)  # k x d x d
        at_mean = np.log(self.weights) - 0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)
        return white.transpose(1, 0, 2).reshape(d, -1), np.einsum("kd,kde->ke", self.means, white), at_mean


def log_joint(x: np.ndarray, factors) -> np.ndarray:
    """Log density of each row and component, weight included."""
    white, centre, at_mean = factors
    k, d = centre.shape
    y = (x @ white).reshape(len(x), k, d) - centre
    return at_mean - 0.5 * np.einsum("nkd,nkd->nk", y, y)


def memberships(x: np.ndarray, factors) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the components for each row, and the log density of each row."""
    joint = log_joint(x, factors)
    top = joint.max(axis=1, keepdims=True)
    p = np.exp(joint - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def products(x: np.ndarray) -> np.ndarray:
    """One, the coordinates, and the products of each two of them."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def maximised(stats: np.ndarray, rows: int, floor: float = FLOOR) -> Mixture:
    """The mixture that follows from summed products weighted by membership."""
    d = int((np.sqrt(8 * stats.shape[1] + 1) - 3) / 2)
    n = np.maximum(stats[:, 0], 10 * np.finfo(float).eps)
    means = stats[:, 1:d + 1] / n[:, None]
    second = np.zeros((len(n), d, d))
    i, j = np.triu_indices(d)
    second[:, i, j] = second[:, j, i] = stats[:, d + 1:] / n[:, None]
    cov = second - means[:, :, None] * means[:, None, :]
    cov[:, range(d), range(d)] = np.maximum(cov[:, range(d), range(d)], 0) + floor
    return Mixture(n / n.sum(), means, cov)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.einsum("kd,kd->k", centres, centres) - 2 * x @ centres.T).argmin(axis=1)


def starts(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Centres by k-means++ and Lloyd's rounds."""
    centres = x[rng.integers(len(x))][None]
    gap = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = gap.sum()
        at = rng.choice(len(x), p=gap / total) if total > 0 else rng.integers(len(x))
        centres = np.vstack([centres, x[at]])
        gap = np.minimum(gap, ((x - x[at]) ** 2).sum(axis=1))
    own = None
    for _ in range(rounds):
        found = nearest(x, centres)
        if own is not None and (found == own).all():
            break
        own = found
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def coordinates(df: DataFrame, features: str) -> Column:
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features)


def _sums(rows: DataFrame, fits: dict[int, object], shift: np.ndarray) -> dict[int, tuple[np.ndarray, float]]:
    """Statistics and log-likelihood of each fit, given by factors or by centres (rows then count for their nearest one), in one scan."""
    shared = rows.sparkSession.sparkContext.broadcast((fits, shift))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, shift = shared.value
        stats, logs = {}, dict.fromkeys(fits, 0.0)
        for b in batches:
            whole = matrix(b.column(0)) - shift
            for x in (whole[i:i + CHUNK] for i in range(0, len(whole), CHUNK)):
                z = products(x)
                for f, p in fits.items():
                    if isinstance(p, tuple):
                        share, log = memberships(x, p)
                        logs[f] += float(log.sum())
                    else:
                        share = np.zeros((len(x), len(p)))
                        share[range(len(x)), nearest(x, p)] = 1
                    own = share.T @ z
                    stats[f] = stats[f] + own if f in stats else own
        for f, s in stats.items():
            yield _row(f, s, logs[f])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, logs = {}, {}
        for b in batches:
            for f, s, log in zip(*(c.to_pylist() for c in b.columns)):
                own = np.frombuffer(s)
                stats[f] = stats[f] + own if f in stats else own
                logs[f] = logs.get(f, 0.0) + log
        for f, s in stats.items():
            yield _row(f, s, logs[f])

    schema = "fit int, stats binary, log double"
    try:
        found = map_arrow(map_arrow(rows, add, schema).repartition("fit"), merge, schema).toArrow()
    finally:
        shared.destroy()
    sizes = {f: len(p[2]) if isinstance(p, tuple) else len(p) for f, p in fits.items()}
    return {f: (np.frombuffer(s).reshape(sizes[f], -1), log) for f, s, log in zip(*(found.column(c).to_pylist() for c in ("fit", "stats", "log")))}


def _row(fit: int, stats: np.ndarray, log: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([fit], pa.int32()), pa.array([stats.tobytes()], pa.binary()), pa.array([log])], names=["fit", "stats", "log"])


def fit_mixtures(df: DataFrame, ks: Iterable[int], features: str = "pca", n_init: int = 3, max_iter: int = 300, tol: float = TOLERANCE,
                 floor: float = FLOOR, seed: int = 42) -> dict[int, Mixture | str]:
    """For each k the likeliest of ``n_init`` mixtures, or the reason why there is none.

    ``df`` should be a stored table: every iteration scans it once, for all fits together.
    """
    prepare(df.sparkSession)
    ks = list(ks)
    rows = df.select(coordinates(df, features).alias("_x"))
    drawn = rows.orderBy(F.xxhash64("_x")).limit(SAMPLE).toArrow().column("_x")  # a bounded sample, the same for the same rows
    sample = matrix(drawn.combine_chunks()) if len(drawn) else np.zeros((0, 0))
    n = len(sample) if len(sample) < SAMPLE else rows.count()
    out: dict[int, Mixture | str] = {k: f"{n} rows are fewer than {k} clusters" for k in ks if n < k}
    shift = sample.mean(axis=0) if n else np.zeros(0)
    plan = {i: (k, s) for i, (k, s) in enumerate((k, s) for k in ks if k not in out for s in range(n_init))}
    if not plan:
        return out
    centres = {f: starts(sample - shift, k, np.random.default_rng([seed, s])) for f, (k, s) in plan.items()}
    live: dict[int, Mixture] = {}
    done: dict[int, Mixture] = {}
    broken: dict[int, str] = {}

    def advance(found: dict[int, tuple[np.ndarray, float]], step: int) -> dict[int, tuple]:
        """The next mixtures of the fits that go on, as factors."""
        going = {}
        for f, (stats, log) in found.items():
            try:
                fresh = maximised(stats, n, floor)
                factors = fresh.factors()
            except np.linalg.LinAlgError as e:
                broken[f] = f"a covariance is not positive definite: {e}"
                live.pop(f, None)
                continue
            before = live[f].log_likelihood if f in live else float("-inf")
            fresh.log_likelihood, fresh.iterations = (log if step else float("-inf")), step
            fresh.converged = bool(step and abs(log - before) / n < tol)
            if fresh.converged or step >= max_iter:
                done[f] = fresh
                live.pop(f, None)
            else:
                live[f] = fresh
                going[f] = factors
        return going

    going = advance(_sums(rows, centres, shift), 0)
    for step in range(1, max_iter + 1):
        if not going:
            break
        going = advance(_sums(rows, going, shift), step)
    best = {}
    for k in dict.fromkeys(k for k, _ in plan.values()):
        fits = [f for f, (own, _) in plan.items() if own == k and f in done]
        if fits:
            best[k] = max(fits, key=lambda f: (done[f].log_likelihood, -f))
        else:
            out[k] = "; ".join(sorted({broken[f] for f, (own, _) in plan.items() if own == k and f in broken})) or "no iteration was allowed"
    if best:  # the likelihood of the last mixtures themselves
        last = _sums(rows, {f: done[f].factors() for f in best.values()}, shift)
        for k, f in best.items():
            m = done[f]
            out[k] = Mixture(m.weights, m.means + shift, m.covariances, last[f][1], m.iterations, m.converged)
    return {k: out[k] for k in ks}


def assigned(features: Column, *models: Mixture) -> Column:
    """For each mixture the most likely component and its probability, as an array of structs."""
    factors = [m.factors() for m in models]

    @F.pandas_udf("array<struct<cluster:int,confidence:double>>")
    def pick(x):
        import pandas as pd
        values = np.array(x.tolist(), np.float64)
        found = []
        for own in factors:
            p = np.vstack([memberships(values[i:i + CHUNK], own)[0] for i in range(0, len(values), CHUNK)])
            at = p.argmax(axis=1)
            found.append([{"cluster": int(c), "confidence": float(v)} for c, v in zip(at, p[range(len(p)), at])])
        return pd.Series(list(map(list, zip(*found))))

    return pick(features)


def mean_silhouettes(df: DataFrame, features: str, labels: list[str], sample: int = 10_000) -> list[float]:
    """Mean Euclidean silhouette of each column of labels over ``sample`` rows chosen by hash (all rows, where there are fewer); 0 for a single label.

    Every block of rows meets the sample's blocks, and each pair of blocks gives sums of distances by cluster; no pair becomes a row. The sample,
    which is bounded by its parameter, is what all tasks share.
    """
    prepare(df.sparkSession)
    chosen = (df.select(coordinates(df, features).alias("_x"), F.array(*[F.col(c).cast("int") for c in labels]).alias("_l"))
              .orderBy(F.xxhash64("_x", "_l")).limit(sample))
    kept = chosen.toArrow()  # at most ``sample`` rows
    points = matrix(kept.column("_x").combine_chunks()) if len(kept) else np.zeros((0, 0))
    marks = np.array(kept.column("_l").to_pylist(), np.int64).reshape(len(points), len(labels))
    known = [np.unique(marks[:, i], return_inverse=True) for i in range(len(labels))]
    if not any(len(names) > 1 for names, _ in known):
        return [0.0] * len(labels)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((points, [(len(names), place) for names, place in known]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, clusters = shared.value
        hot = [np.eye(k)[place] for k, place in clusters]
        sizes = [np.bincount(place, minlength=k) for k, place in clusters]
        for b in batches:
            total = np.zeros(len(clusters))
            for at in b.column(0).to_pylist():
                rows = np.arange(at * CHUNK, min((at + 1) * CHUNK, len(points)))
                sums = [np.zeros((len(rows), k)) for k, _ in clusters]
                for i in range(0, len(points), CHUNK):
                    other = np.arange(i, min(i + CHUNK, len(points)))
                    gap = np.zeros((len(rows), len(other)))
                    for x, y in zip(points[rows].T, points[other].T):
                        gap += (x[:, None] - y) ** 2
                    gap = np.sqrt(gap)
                    for s, h in zip(sums, hot):
                        s += gap @ h[other]
                for c, (s, (k, place)) in enumerate(zip(sums, clusters)):
                    if k < 2:
                        continue
                    own, n = place[rows], sizes[c]
                    r = np.arange(len(rows))
                    inside = s[r, own] / np.maximum(n[own] - 1, 1)
                    mean = s / n
                    mean[r, own] = np.inf
                    outside = mean.min(axis=1)
                    top = np.maximum(inside, outside)
                    total[c] += np.where((n[own] > 1) & (top > 0), (outside - inside) / np.where(top > 0, top, 1), 0).sum()
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    blocks = spark.range(-(-len(points) // CHUNK)).repartition(min(-(-len(points) // CHUNK), spark.sparkContext.defaultParallelism))
    total = np.sum(map_arrow(blocks, add, "s array<double>").toArrow().column("s").to_pylist(), axis=0)
    return (total / len(points)).tolist()
