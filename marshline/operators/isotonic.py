"""Isotonic regression by pooling adjacent violators in a merge tree over score ranges.

Equal scores are pooled first, by a grouped sum that combines map-side, so a score that most rows share is one row from then on. The distinct scores
are dealt to tasks by range; each pools its violators and passes on its pools. Ranges are then merged, ``ways`` neighbours at a time, until one is left: pooling
the pools of neighbouring ranges gives the pools of the whole. What the driver gets are the pools of the result. Their means rise strictly and are fractions of
sums of 0/1 labels, so N rows make at most in the order of N^(2/3) of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marshline.session import stage
from marshline.workers import map_arrow

_POOL = "part int, lo double, hi double, s double, w double"


@dataclass
class Isotonic:
    """A step function with straight lines between its steps; constant beyond its ends."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.zeros(len(score))

    def to_dict(self) -> dict:
        return {"x": self.x.tolist(), "y": self.y.tolist()}

    @classmethod
    def from_dict(cls, d: dict) -> "Isotonic":
        return cls(np.array(d["x"], float), np.array(d["y"], float))


class Pools:
    """Pools of one group in order, as lists: first score, last score, weighted sum, weight."""

    def __init__(self):
        self.rows: list[tuple[float, float, float, float]] = []

    def add(self, lo: float, hi: float, s: float, w: float) -> None:
        rows = self.rows
        while rows and rows[-1][2] * w >= s * rows[-1][3]:  # the one before has no smaller mean
            lo, _, s0, w0 = rows.pop()
            s, w = s + s0, w + w0
        rows.append((lo, hi, s, w))


def _pooled(batches: Iterator[pa.RecordBatch], ways: int, group: str) -> Iterator[pa.RecordBatch]:
    """Pools of sorted rows by group and range; columns group, part, lo, hi, s, w."""
    def out(g, part, pools, kind):
        n = len(pools.rows)
        columns = [pa.array([g] * n, kind), pa.array([part] * n, pa.int32()), *(pa.array([r[i] for r in pools.rows], pa.float64()) for i in range(4))]
        return pa.RecordBatch.from_arrays(columns, names=[group, "part", "lo", "hi", "s", "w"])

    now, pools, kind = None, None, None
    for b in batches:
        kind = b.schema.field(0).type
        for g, part, *row in zip(*(c.to_pylist() for c in b.columns)):
            if now != (g, part // ways):
                if pools is not None:
                    yield out(*now, pools, kind)
                now, pools = (g, part // ways), Pools()
            pools.add(*row)
    if pools is not None:
        yield out(*now, pools, kind)


def fit_isotonic(df: DataFrame, score: str, target: str, group: str, ways: int = 16) -> dict:
    """A rising function from score to mean target for each value of ``group``; rows with a missing score or target count for nothing."""
    kind = dict(df.dtypes)[group]
    pooled = (df.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(target).isNotNull()).groupBy(group, F.col(score).cast("double").alias("lo"))
              .agg(F.sum(F.col(target).cast("double")).alias("s"), F.count("*").cast("double").alias("w")))
    schema = f"`{group}` {kind}, {_POOL}"
    names = [group, "part", "lo", "hi", "s", "w"]
    dealt = (pooled.repartitionByRange(group, "lo").sortWithinPartitions(group, "lo").select(group, F.spark_partition_id().alias("part"), "lo", F.col("lo").alias("hi"), "s", "w"))
    ranges = stage(map_arrow(dealt, lambda b: _pooled(b, 1, group), schema), "pools")
    while (ranges.agg(F.max("part")).first()[0] or 0) > 0:
        near = (ranges.withColumn("_to", F.expr(f"part div {ways}")).repartition(group, "_to").sortWithinPartitions(group, "_to", "part", "lo").select(*names))
        ranges = stage(map_arrow(near, lambda b: _pooled(b, ways, group), schema), "pools")
    out = {}
    for r in ranges.orderBy(group, "lo").collect():
        x, y = out.setdefault(r[group], ([], []))
        mean = r["s"] / r["w"]
        for at in (r["lo"], r["hi"]) if r["hi"] > r["lo"] else (r["lo"],):
            x.append(at)
            y.append(mean)
    return {g: Isotonic(np.array(x), np.array(y)) for g, (x, y) in out.items()}
