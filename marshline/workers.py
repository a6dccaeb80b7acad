"""What operators that run numpy inside tasks need of a session."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import marshline


def prepare(spark: SparkSession) -> SparkSession:
    """Let local workers import this package; on a cluster it is installed, or shipped with ``--py-files``, like any other."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(marshline.__file__)))
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of doubles as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
