"""Arrow plumbing shared by the operators that run numpy inside tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import marshline

#: Rows and bytes that the JVM puts into one Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes as well as rows, collect per-document sets by sorting (their size is that of a text), and let local
    workers import this package.

    On a cluster the package is installed, or shipped with ``--py-files``, like any other.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "128")
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.abspath(marshline.__file__)))
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(run, schema)


def text_sizes(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``limit`` bytes of ``column`` each; a larger row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_sizes(batch.column(column)))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def filled(column: pa.Array) -> pa.Array:
    """The texts as one array with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


#: Bytes of a screen.
SCREEN = 1 << 20


def screen(keys: DataFrame, *cols: str) -> Callable[..., Column]:
    """A test on columns that every row of ``keys`` passes and others pass seldom, while keys are few against SCREEN.

    It goes before a join, so that rows without a partner are mostly not shuffled; the join itself stays. However many keys there are, at
    most SCREEN numbers come to the driver and SCREEN bytes go out.
    """
    def place(*c) -> Column:
        return F.pmod(F.xxhash64(*c), F.lit(SCREEN)).cast("int")

    marks = np.zeros(SCREEN, np.uint8)
    marks[keys.select(place(*cols).alias("p")).distinct().toArrow().column("p").to_numpy()] = 1
    table = keys.sparkSession.createDataFrame([(bytearray(marks.tobytes()),)], "marks binary")
    return lambda *c: F.substr(table.scalar(), place(*c) + 1, F.lit(1)) == F.lit(bytearray(b"\1"))
