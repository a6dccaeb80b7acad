"""Readers and writers for pixel, sighting and result tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from marshline import constants as K
from marshline.functions.casting import coerce_numeric, nan_to_null
from marshline.grid import GridSpec, assign_grid_cell
from marshline.operators.sightings import unwrap_quoted_lines


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats})


def read_pixels(spark: SparkSession, path: str, tiles: list[int] | None = None,
                years: list[int] | None = None) -> DataFrame:
    """Pixels of the selected tiles and years; both prune partitions."""
    df = spark.read.parquet(path)
    if tiles is not None:
        df = df.where(F.col("tile_id").isin([int(t) for t in tiles]))
    if years is not None:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    return normalise_nulls(df)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file's lines, in order, those up to the first that holds more than blanks, commas and quotes; columns value, _file."""
    seen, done = {}, set()
    for b in batches:
        for name in pc.unique(b.column(1)).to_pylist():
            if name in done:
                continue
            own = b.filter(pc.equal(b.column(1), name))
            last = pc.index(pc.match_substring_regex(own.column(0), r'[^ \t\n\x0B\f\r,"]'), True).as_py()
            if last >= 0:
                done.add(name)
                own = own.slice(0, last + 1)
            start = seen.get(name, 0)
            seen[name] = start + own.num_rows
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(range(start, seen[name]), pa.int64())], names=["value", "_file", "_line"])


def read_delimited_sightings(spark: SparkSession, path: str) -> DataFrame:
    """All-string rows of a header-led text export without quoting rules.

    The delimiter is a tab when the header has one, else a comma. Rows with more
    fields than the header are dropped, shorter ones padded, missing-value texts
    become NULL. Only the header lines are looked at eagerly, and of a file only the lines up
    to its header are grouped: of several files, all must have the same one.
    """
    text = spark.read.text(path)
    lines = unwrap_quoted_lines(text).where(F.col("value") != "")
    first = text.where(F.col("_metadata.file_block_start") == 0).select("value", F.col("_metadata.file_path").alias("_file"))
    starts = (unwrap_quoted_lines(first.mapInArrow(_tops, "value string, _file string, _line long"))
              .where(F.col("value") != "").groupBy("_file").agg(F.min_by("value", "_line").alias("header")))
    headers = [r["header"] for r in starts.select("header").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"files with different headers, or none, in {path}: {headers}")
    header = headers[0]
    sep = "\t" if "\t" in header else ","
    names = [c.strip().strip('"').strip("'") for c in header.split(sep)]
    while names and not names[-1]:
        names.pop()
    fields = F.split("value", "\t" if sep == "\t" else ",", -1)
    rows = lines.where(F.col("value") != header).select(fields.alias("f")).where(F.size("f") <= len(names))
    return rows.select(*[
        F.when(~F.get("f", F.lit(i)).isin(K.NA_TEXTS), F.get("f", F.lit(i))).alias(n)
        for i, n in enumerate(names) if n])


def read_inat_sightings(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The five needed columns of a quoted CSV export, coordinates as numbers."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=multi_line)
    df = raw.select(*K.INAT_COLUMNS)
    return df.withColumns({c: coerce_numeric(F.col(c)) for c in ("latitude", "longitude")})


def read_model_input(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                     grid: GridSpec | None = None) -> DataFrame:
    """A stored cell-by-dekad table with ``dekad`` as a date.

    ``schema`` saves CSV inference. Tables that only hold cell centres get
    their integer keys from ``grid``.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    df = normalise_nulls(df.withColumn("dekad", F.to_date("dekad")))
    if "ix" not in df.columns:
        df = assign_grid_cell(df, grid or GridSpec(), "cell_x", "cell_y")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (),
                mode: str = "errorifexists") -> None:
    """Write a table as Parquet or headed CSV, optionally partitioned."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True)
    else:
        writer.format(fmt).save(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a one-row table of nested structs as JSON."""
    df.write.mode(mode).json(path)
