"""Small moves of whole folders in the file system that a path names, each an atomic rename."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none where it does not exist."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Rename a finished folder to the place where readers look; a folder that is there already is what another attempt published."""
    fs, p = _fs(spark, source)
    _, to = _fs(spark, target)
    fs.mkdirs(to.getParent())
    if fs.exists(to):
        fs.delete(p, True)
    elif not fs.rename(p, to):
        raise OSError(f"cannot rename {source} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
