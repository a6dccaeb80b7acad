"""Session construction and durable staging."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def build_session(app: str = "marshline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    Times are UTC, AQE is on so shuffle partitions are coalesced, skewed joins
    are split and small sides are broadcast from measured sizes.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return tune(b.getOrCreate())


def tune(spark: SparkSession, partition: str | None = "16m") -> SparkSession:
    """Runtime settings the operators rely on, for any session.

    Dates and day windows are in UTC. The JVM never compiles methods over 8000 bytes of bytecode. Dozens of
    aggregates fused into one generated method exceed that and would run
    interpreted; with this limit such a stage falls back to small methods.
    Medians per cell keep small maps per key: sorting instead of hashing pays
    from thousands of keys a task on, not from the default of 128.
    After a shuffle a task gets ``partition`` bytes: by the default of 64 MB the hash tables of wide means, half a million keys
    with 24 numbers each, are far larger than the processor's caches. A join whose smaller side has at most so much a task is hashed, not sorted.
    None leaves both at Spark's defaults.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
    for key in ("advisoryPartitionSizeInBytes", "maxShuffledHashJoinLocalMapThreshold"):
        if partition is None:
            spark.conf.unset(f"spark.sql.adaptive.{key}")
        else:
            spark.conf.set(f"spark.sql.adaptive.{key}", partition)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and staged tables.

    On a cluster this is the shared ``spark.checkpoint.dir`` the session names;
    without that setting it is an error, since executors do not share a local
    folder. In local mode a temporary folder stands in.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage so that several consumers do not recompute it, survives the
    loss of any executor, keeps column pruning, and gives the optimizer real
    sizes to choose join strategies from.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
