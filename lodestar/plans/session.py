"""Session settings."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when counted and at most this many rows.
BROADCAST_ROWS = 200_000


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution and UTC; partitions and memory are the cluster's to set."""
    builder = SparkSession.builder.appName("lodestar").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below /tmp only where that is not set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/checkpoints"
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read from there, for plans that use them several times."""
    path = scratch(df.sparkSession, purpose)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(frame: DataFrame) -> None:
    """Deletes the folders that ``frame`` reads, which must be tables of ``materialized`` that nothing reads any more."""
    spark = frame.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {os.path.dirname(f) for f in frame.inputFiles()}:
        place = path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it is a scan that gives fewer than half as many partitions.

    A small file with one row group is one partition, however heavy the work on its rows; a large table has more
    partitions than cores and is left as it is.
    """
    execution = df._jdf.queryExecution()
    if "Exchange" in execution.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * execution.toRdd().getNumPartitions() <= cores else df
