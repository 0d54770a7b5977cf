"""What the operators of this subpackage share: the session's shared folder and sizes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.session import broadcast_if_small, scratch, spread


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; an error where that isn't set on a cluster."""
    return scratch(spark, purpose)


def stored(df: DataFrame, purpose: str, *folders: str) -> DataFrame:
    """The rows of df, written as a table in the shared folder and read back, so that lineage ends here.

    With ``folders``, columns by whose values the table is laid out, a filter on them reads its own files only.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(frame: DataFrame) -> None:
    """Deletes a table of ``stored`` that nothing reads any more."""
    spark = frame.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame) -> DataFrame:
    """The smaller side of a join: broadcast if counted and found small, else hashed while the other streams past."""
    found = broadcast_if_small(df)
    return df.hint("shuffle_hash") if found is df else found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, over all cores even where it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
