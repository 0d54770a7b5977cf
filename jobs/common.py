"""What the jobs' command lines share: arguments, the config file, the log, the session."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestar.plans.session import session

HERE = os.path.dirname(os.path.abspath(__file__))


def run_from_command_line(job: Callable[..., dict[str, Any]], paths: tuple[str, ...]) -> None:
    """Runs ``job(spark, <a path for each name>, **config)`` in a session of its own; the config is a JSON object."""
    parser = argparse.ArgumentParser(description=(job.__doc__ or "").split("\n")[0])
    for name in paths:
        parser.add_argument(f"--{name.replace('_', '-')}", required=True)
    parser.add_argument("--config", default=os.path.join(HERE, f"{job.__name__}.json"))
    parser.add_argument("--master", help="where it isn't set by spark-submit")
    found = parser.parse_args()
    with open(found.config) as f:
        config = json.load(f)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    # Python workers find the package
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(HERE), os.environ.get("PYTHONPATH", "")]))
    spark = session(found.master)
    try:
        print(json.dumps(job(spark, *(getattr(found, name) for name in paths), **config)))
    finally:
        spark.stop()


def prepared(spark: SparkSession, path: str, schema: str, *folders: str) -> None:
    """A table without rows at ``path``, if nothing is there."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*folders).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of declared columns, so that a folder's name is never taken for a number."""
    return spark.read.schema(StructType.fromDDL(schema)).parquet(path)
