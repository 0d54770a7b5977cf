import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# executors' Python workers find the package too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest given tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def plain(value):
    """Rows and arrays as tuples, so that they compare across engines."""
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, small):
    """Asserts that a query and its SQL give the same rows, in any order."""

    def check(query, sql):
        df = query(spark, small)
        other = duck.sql(sql)
        assert sorted(df.columns) == sorted(other.columns)
        names = sorted(df.columns)
        mine = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
        places = [other.columns.index(n) for n in names]
        theirs = sorted(repr(tuple(plain(r[p]) for p in places)) for r in other.fetchall())
        assert mine == theirs

    return check
