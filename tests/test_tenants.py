"""The registry in folders by tenant: what is read, and that rows are those of the plain registry."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import fusion
from lodestar.sources import registry


@pytest.fixture(scope="module")
def plain_rows(spark):
    """1,200 chunks: a third of one tenant, some without a tenant, the others of 40."""
    n = F.col("id")
    tenant = F.when(n % 3 == 0, "hot").when(n % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("t"), n % 40))
    return spark.range(1200).select(n.alias("chunk_index"), tenant.alias("tenant"), F.concat(F.lit("text "), n).alias("text"))


@pytest.fixture(scope="module")
def folders(spark, plain_rows, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('registry')}/r"
    registry.write(plain_rows.where("chunk_index < 700"), path)
    registry.write(plain_rows.where("chunk_index >= 700"), path, append=True)
    return spark.read.parquet(path)


def _scanned(df):
    """How many folders the plan's scan of the registry has read; a scan that gave nothing may be gone from the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, left = [], [plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            left.append(node.plan())
        elif name == "FileSourceScanExec" and "tenant_bucket" in node.toString():
            found.append(node.metrics().apply("numPartitions").value())
        children = node.children()
        left.extend(children.apply(i) for i in range(children.size()))
    assert len(found) <= 1
    return sum(found)


def test_all_rows_are_kept(plain_rows, folders):
    assert sorted(map(str, folders.drop(registry.BUCKET).select(*plain_rows.columns).collect())) == sorted(map(str, plain_rows.collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        registry.write(plain_rows, folders.inputFiles()[0].split(f"/{registry.BUCKET}=")[0])


@pytest.mark.parametrize("tenant", ["hot", "t7", "nobody", "", "t7' OR '1'='1"])
def test_one_tenant(plain_rows, folders, tenant):
    found = registry.by_tenant(folders, tenant)
    assert found.columns == plain_rows.columns
    assert found.collect() == registry.by_tenant(plain_rows, tenant).collect()
    assert registry.indices_of(folders, tenant).collect() == registry.indices_of(plain_rows, tenant).collect()
    read = _scanned(found)
    assert read == 1 if tenant in ("hot", "t7") else read <= 1
    assert folders.select(registry.BUCKET).distinct().count() > 30


def test_some_tenants(spark, plain_rows, folders):
    asked = spark.createDataFrame([("t7",), ("t7",), (None,), ("nobody",), ("hot",)], "tenant string")
    found = registry.of_tenants(folders, asked)
    assert found.columns == plain_rows.columns
    assert sorted(found.collect()) == sorted(plain_rows.where("tenant IN ('t7', 'hot')").collect()) == sorted(registry.of_tenants(plain_rows, asked).collect())
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    # counted in a plan's first run only
    assert 2 <= _scanned(registry.of_tenants(folders, asked)) <= 3
    assert registry.of_tenants(folders, asked.limit(0)).count() == 0


@pytest.mark.parametrize("legacy", [False, True])
def test_visible_hits(spark, plain_rows, folders, legacy):
    asks = spark.createDataFrame([(0, "t7"), (1, "hot"), (2, None), (3, "nobody")], "query_id long, tenant string")
    hits = asks.select("query_id").crossJoin(plain_rows.where("chunk_index % 7 = 0").select("chunk_index"))
    hits = hits.withColumn("score", F.lit(1.0)).withColumn("rank", F.col("chunk_index") + 1)
    other = sorted(fusion.visible(hits, asks, plain_rows, legacy).collect())
    assert sorted(fusion.visible(hits, asks, folders, legacy).collect()) == other and {r["query_id"] for r in other} == ({0, 1, 2, 3} if legacy else {0, 1, 2})
