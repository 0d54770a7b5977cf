"""Reciprocal rank fusion of any number of hit lists, and tenant visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.registry import BUCKET, of_tenants

RRF_K = 60
#: Fused scores are ranked at this many digits and given at SCORE_DIGITS.
RANK_DIGITS, SCORE_DIGITS = 12, 6


def reranked(hits: DataFrame) -> DataFrame:
    """Ranks made dense again after rows were taken out."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order).cast("long"))


def rrf(lists: list[DataFrame], k: int = 10, rrf_k: int = RRF_K, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_index, score, rank): the sum of 1 / (rrf_k + rank) over the lists.

    Ties go to the better rank in the first list, then in the second, and so on. With ``texts`` (chunk_index,
    text) only the first chunk of each text stays. k <= 0 gives no rows.
    """
    parts = [df.select("query_id", "chunk_index", F.lit(i).alias("list"), "rank") for i, df in enumerate(lists)]
    both = reduce(DataFrame.unionByName, parts)
    places = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    fused = both.groupBy("query_id", "chunk_index").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), RANK_DIGITS).alias("raw"), *places)
    order = [F.desc("raw"), *(F.asc_nulls_last(f"rank_{i}") for i in range(len(lists))), F.asc("chunk_index")]
    if texts is not None:
        first = Window.partitionBy("query_id", F.xxhash64("text"), "text").orderBy(*order)
        fused = fused.join(texts.select("chunk_index", "text"), "chunk_index").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "text")
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    return fused.where(F.col("rank") <= k).select("query_id", "chunk_index", F.round("raw", SCORE_DIGITS).alias("score"), "rank")


def visible(hits: DataFrame, queries: DataFrame, registry: DataFrame, legacy: bool = False) -> DataFrame:
    """Hits on chunks of the query's own tenant, ranks made dense again; a query without a tenant keeps all.

    A tenant without chunks sees nothing; with ``legacy`` it sees everything. Of a registry that lies in folders by tenant
    only those of the queries' tenants are read.
    """
    asked = queries.select("query_id", F.col("tenant").alias("_tenant"))
    owned = of_tenants(registry, queries) if BUCKET in registry.columns else registry
    owned = owned.select("chunk_index", F.col("tenant").alias("_tenant"))
    named = hits.join(asked, "query_id")
    open_ = F.col("_tenant").isNull()
    if legacy:
        known = registry.select(F.col("tenant").alias("_tenant")).distinct().withColumn("_known", F.lit(True))
        named = named.join(known, "_tenant", "left")
        open_ = open_ | F.col("_known").isNull()
    own = named.where(~open_).join(owned, ["chunk_index", "_tenant"], "left_semi")
    return reranked(own.select(*hits.columns).unionByName(named.where(open_).select(*hits.columns)))
