"""Ranking evaluation for many queries at once.

``hits`` are (query_id, chunk_index, rank), ``qrels`` (query_id, chunk_index, rel). Judgements that are missing
count as 0. Queries come from ``hits`` and ``qrels`` both, so one without hits scores 0.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def judged(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Hits with their relevance.

    Judgements are the larger side and pack well: by the size of their files Spark would broadcast millions of rows.
    """
    rel = qrels.select("query_id", "chunk_index", "rel").hint("merge")
    return hits.join(rel, ["query_id", "chunk_index"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)).cast("double"))


def _relevant(qrels: DataFrame) -> DataFrame:
    return qrels.where("rel > 0").groupBy("query_id").agg(F.count_distinct("chunk_index").alias("n_relevant"))


def ideals(qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, n_relevant, ideal): relevant chunks and the greatest dcg that a query's judgements allow, one row for each query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_index"))
    best = qrels.withColumn("_place", place).where(F.col("_place") <= k)
    best = best.groupBy("query_id").agg(F.sum(_gain(F.col("rel").cast("double"), F.col("_place"))).alias("ideal"))
    return best.join(_relevant(qrels), "query_id", "left").select("query_id", F.coalesce("n_relevant", F.lit(0).cast("long")).alias("n_relevant"), "ideal")


def measured(rows: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(query_id, n_hits, recall, rr, ndcg) of judged hits against ``ideals``; judgements themselves aren't read again."""
    near, hit = F.col("rank") <= k, F.col("rel") > 0
    own = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.count(F.when(near & hit, 1)).alias("_found"),
        F.min(F.when(hit, F.col("rank"))).alias("_first"),
        F.sum(F.when(near, _gain(F.col("rel"), F.col("rank")))).alias("_dcg"),
    )
    shares = {"recall": F.col("_found") / F.nullif(F.col("n_relevant"), F.lit(0)), "rr": 1.0 / F.col("_first"), "ndcg": F.col("_dcg") / F.nullif(F.col("ideal"), F.lit(0.0))}
    both = own.join(best, "query_id", "full")
    return both.select("query_id", F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"), *(F.coalesce(c, F.lit(0.0)).alias(name) for name, c in shares.items()))


def recall(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): relevant hits among the first k over relevant chunks; 0 where there are none."""
    found = judged(hits, qrels).groupBy("query_id").agg(F.sum(F.when((F.col("rank") <= k) & (F.col("rel") > 0), 1).otherwise(0)).alias("n"))
    both = found.join(_relevant(qrels), "query_id", "full")
    return both.select("query_id", F.coalesce(F.col("n") / F.col("n_relevant"), F.lit(0.0)).alias("recall"))


def reciprocal_rank(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    first = judged(hits, qrels).groupBy("query_id").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first"))
    both = first.join(_relevant(qrels).select("query_id"), "query_id", "full")
    return both.select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def _gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + 1.0)


def dcg(hits: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    rows = judged(hits, qrels).where(F.col("rank") <= k)
    return rows.groupBy("query_id").agg(F.sum(_gain(F.col("rel"), F.col("rank"))).alias("dcg"))


def ndcg(hits: DataFrame, qrels: DataFrame, k: int, ideal: str = "retrieved", binary: bool = False) -> DataFrame:
    """(query_id, ndcg). The ideal order is that of all retrieved hits, or with ``judged`` that of all judgements."""
    if ideal not in ("retrieved", "judged"):
        raise ValueError("ideal must be 'retrieved' or 'judged'")
    rows = judged(hits, qrels)
    if binary:
        rows = rows.where(F.col("rank") <= k).withColumn("rel", (F.col("rel") > 0).cast("double"))
        qrels = qrels.withColumn("rel", (F.col("rel") > 0).cast("double"))
    best = rows if ideal == "retrieved" else qrels.withColumn("rank", F.lit(0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank", "chunk_index"))
    best = best.withColumn("_place", place).where(F.col("_place") <= k)
    best = best.groupBy("query_id").agg(F.sum(_gain(F.col("rel").cast("double"), F.col("_place"))).alias("_ideal"))
    own = rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("rel"), F.col("rank"))).alias("_dcg"))
    both = own.join(best, "query_id", "full")
    return both.select("query_id", F.coalesce(F.col("_dcg") / F.nullif(F.col("_ideal"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def ablation(strategies: dict[str, DataFrame], qrels: DataFrame, k: int) -> DataFrame:
    """(strategy, n_queries, ndcg, recall, mrr): means over queries, one row for each strategy."""
    out = None
    for name, hits in strategies.items():
        rows = ndcg(hits, qrels, k).join(recall(hits, qrels, k), "query_id").join(reciprocal_rank(hits, qrels), "query_id")
        row = rows.agg(
            F.count(F.lit(1)).alias("n_queries"),
            *(F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(a) for c, a in (("ndcg", "ndcg"), ("recall", "recall"), ("rr", "mrr"))),
        ).select(F.lit(name).alias("strategy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def best_strategy(table: DataFrame, baseline: str, metric: str = "ndcg") -> DataFrame:
    """(best, best_value, base_value, improvement_percent)"""
    row = table.agg(
        F.max_by("strategy", F.struct(metric, F.col("strategy"))).alias("best"),
        F.max(metric).alias("best_value"),
        F.max(F.when(F.col("strategy") == baseline, F.col(metric))).alias("base_value"),
    )
    gain = (F.col("best_value") - F.col("base_value")) / F.nullif(F.col("base_value"), F.lit(0.0)) * 100
    return row.withColumn("improvement_percent", F.round(F.coalesce(gain, F.lit(0.0)), 4))


def timed(strategies: dict[str, Callable[[], DataFrame]], n_queries: int, spark: SparkSession) -> DataFrame:
    """(strategy, n_queries, seconds, mean_ms): each strategy is run once as a batch; the mean is over its queries."""
    rows = []
    for name, run in strategies.items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        rows.append((name, n_queries, round(seconds, 3), round(1000 * seconds / max(1, n_queries), 3)))
    return spark.createDataFrame(rows, "strategy string, n_queries long, seconds double, mean_ms double")
