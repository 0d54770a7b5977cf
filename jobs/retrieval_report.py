"""A report of retrieval quality: what each strategy finds for every question, how good it is, and where it lost.

Reads documents (doc_id, source, text), vectors (vec_id, embedding; a document's vector is the one of its id),
questions (item_id, text; a question's vector is the one of its id) and labels (doc_id, quality). A question belongs to the
tenant ``source`` that ``tenant_of`` gives for its id; a labelled document of that tenant is relevant to it as far as its
quality says. Strategies: ``dense`` (exact cosine), ``lexical`` (BM25), ``hybrid`` (both, fused by reciprocal
ranks) and ``reranked`` (hybrid, then a pair scorer).

Writes three tables below ``output``, in folders by strategy:

* ``hits`` (strategy, query_id, chunk_index, rank, rel): the first ``k``;
* ``metrics`` (strategy, query_id, n_hits, recall, rr, ndcg): a row for each question that has hits or judgements;
* ``changes`` (strategy, query_id, ndcg, baseline_ndcg, change): against the baseline strategy, which must have been
  reported, now or before; change is better, worse or same.

A run replaces the folders of the strategies it was asked for and leaves the others, so a strategy can be added or
repeated by itself, and a run over the same tables gives the same files' rows. Each strategy's first stage is written once
and read by what builds on it. Missing vectors, texts or labels give no hits or no relevance, never an error.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import prepared, read, run_from_command_line
from lodestar.operators import dense, evaluation, fusion, lexical, rerank
from lodestar.plans.session import materialized

log = logging.getLogger("retrieval_report")

STRATEGIES = ("dense", "lexical", "hybrid", "reranked")
HITS = "query_id long, chunk_index long, rank long, rel double, strategy string"
METRICS = "query_id long, n_hits long, recall double, rr double, ndcg double, strategy string"
CHANGES = "query_id long, ndcg double, baseline_ndcg double, change string, strategy string"
TENANTS = 20
DIGITS = 6


def tenant_of(query_id: Column) -> Column:
    return F.concat(F.lit("src"), F.pmod(query_id, F.lit(TENANTS)).cast("string"))


class Found:
    """The strategies' hits (query_id, chunk_index, rank), each first stage made once."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, recall_k: int):
        self.chunks, self.vectors, self.queries, self.k, self.recall_k = chunks, vectors, queries, k, recall_k
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialized(make(), f"report-{name}")
        return self._made[name]

    def near(self) -> DataFrame:
        return self._once("dense", lambda: dense.search(self.vectors, self.queries.where("embedding IS NOT NULL"), max(self.k, self.recall_k)))

    def words(self) -> DataFrame:
        return self._once("lexical", lambda: lexical.search_texts(self.chunks, self.queries, max(self.k, self.recall_k)))

    def fused(self) -> DataFrame:
        lists = lambda: [hits.where(F.col("rank") <= self.recall_k) for hits in (self.words(), self.near())]
        return self._once("hybrid", lambda: fusion.rrf(lists(), self.recall_k, texts=self.chunks))

    def hits(self, strategy: str) -> DataFrame:
        made = {"dense": self.near, "lexical": self.words, "hybrid": self.fused, "reranked": lambda: rerank.rerank(self.fused(), self.queries, self.chunks, self.k)}
        return made[strategy]().where(F.col("rank") <= self.k).select("query_id", "chunk_index", "rank")


def metrics(hits: DataFrame, qrels: DataFrame, k: int, strategies: Sequence[str]) -> DataFrame:
    """(strategy, query_id, n_hits, recall, rr, ndcg) of judged hits, with the best order of all judgements as the ideal.

    A question of a strategy is one question to the evaluation, so all strategies are measured at once. Judgements, which
    grow with the documents, come in as one row for each question.
    """
    both = F.struct("strategy", "query_id").alias("query_id")
    best = evaluation.ideals(qrels, k).withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))
    rows = evaluation.measured(hits.select(both, "rank", "rel"), best.select(both, "n_relevant", "ideal"), k)
    return rows.select("query_id.strategy", "query_id.query_id", "n_hits", *(F.round(c, DIGITS).alias(c) for c in ("recall", "rr", "ndcg")))


def _replace(rows: DataFrame, path: str, strategies: Sequence[str]) -> None:
    """Writes a few rows' folders anew, those of the given strategies and no others; a strategy without rows loses the rows it had."""
    made = materialized(rows, "report-rows")
    for name in strategies:
        made.where(F.col("strategy") == name).drop("strategy").write.mode("overwrite").parquet(f"{path}/strategy={name}")


def whole_output(spark: SparkSession, output: str) -> DataFrame:
    """All three tables as one: ``kind`` is hit, metric or change."""
    hits, rows, changes = (read(spark, f"{output}/{n}", s) for n, s in (("hits", HITS), ("metrics", METRICS), ("changes", CHANGES)))
    out = hits.withColumn("kind", F.lit("hit")).unionByName(rows.withColumn("kind", F.lit("metric")), allowMissingColumns=True)
    return out.unionByName(changes.withColumn("kind", F.lit("change")), allowMissingColumns=True)


def retrieval_report(
    spark: SparkSession, documents: str, vectors: str, questions: str, labels: str, output: str, strategies: Sequence[str] = STRATEGIES, k: int = 10, recall_k: int = 50, baseline: str = "dense"
) -> dict[str, int]:
    """Reports the strategies asked for; returns how many rows of each table were read and written."""
    unknown = sorted({*strategies, baseline} - {*STRATEGIES})
    if unknown or not strategies:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}" if unknown else "no strategies")
    for name, schema in (("hits", HITS), ("metrics", METRICS), ("changes", CHANGES)):
        prepared(spark, f"{output}/{name}", schema, "strategy")
    docs, asked, judged = (spark.read.parquet(p) for p in (documents, questions, labels))
    chunks = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("chunk_index"), F.col("source").alias("tenant"), "text")
    near = spark.read.parquet(vectors).where(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("chunk_index"), "embedding")
    queries = asked.where(F.col("item_id").isNotNull()).select(F.col("item_id").alias("query_id"), "text").withColumn("tenant", tenant_of(F.col("query_id")))
    queries = materialized(queries.join(near.withColumnRenamed("chunk_index", "query_id"), "query_id", "left"), "report-questions")
    # labels grow with the documents, and as files they are small for their rows: neither side is broadcast
    owned = judged.where(F.col("quality").isNotNull()).withColumnRenamed("doc_id", "chunk_index").join(chunks.select("chunk_index", "tenant").hint("merge"), "chunk_index")
    qrels = materialized(queries.select("query_id", "tenant").join(owned, "tenant").select("query_id", "chunk_index", F.col("quality").alias("rel")), "report-judgements")
    done = {"documents_read": docs.count(), "questions_read": asked.count(), "labels_read": judged.count()}
    log.info("read %s, %s, %s, %s: %s", documents, vectors, questions, labels, done)

    found = Found(chunks, near, queries, k, recall_k)
    strategies = list(dict.fromkeys(strategies))
    hits = reduce(DataFrame.unionByName, [found.hits(name).withColumn("strategy", F.lit(name)) for name in strategies])
    _replace(evaluation.judged(hits, qrels), f"{output}/hits", strategies)
    written = read(spark, f"{output}/hits", HITS).where(F.col("strategy").isin(strategies))
    _replace(metrics(written, qrels, k, strategies), f"{output}/metrics", strategies)
    # changes of every strategy reported so far, for the baseline may be new
    rows = read(spark, f"{output}/metrics", METRICS)
    base = rows.where(F.col("strategy") == baseline).select("query_id", F.col("ndcg").alias("baseline_ndcg"))
    both = rows.select("strategy", "query_id", "ndcg").join(base, "query_id")
    change = F.when(F.col("ndcg") > F.col("baseline_ndcg"), "better").when(F.col("ndcg") < F.col("baseline_ndcg"), "worse").otherwise("same")
    _replace(both.withColumn("change", change), f"{output}/changes", STRATEGIES)
    done |= {name: read(spark, f"{output}/{name}", s).where(F.col("strategy").isin(strategies)).count() for name, s in (("hits", HITS), ("metrics", METRICS), ("changes", CHANGES))}
    log.info("wrote %s: %s", output, done)
    return done


if __name__ == "__main__":
    run_from_command_line(retrieval_report, ("documents", "vectors", "questions", "labels", "output"))
