"""Second stage: a pair scorer over candidates' texts.

A scorer maps (query text, chunk text) columns to a score column. ``lexical_score`` is the built-in one; a
model is plugged in with ``model_scorer``, which loads it once for each worker and scores Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.plans.session import broadcast_if_small

Scorer = Callable[[Column, Column], Column]
SCORE_DIGITS = 6
#: Pairs that a model is given at once, and characters of a pair's longest text it is meant for.
MODEL_BATCH = 16


def lexical_score(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text holds; 0 for a query without tokens."""
    asked = F.array_distinct(tokenize(query))
    return F.coalesce(F.size(F.array_intersect(asked, tokenize(text))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = MODEL_BATCH) -> Scorer:
    """A scorer from ``load()``, which returns a function of equally long lists of queries and texts."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        predict = load()
        for queries, texts in pairs:
            out: list[float] = []
            for low in range(0, len(queries), batch):
                out += list(predict(list(queries[low : low + batch]), list(texts[low : low + batch])))
            yield pd.Series(out, dtype="float64")

    return lambda query, text: score(query, text)


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 5, scorer: Scorer = lexical_score) -> DataFrame:
    """(query_id, chunk_index, score, rank, stage1_pos): the k best candidates by the scorer, ties to the earlier."""
    asked = broadcast_if_small(queries.select("query_id", F.col("text").alias("_query")))
    # candidates are the small side of the join with the texts; adaptive execution broadcasts them when they fit
    pairs = chunks.select("chunk_index", F.col("text").alias("_text")).join(candidates, "chunk_index").join(asked, "query_id")
    scored = pairs.select("query_id", "chunk_index", F.round(scorer(F.col("_query"), F.col("_text")), SCORE_DIGITS).alias("score"), F.col("rank").alias("stage1_pos"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "stage1_pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
