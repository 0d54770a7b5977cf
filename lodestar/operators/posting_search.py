"""Exact search of stored postings: chunks are scored in the tasks that hold them, and only the best leave a task.

The postings of the queries' terms are dealt out by their chunk, so all that a chunk's scores need is in one task, about
``TASK_POSTINGS`` of them. A task adds up one query after the other and gives at most k rows for each. What is shuffled are
the terms' postings, each once, and not the pairs of queries and chunks, of which there are as many as postings times
the queries that ask for their term.

Ranks are those of ``lexical``: scores rounded to ``SCORE_DIGITS``, ties to the larger chunk. Queries are sent to the
tasks in the groups of ``block_max``, one group after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.operators.block_max import QUERY_TERMS, Asked, _rounded, asked_by

#: Postings that a task scores, about.
TASK_POSTINGS = 500_000
_FOUND = pa.schema([("query", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64())])


def _best(ids: np.ndarray, scores: np.ndarray, hit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the chunks hit, by rounded score and then the larger id."""
    if len(hit) > k:  # those that rounding can't bring among the k best go first
        kth = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
        hit = hit[scores[hit] >= kth - 2 * 10.0**-lexical.SCORE_DIGITS]
    found, rounded = ids[hit], _rounded(scores[hit])
    top = np.lexsort((-found, -rounded))[:k]
    return found[top], rounded[top]


def _scored(queries: list[list[tuple[int, float]]], n_terms: int, k: int, avg_dl: float, k1: float, b: float, delta: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[column.to_numpy() for column in batch.columns] for batch in batches]
        if not held:
            return
        chunk, code, tf, dl = (np.concatenate(column) for column in zip(*held, strict=True))
        del held
        by_code = np.argsort(code, kind="stable")
        first = np.searchsorted(code[by_code], np.arange(n_terms + 1)).tolist()
        tf, dl = tf[by_code].astype(np.float64), dl[by_code].astype(np.float64)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl)) + delta
        ids, place = np.unique(chunk[by_code], return_inverse=True)
        rows = []
        for q, terms in enumerate(queries):
            own = [(slice(first[c], first[c + 1]), w) for c, w in terms if first[c] < first[c + 1]]
            if not own:
                continue
            at = np.concatenate([place[s] for s, _ in own])
            scores = np.bincount(at, np.concatenate([part[s] * w for s, w in own]), len(ids))
            found, rounded = _best(ids, scores, np.flatnonzero(np.bincount(at, minlength=len(ids))), k)
            rows.append(pa.record_batch([np.full(len(found), q), found, rounded], schema=_FOUND))
        yield from rows

    return run


def search(index: lexical.LexicalIndex, queries: DataFrame, k: int = 10, k1: float = lexical.K1, b: float = lexical.B, delta: float = lexical.DELTA) -> DataFrame:
    """(query_id, chunk_index, score, rank); chunks that share no term with a query aren't hits."""
    groups = max(1, -(-lexical.query_terms(queries).count() // QUERY_TERMS))
    parts = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) for g in range(groups)] if groups > 1 else [queries]
    return lexical.ranked(reduce(DataFrame.unionByName, [_found(index, part, asked_by(part), k, k1, b, delta) for part in parts]), k)


def _found(index: lexical.LexicalIndex, queries: DataFrame, asked: Asked, k: int, k1: float, b: float, delta: float) -> DataFrame:
    """(query_id, chunk_index, score): of a group of queries, at most k of each from each task."""
    spark, ids = queries.sparkSession, list(asked)
    names = spark.createDataFrame(list(enumerate(ids)), queries.select(F.lit(0).cast("long").alias("query"), "query_id").schema)
    code = {t: i for i, t in enumerate(sorted({t for ts in asked.values() for t, _ in ts}))}
    # a group of queries has at most QUERY_TERMS terms
    coded = F.broadcast(spark.createDataFrame(list(code.items()), "term string, code int"))
    posts = index.postings
    posts = posts.where(F.col("term").isin(list(code))) if 0 < len(code) <= lexical.FILTER_TERMS else posts
    posts = posts.join(coded, "term")
    df = {r["code"]: r["df"] for r in posts.groupBy("code").agg(F.count(F.lit(1)).alias("df")).collect()} if code else {}
    n, avg_dl = index.corpus_stats.first() if df else (0, 1.0)
    idf = {c: float(np.log(1.0 + (n - x + 0.5) / (x + 0.5))) for c, x in df.items()}
    weighted = [[(code[t], qtf * idf[code[t]]) for t, qtf in asked[q] if code[t] in idf] for q in ids]
    if not any(weighted):
        return names.select("query_id", F.lit(None).cast("long").alias("chunk_index"), F.lit(None).cast("double").alias("score")).where(F.lit(False))
    tasks = -(-sum(df.values()) // TASK_POSTINGS)
    dealt = posts.select(F.col("chunk_index").cast("long"), "code", "tf", "dl").repartition(tasks, "chunk_index")
    hits = dealt.mapInArrow(_scored(weighted, len(code), max(k, 1), avg_dl, k1, b, delta), "query long, chunk_index long, score double")
    return hits.join(F.broadcast(names), "query").drop("query")
