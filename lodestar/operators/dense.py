"""Dense search by cosine similarity, exact in blocks; ``vector_index`` has the approximate search.

Exact search deals queries and vectors out into groups of bounded size; each pair of groups is one task that
multiplies two matrices and keeps the best per query. Nothing is broadcast and no all-pairs table arises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vector import MIN_NORM

VECTOR_ROWS, QUERY_ROWS = 50_000, 2_000
SCORE_DIGITS = 6


def validated(vectors: DataFrame, dim: int) -> DataFrame:
    """The vectors; an error at run time if one hasn't ``dim`` components."""
    message = F.concat(F.lit(f"expected {dim} components, found "), F.coalesce(F.size("embedding"), F.lit(-1)).cast("string"))
    good = F.coalesce(F.size("embedding"), F.lit(-1)) == dim
    return vectors.withColumn("embedding", F.when(good, F.col("embedding")).otherwise(F.raise_error(message)))


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score; ties to the smaller chunk_index."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    rows = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1)), MIN_NORM)[:, None]


def _block(k: int | None, threshold: float | None):
    schema = pa.schema([("query_id", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        queries, rows = _unit(left.column("embedding")), _unit(right.column("embedding"))
        query_ids, row_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
        q_out, r_out, s_out = [], [], []
        step = max(1, 4_000_000 // max(1, len(rows)))
        for low in range(0, len(queries), step):
            scores = np.round(queries[low : low + step] @ rows.T, SCORE_DIGITS + 6)
            for i, s in enumerate(scores):
                keep = np.arange(len(s)) if threshold is None else np.flatnonzero(np.round(s[:], SCORE_DIGITS) >= threshold)
                if k is not None and len(keep) > k:
                    rounded = np.round(s[keep], SCORE_DIGITS)
                    least = np.partition(rounded, len(keep) - k)[len(keep) - k]
                    keep = keep[rounded >= least]  # all that tie for the last place; the window decides
                q_out.append(np.full(len(keep), query_ids[low + i]))
                r_out.append(row_ids[keep])
                s_out.append(s[keep])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (q_out, r_out, s_out)], schema=schema)

    return run


def _dealt(vectors: DataFrame, queries: DataFrame, vector_rows: int, query_rows: int, within: bool = False) -> tuple[DataFrame, DataFrame]:
    n_queries = queries.count()
    if not n_queries:  # else every vector would be dealt out to Python for nothing
        queries, vectors = (df.where(F.lit(False)) for df in (queries, vectors))
    across = max(1, -(-vectors.count() // vector_rows))
    down = max(1, -(-n_queries // query_rows))
    deal = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = (F.col("tenant").alias("tenant") if within else F.lit("").alias("tenant"),)
    rows = vectors.select(F.col("chunk_index").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *own)
    asked = queries.select(F.col("query_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *own)
    return (
        asked.withColumns({"down": deal(2, down)}).withColumn("across", each(across)),
        rows.withColumns({"across": deal(1, across)}).withColumn("down", each(down)),
    )


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, vector_rows: int = VECTOR_ROWS, query_rows: int = QUERY_ROWS, within: bool = False
) -> DataFrame:
    """(query_id, chunk_index, score, rank) of the k most similar vectors, of those at least ``threshold`` alike.

    With ``within`` both sides have a tenant, and a query meets the vectors of its own only.
    """
    asked, rows = _dealt(vectors, queries, vector_rows, query_rows, within)
    keys = ["tenant", "across", "down"]
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_block(k, threshold), "query_id long, chunk_index long, score double")
    return ranked(found.withColumn("score", F.round("score", SCORE_DIGITS)), k)


def at_least(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, chunk_index, score) of every vector at least that similar."""
    asked, rows = _dealt(vectors, queries, VECTOR_ROWS, QUERY_ROWS)
    found = asked.groupBy("across", "down").cogroup(rows.groupBy("across", "down")).applyInArrow(_block(None, threshold), "query_id long, chunk_index long, score double")
    return found.withColumn("score", F.round("score", SCORE_DIGITS))
