"""Exact top-k search by inner product: columnar branch and bound.

Query rows meet candidate rows in tasks of bounded size: candidates and queries are dealt out by a hash into
groups of about ``candidate_rows`` and ``query_rows``, and every pair of groups is one task. The first group of
candidates goes first; the k-th best score that a query finds there is its bound in all other tasks. In a task the
candidates lie in vertical layout, one row of memory per dimension, longest vectors first. Scores grow dimension
block by dimension block; after each block the bound "score so far + remaining query mass x remaining candidate
mass" (Cauchy-Schwarz) drops the candidates that can't reach the k-th best, and the survivors are compacted. Once the
whole mass of a block of candidates can't reach it, the rest is shorter still and the query is done.

Components are integers after ``floor(256 * x)``. They travel as 16-bit integers where all of a vector's fit, else as
doubles; the two kinds meet in tasks of their own. Sums stay exact in doubles below 2**53; groups whose values could
exceed that are scored with Python integers, and a score beyond 64 bits is given as the nearest 64-bit integer after it
has been ranked exactly.

Vectors that are null or empty, or hold a null or a non-finite component, take no part, nor do rows without an id;
vectors of another length than the query's aren't its candidates. A repeated id is a candidate once for each row, and
queries that share an id have one answer together. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

SCALE = 256.0
CANDIDATE_ROWS, QUERY_ROWS = 50_000, 4_000
BLOCK_DIMS, CHUNK = 8, 8192

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("exact", pa.string())])
_LONG = 2**63


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    """The integer components as doubles: 16-bit ones as they came, or the whole vectors."""
    small = table.column("small").combine_chunks()
    values = small if small.null_count == 0 else table.column("large").combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def branch_and_bound(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, block: int = BLOCK_DIMS, chunk: int = CHUNK, floors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, list | np.ndarray]:
    """(query index, row index, score) of the k best rows for each query, ties to the smaller id, own id left out.

    With ``floors`` a query's rows below its floor may be left out.
    """
    dims = queries.shape[1]
    largest = (np.abs(queries).max(initial=0) + 1) * (np.abs(rows).max(initial=0) + 1) * max(1, dims)
    if largest >= 2**53:
        return _by_integers(queries, query_ids, rows, row_ids, k)
    # Dimensions with most mass first, so that what remains is soon small; longest rows first, so that bounds rise soon.
    order = np.argsort(-((queries**2).sum(axis=0) * (rows**2).sum(axis=0)), kind="stable")
    by_length = np.argsort(-(rows**2).sum(axis=1), kind="stable")
    row_ids = row_ids[by_length]
    queries, upright = queries[:, order], np.ascontiguousarray(rows[by_length][:, order].T)
    cuts = list(range(0, dims, block))
    rest_q = np.stack([np.sqrt((queries[:, c:] ** 2).sum(axis=1)) for c in cuts + [dims]])
    rest_r = np.stack([np.sqrt((upright[c:] ** 2).sum(axis=0)) for c in cuts + [dims]])
    out_q, out_r, out_s = [], [], []
    for q in range(len(queries)):
        best_s, best_r = np.zeros(0), np.zeros(0, np.int64)
        least = -math.inf if floors is None else floors[q]
        for low in range(0, len(rows), chunk):
            # the slack covers the rounding of the square roots
            if rest_q[0, q] * rest_r[0, low] * (1 + 1e-9) + 1e-3 < least:
                break
            left = np.arange(low, min(low + chunk, len(rows)))
            left = left[row_ids[left] != query_ids[q]]
            score = np.zeros(len(left))
            for b, c in enumerate(cuts):
                score += queries[q, c : c + block] @ upright[c : c + block, left]
                if least > -math.inf:
                    may = score + rest_q[b + 1, q] * rest_r[b + 1, left] * (1 + 1e-9) + 1e-3 >= least
                    if not may.all():
                        left, score = left[may], score[may]
                if not len(left):
                    break
            best_s, best_r = np.concatenate((best_s, score)), np.concatenate((best_r, left))
            top = np.lexsort((row_ids[best_r], -best_s))[:k]
            best_s, best_r = best_s[top], best_r[top]
            if len(best_s) == k:
                least = max(least, best_s[-1])
        out_q.append(np.full(len(best_r), q))
        out_r.append(by_length[best_r])
        out_s.append(best_s)
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s).astype(np.int64)


def _by_integers(queries, query_ids, rows, row_ids, k):
    """The same for values of any size."""
    upright = np.array([[int(x) for x in r] for r in rows], object).T
    found = []
    for q, vector in enumerate(queries):
        scores = np.array([int(x) for x in vector], object) @ upright
        others = np.flatnonzero(row_ids != query_ids[q]).tolist()
        found += [(q, i, scores[i]) for i in sorted(others, key=lambda i: (-scores[i], row_ids[i]))[:k]]
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), [f[2] for f in found]


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        dims = key[0].as_py()
        query_ids, row_ids = (t.column("id").to_numpy() for t in (left, right))
        floors = left.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
        floors = np.where(np.isnan(floors) | (np.abs(floors) >= 2.0**52), -math.inf, floors)
        q, r, s = branch_and_bound(_matrix(left, dims), query_ids, _matrix(right, dims), row_ids, k, floors=floors)
        exact = [int(x) for x in s]
        whole = [max(-_LONG, min(_LONG - 1, x)) for x in exact]
        beyond = [None if x == y else str(x) for x, y in zip(exact, whole, strict=True)]
        return pa.Table.from_arrays([pa.array(query_ids[q]), pa.array(row_ids[r]), pa.array(whole, pa.int64()), pa.array(beyond, pa.string())], schema=_FOUND)

    return run


def _groups(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    candidate_rows: int = CANDIDATE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query`` holds."""
    ok = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    bad = lambda x: x.isNull() | (x.cast("double") == nan) | (F.abs(x.cast("double")) == inf)
    ok = ok & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad)
    # a double holds 256 * x exactly but for the very largest, whose product is brought back to the largest double
    product = lambda x: F.least(F.greatest(x.cast("double") * SCALE, F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))
    whole = F.transform(vector_col, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(product(x)).cast("double")).otherwise(product(x)))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dims"), whole.alias("large"), is_query.alias("is_query"))
    wide = F.exists("large", lambda x: F.abs(x) > 32767.0)
    rows = rows.withColumn("wide", wide).withColumn("small", F.when(~F.col("wide"), F.transform("large", lambda x: x.cast("short"))))
    rows = rows.withColumn("large", F.when(F.col("wide"), F.col("large")))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    across, down = _groups(n, candidate_rows), _groups(n_queries, query_rows)
    deal = lambda seed, parts: F.pmod(F.xxhash64("id", F.monotonically_increasing_id(), F.lit(seed)), F.lit(parts)).cast("int")
    shape = ["dims", "id", "small", "large"]
    # the group of a row must be the same wherever it is asked for
    kept = stored(rows.withColumns({"across": deal(1, across), "down": deal(2, down)}), "vectors")
    both = F.explode(F.array(F.lit(False), F.lit(True)))

    def found(groups: range, floors: DataFrame | None) -> DataFrame:
        numbers = lambda r: F.explode(F.sequence(F.lit(r.start), F.lit(r.stop - 1)))
        candidates = kept.where(F.col("across").between(groups.start, groups.stop - 1))
        candidates = candidates.select(*shape, F.col("wide").alias("wide_row"), "across", numbers(range(down)).alias("down"))
        candidates = candidates.withColumn("wide_query", both)
        asked = kept.where("is_query").select(*shape, F.col("wide").alias("wide_query"), "down")
        asked = asked.withColumn("floor", F.lit(None).cast("long")) if floors is None else asked.join(floors, F.col("id") == F.col("floor_id"), "left").drop("floor_id")
        asked = asked.withColumn("across", numbers(groups)).withColumn("wide_row", both)
        asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # the two sides must not share columns' identities
        keys = ["dims", "across", "down", "wide_query", "wide_row"]
        return asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long, exact string")

    # scores of one clipped value: by their digits, more digits being more for positive ones and less for negative ones
    digits = F.when(F.col("score") > 0, F.length("exact")).otherwise(-F.length("exact"))
    text = lambda positive: F.when((F.col("score") > 0) == positive, F.col("exact"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(digits), F.desc(text(True)), F.asc(text(False)), F.asc("vec_id"))
    ranked = lambda x: x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if across == 1:
        out = found(range(1), None)
    else:
        first = stored(ranked(found(range(1), None)).drop("rank"), "best")
        floors = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") == k).select(F.col("query_id").alias("floor_id"), "floor")
        out = first.unionByName(found(range(1, across), floors))
    return ranked(out).select("query_id", "rank", "vec_id", "score")


#: Queries are the rows whose vec_id is divisible by 50.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
