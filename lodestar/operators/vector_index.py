"""Approximate dense search by inverted lists.

A bounded sample of the vectors gives centroids (k-means); every vector goes to the list of its nearest centroid. A
query probes the lists of its nearest centroids, so it meets a share of the vectors. How many lists are probed is
calibrated: for a bounded sample of vectors their true neighbours are found by brute force, and as many lists are
probed as hold ``recall`` of them. The index is two tables, centroids and vectors with their lists; vectors that come
later go to the lists there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import dense
from lodestar.plans.session import broadcast_if_small

#: Vectors of the sample that the centroids are fitted on, the most lists, and vectors whose neighbours are looked up.
FIT_ROWS, MAX_LISTS, CALIBRATION_ROWS = 20_000, 1024, 100
#: Vectors of a list that one task takes.
LIST_ROWS = 50_000


def _units(column: pa.Array) -> np.ndarray:
    return dense._unit(pa.chunked_array([column.cast(pa.list_(pa.float64()))]))


def fit(vectors: DataFrame, lists: int | None = None, rows: int = FIT_ROWS) -> np.ndarray:
    """Centroids, as unit vectors: k-means by cosine on at most about ``rows`` vectors."""
    n = vectors.count()
    drawn = vectors.select("embedding").sample(min(1.0, rows / n), seed=7) if n > rows else vectors.select("embedding")
    sample = _units(drawn.toArrow().column(0).combine_chunks()) if n else np.zeros((0, 1))
    lists = min(lists or max(1, round(n**0.5)), MAX_LISTS, max(1, len(sample)))
    rng = np.random.default_rng(0)
    centroids = sample[rng.choice(len(sample), lists, replace=False)] if len(sample) else np.zeros((1, 1))
    for _ in range(10):
        nearest = (sample @ centroids.T).argmax(axis=1) if len(sample) else np.zeros(0, int)
        for i in range(lists):
            if (nearest == i).any():
                centroids[i] = sample[nearest == i].mean(axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-9)
    return centroids


def listed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(chunk_index, embedding, list)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = (_units(batch.column(1)) @ centroids.T).argmax(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], ["chunk_index", "embedding", "list"])

    rows = vectors.select("chunk_index", F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(run, "chunk_index long, embedding array<float>, list int")


def calibrated(vectors: DataFrame, centroids: np.ndarray, k: int = 10, recall: float = 0.95, rows: int = CALIBRATION_ROWS) -> int:
    """How many lists hold that share of the k nearest neighbours of a sample."""
    n = vectors.count()
    if not n:
        return 1
    drawn = vectors.select("chunk_index", "embedding").sample(min(1.0, 2 * rows / n), seed=11).orderBy("chunk_index").limit(rows)
    asked = drawn.select(F.col("chunk_index").alias("query_id"), "embedding")
    found = dense.search(vectors, asked, k).select("query_id", "chunk_index").join(vectors, "chunk_index")
    home = {(r["query_id"], r["chunk_index"]): r["list"] for r in listed(found, centroids).join(found.select("query_id", "chunk_index"), "chunk_index").collect()}
    rows_ = {r["query_id"]: r["embedding"] for r in asked.collect()}
    place = {q: np.argsort(np.argsort(-(np.asarray(v, float) @ centroids.T), kind="stable")) for q, v in rows_.items()}
    ranks = np.sort([place[q][at] for (q, _), at in home.items()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1


@dataclass(frozen=True)
class VectorIndex:
    #: (list, centroid, probes), at most MAX_LISTS rows.
    centroids: DataFrame
    #: (chunk_index, embedding, list)
    vectors: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, lists: int | None = None, k: int = 10, recall: float = 0.95) -> VectorIndex:
        """``vectors`` are (chunk_index, embedding)."""
        centroids = fit(vectors, lists)
        probes = calibrated(vectors, centroids, k, recall)
        rows = [(i, c.tolist(), probes) for i, c in enumerate(centroids)]
        return cls(vectors.sparkSession.createDataFrame(rows, "list int, centroid array<double>, probes int"), listed(vectors, centroids))

    def tables(self) -> dict[str, DataFrame]:
        return {"centroids": self.centroids, "vectors": self.vectors.repartitionByRange("list", "chunk_index").sortWithinPartitions("list")}

    def _centroids(self) -> tuple[np.ndarray, int]:
        rows = self.centroids.orderBy("list").collect()
        return np.array([r["centroid"] for r in rows], np.float64), max(r["probes"] for r in rows)

    def added(self, vectors: DataFrame) -> DataFrame:
        """Rows of the vectors' table for vectors that come later."""
        return listed(vectors, self._centroids()[0])

    def probed(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, embedding, list): the lists that each query (query_id, embedding) looks into."""
        centroids, usual = self._centroids()
        n = min(probes or usual, len(centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(_units(batch.column(1)) @ centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.reshape(-1))], ["query_id", "embedding", "list"])

        rows = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
        return rows.mapInArrow(run, "query_id long, embedding array<double>, list int")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, chunk_index, score, rank) of the most similar vectors in the lists probed."""
        sizes = self.vectors.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(LIST_ROWS))).cast("int").alias("k"))
        sizes = broadcast_if_small(sizes)
        rows = self.vectors.join(sizes, "list").select(F.col("chunk_index").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "list", F.pmod(F.xxhash64("chunk_index"), F.col("k")).cast("int").alias("part"))
        asked = self.probed(queries, probes).join(sizes, "list").select(F.col("query_id").alias("id"), "embedding", F.col("list").alias("list"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"))
        found = asked.groupBy("list", "part").cogroup(rows.groupBy("list", "part")).applyInArrow(dense._block(k, None), "query_id long, chunk_index long, score double")
        return dense.ranked(found.withColumn("score", F.round("score", dense.SCORE_DIGITS)), k)
