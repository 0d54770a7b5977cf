"""Vectors of texts from the texts themselves: a truncated singular value decomposition of tf-idf weights.

A token is a feature by its hash, one of ``FEATURES``, so every matrix with a row for each feature is of a size that doesn't
grow with the corpus. A text's row of weights has ``(1 + ln tf) * idf`` for each of its features and unit length. Subspace
iteration finds the directions in which the rows vary most: a pass over all rows multiplies them with the present
directions and the products with the rows again, block by block in each task; tasks' sums are added up by ranges
of features; between passes the driver makes the directions orthogonal. A last pass gives the singular values.
Counts of features are made once and stored; all rows take part in every pass.

A text's vector is its row times the directions, at unit length, so a text that comes later gets one without a new fit. A text
without tokens has the zero vector; a null text is an empty one. Rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.plans.session import materialized

FEATURES, DIMS, OVERSAMPLE, PASSES = 1 << 15, 64, 10, 4
#: Weights that are multiplied at once, tasks whose sums are added up, and ranges of features that sums are cut into.
BLOCK_WEIGHTS, TASKS, RANGES = 50_000, 512, 32
COUNTS = "chunk_index long, features array<int>, counts array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each of a text's features occurs in it."""
    for batch in batches:
        lists = batch.column(1)
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        found, n = np.unique(np.repeat(np.arange(len(size)), size) << 32 | lists.flatten().to_numpy().astype(np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(found >> 32, np.arange(len(size) + 1)), pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (found & 0xFFFFFFFF, n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["chunk_index", "features", "counts"])


def feature_counts(chunks: DataFrame, features: int = FEATURES) -> DataFrame:
    """(chunk_index, features, counts)"""
    tokens = lexical.tokenized(chunks.where(F.col("chunk_index").isNotNull()))
    hashed = F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))
    return tokens.select(F.col("chunk_index").cast("long").alias("chunk_index"), hashed.alias("features")).mapInArrow(_counted, COUNTS)


def _weights(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows, in order: (how many rows, features, weights of unit rows, the rows' numbers in the block)."""
    features, counts = batch.column("features"), batch.column("counts")
    ends = features.offsets.to_numpy().astype(np.int64) - features.offsets[0].as_py()
    f, n = features.flatten().to_numpy(), counts.flatten().to_numpy()
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + BLOCK_WEIGHTS, side="right")) - 1)
        own, row = slice(ends[low], ends[high]), np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        weight = (1 + np.log(n[own])) * idf[f[own]]
        length = np.sqrt(np.bincount(row, weight * weight, high - low))
        yield high - low, f[own], weight / length[row], row
        low = high


def _sums(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of each key, which are in order."""
    out = np.zeros((n, values.shape[1]))
    if len(key):
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        out[key[starts]] = np.add.reduceat(values, starts)
    return out


def _add_sums(total: np.ndarray, product: np.ndarray, weight: np.ndarray, row: np.ndarray, key: np.ndarray) -> None:
    """Adds the sums of the weighted rows of each key to the total; no more of it is touched."""
    if len(key):
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        total[key[order][starts]] += np.add.reduceat(weight[order, None] * product[row[order]], starts)


def _pass(idf: np.ndarray, directions: np.ndarray, gram: bool) -> Callable:
    """A task's sum of rows' transposes times their products, in ranges of features; with ``gram`` of products' squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = directions.shape[1]
        total = np.zeros((width if gram else len(idf), width))
        for batch in batches:
            for n, f, weight, row in _weights(batch, idf):
                product = _sums(weight[:, None] * directions[f], row, n)
                if gram:
                    total += product.T @ product
                else:
                    _add_sums(total, product, weight, row, f)
        parts = np.array_split(total, 1 if gram else RANGES)
        yield pa.RecordBatch.from_pydict({"range": pa.array(range(len(parts)), pa.int32()), "part": pa.array([p.tobytes() for p in parts], pa.binary())})

    return run


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py()) for x in rows.column("part"))
    return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def _product(counts: DataFrame, idf: np.ndarray, directions: np.ndarray, gram: bool = False) -> np.ndarray:
    kind = "range int, part binary"
    parts = counts.coalesce(TASKS).mapInArrow(_pass(idf, directions, gram), kind).groupBy("range").applyInArrow(_added, kind).collect()  # a matrix of features x directions
    return np.concatenate([np.frombuffer(bytes(r["part"])) for r in sorted(parts, key=lambda r: r["range"])]).reshape(-1, directions.shape[1]) if parts else np.zeros((0, directions.shape[1]))


@dataclass(frozen=True)
class TextVectors:
    """A fitted embedder: what a feature weighs, its row of the directions, and the singular values."""

    idf: np.ndarray
    directions: np.ndarray
    values: np.ndarray

    @classmethod
    def fit(cls, chunks: DataFrame, dims: int = DIMS, features: int = FEATURES, passes: int = PASSES) -> TextVectors:
        """Fits on all chunks (chunk_index, text)."""
        counts = materialized(feature_counts(chunks, features), "feature-counts")
        n = counts.count()
        df = np.zeros(features)
        for r in counts.select(F.explode("features").alias("f")).groupBy("f").count().collect():  # at most FEATURES rows
            df[r["f"]] = r["count"]
        idf = np.log((1 + n) / (1 + df)) + 1
        width = min(dims + OVERSAMPLE, features)
        directions = np.linalg.qr(np.random.default_rng(0).normal(size=(features, width)))[0]
        for _ in range(passes if n else 0):
            directions = np.linalg.qr(_product(counts, idf, directions))[0]
        if not n:
            return cls(idf, directions[:, :dims], np.zeros(min(dims, width)))
        squares, turn = np.linalg.eigh(_product(counts, idf, directions, gram=True))
        best = np.argsort(-squares)[:dims]
        return cls(idf, directions @ turn[:, best], np.sqrt(np.maximum(squares[best], 0)))

    def embed(self, chunks: DataFrame) -> DataFrame:
        """(chunk_index, embedding) of chunks (chunk_index, text)."""
        idf, directions = self.idf, self.directions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blocks = [_sums(weight[:, None] * directions[f], row, n) for n, f, weight, row in _weights(batch, idf)]
                rows = np.concatenate([np.zeros((0, directions.shape[1])), *blocks])
                rows = rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows.astype(np.float32)), pa.list_(pa.float32()))], ["chunk_index", "embedding"])

        return feature_counts(chunks, len(idf)).mapInArrow(run, "chunk_index long, embedding array<float>")

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """For ``sources.index_store``: a row for each feature, and the singular values as the row of feature -1."""
        ids = pa.array([-1, *range(len(self.idf))], pa.int32())
        rows = [self.values, *self.directions]
        return {"term_vectors": spark.createDataFrame(pa.table({"feature": ids, "idf": pa.array([0.0, *self.idf]), "vector": pa.array(rows, pa.list_(pa.float64()))}))}


def load(spark: SparkSession, folder: str) -> TextVectors:
    """The stored embedder of ``sources.index_store``."""
    from lodestar.sources.index_store import read_tables

    rows = read_tables(spark, folder)["term_vectors"].orderBy("feature").toArrow()  # a row for each feature
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return TextVectors(rows.column("idf").to_numpy()[1:], vectors[1:], vectors[0])
