"""Connected components of an edge table, by alternating large-star and small-star steps.

A step is a map-side combined minimum and an equi-join with it. The minima are dealt out anew before the join, so
that the join stands alone between exchanges and Spark may split the partition of a vertex with very many
neighbours. Each round is written to the shared folder, which cuts the lineage; the driver sees only two sums. Up to
``TASK_EDGES`` edges, which are thinned to forests before they are counted, take no rounds: one task joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_stored, stored

_EDGES = "a long, b long"
#: Edges that one task joins by itself.
TASK_EDGES = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex of its component) for the edges given, without the roots."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task, thinned to spanning forests of up to a million edges each."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        v, root = forest(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
        if count >= 1_000_000:
            yield flush()
            held, count = [], 0
    if held:
        yield flush()


def connected_components(edges: DataFrame, thin: bool = True) -> DataFrame:
    """(vertex, component) for every vertex of an edge; component is the smallest vertex reachable.

    ``thin`` first reduces the edges of each task to spanning forests; edges that are forests already need none
    of that. ``edges`` has two long columns a and b; null ends, loops and repeated edges are ignored. An empty table
    gives an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = stored(pairs.mapInArrow(_local_forests, _EDGES) if thin else pairs, "edges")
    if current.count() <= TASK_EDGES:
        whole = stored(current.coalesce(1).mapInArrow(_local_forests, _EDGES), "edges")
        drop_stored(current)
        return _named(whole)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.repartition("m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Now every edge points to a smaller vertex; small-star hooks those smaller ends onto the least of them.
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.repartition("m"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        sums = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(current)
        current = after
        if sums == before:
            break
        before = sums
    return _named(current)


def _named(forest_: DataFrame) -> DataFrame:
    roots = forest_.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return forest_.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
