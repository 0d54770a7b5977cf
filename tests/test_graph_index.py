"""Search on neighbour graphs against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, graph_index
from lodestar.operators.graph_index import GraphIndex
from lodestar.plans import catalog
from lodestar.sources import index_store

VECTORS, ASKS = "chunk_index long, embedding array<float>", "query_id long, embedding array<float>"


def pairs(hits):
    return {(r["query_id"], r["chunk_index"]) for r in hits.collect()}


def rows(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_index"], r["score"]) for r in hits.collect())


def share(index, asks, k=10):
    counts = index.scored(asks, k).agg(F.sum("scored").alias("scored"), F.sum("vectors").alias("vectors")).first()
    return counts["scored"] / counts["vectors"]


@pytest.fixture(scope="module")
def given(spark):
    frame = catalog.vectors(spark, "/root/testdata/sf0.1")
    asks = frame.where("chunk_index % 20 = 0").withColumnRenamed("chunk_index", "query_id")
    return frame, asks, pairs(dense.search(frame, asks, 10))


def test_recall_and_share_of_vectors_scored(given):
    frame, asks, exact = given
    index = GraphIndex.build(frame)
    assert len(pairs(index.search(asks, 10)) & exact) >= 0.9 * len(exact)
    assert share(index, asks) < 0.2


def test_queries_unlike_every_vector(spark, given):
    frame, asks, _ = given
    others = frame.join(asks.select(F.col("query_id").alias("chunk_index")), "chunk_index", "left_anti")
    exact = pairs(dense.search(others, asks, 10))
    assert len(pairs(GraphIndex.build(others, unlike=True).search(asks, 10)) & exact) >= 0.9 * len(exact)


def test_recall_after_appends_and_compaction(spark, given, tmp_path):
    frame, asks, exact = given
    folder = f"file://{tmp_path}/graphs"
    for part in range(4):
        index_store.write_tables(GraphIndex.build(frame.where(F.col("chunk_index") % 4 == part)).tables(), folder, append=True)
    index = graph_index.load(spark, folder)
    assert index.graphs.count() == 4
    assert len(pairs(index.search(asks, 10)) & exact) >= 0.9 * len(exact)
    one = index.compacted()
    assert one.graphs.count() == 1 and one.vectors().count() == frame.count()
    assert len(pairs(one.search(asks, 10)) & exact) >= 0.9 * len(exact)
    assert share(one, asks) < share(index, asks)


def test_every_node_can_be_reached():
    rng = np.random.default_rng(5)
    # clusters far from each other, so that near nodes alone leave parts unlinked
    units = graph_index._units(np.concatenate([rng.normal(0, 0.01, (80, 16)) + rng.normal(0, 1, 16) for _ in range(12)]))
    graph, entries = graph_index.graph_of(units, near=10, links=4)
    seen = np.zeros(len(units), bool)
    graph_index._reached(graph, entries, seen)
    assert seen.all()
    queries = units[::7].astype(np.float32)
    ids, scored = graph_index.walk(units.astype(np.float32), graph, entries, queries, 64)
    assert np.mean([int(np.argmax(units @ q)) in i for q, i in zip(queries, ids, strict=True)]) >= 0.9
    assert scored.mean() < len(units)
    assert graph_index.walk(units.astype(np.float32), graph, entries, queries[:3], len(units))[1].tolist() == [len(units)] * 3


def test_copies_ties_and_odd_vectors(spark):
    """A third of all rows share a vector; nulls, other lengths, zero vectors, repeated ids; exact with wide beams."""
    rng = np.random.default_rng(6)
    some = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(200)]
    many = [(1000 + i, some[3][1]) for i in range(100)]
    odd = [(5000, None), (5001, []), (5002, [None] * 6), (5003, [float("nan")] * 6), (5004, [1.0, 2.0]), (5005, [0.0] * 6), (7, some[8][1]), (7, some[8][1]), (None, some[1][1])]
    frame = spark.createDataFrame(some + many + odd, VECTORS).repartition(3)
    asks = spark.createDataFrame([*some[:20], (900, [0.0] * 6), (901, None), (902, [1.0, 1.0]), (903, [1.0])], ASKS)
    usable = frame.where("chunk_index IS NOT NULL AND size(embedding) = 6 AND NOT exists(embedding, x -> x IS NULL OR isnan(x))")
    exact = rows(dense.search(usable, asks.where("size(embedding) = 6"), 5))
    for shard_rows in (10_000, 60):
        index = GraphIndex.build(frame, shard_rows)
        found = rows(index.search(asks, 5, ef=10**6))
        assert [r for r in found if r[0] < 902] == exact
        assert [r[:3] for r in found if r[0] >= 902] == [(902, 1, 5004)]
        narrow = index.search(asks, 5)
        assert narrow.groupBy("query_id").count().where("count > 5").count() == 0
    assert len({r[2] for r in rows(narrow) if r[0] == 3}) == 5


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], VECTORS), spark.createDataFrame([(1, [1.0, 0.0])], VECTORS)
    asks = spark.createDataFrame([(1, [1.0, 1.0])], ASKS)
    assert rows(GraphIndex.build(none).search(asks)) == rows(GraphIndex.build(some).search(spark.createDataFrame([], ASKS))) == []
    assert rows(GraphIndex.build(some).search(asks)) == [(1, 1, 1, round(0.5**0.5, 6))]
    assert rows(GraphIndex.build(some).search(asks, 0)) == []
