"""Block-max search against the plain index: the same rows, with fewer postings read."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import block_max, lexical
from lodestar.sources import index_store

CHUNKS, ASKS = "chunk_index long, text string", "query_id long, text string"


def made(n, seed, words=60):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(pool, weights, k=rng.randint(0, 40)))) for i in range(n)]


def asks(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["w0", "w3", "w9", "w20", "w41", "w59", "unknown"]) for _ in range(rng.randint(0, 6)))) for i in range(n)]


def rows(hits):
    return sorted((r["query_id"], r["rank"], r["chunk_index"], r["score"]) for r in hits.collect())


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("shard_chunks", [1000, 11])
def test_same_rows_as_the_plain_index(spark, k, shard_chunks):
    """Ties of copies, empty texts, repeated query terms; one shard, and many that are searched in two turns."""
    chunks = made(300, 1) + [(1000 + i, "w3 w9 w9") for i in range(40)] + [(2000, None), (2001, "")]
    frame, queries = spark.createDataFrame(chunks, CHUNKS).repartition(2), spark.createDataFrame(asks(25, 2), ASKS)
    index = block_max.BlockIndex.build(frame, shard_chunks=shard_chunks, window=4)
    expected = rows(lexical.LexicalIndex.build(frame).search(queries, k))
    assert expected and rows(index.search(queries, k, window=4)) == expected
    other = dict(k1=0.9, b=0.3, delta=0.2)
    assert rows(index.search(queries, k, window=4, **other)) == rows(lexical.LexicalIndex.build(frame).search(queries, k, **other))


def test_shards_are_bounded(spark):
    frame = spark.createDataFrame(made(100, 3) + [(500, "w1 " * 5000)], CHUNKS).coalesce(1)
    sizes = block_max.BlockIndex.build(frame, shard_chunks=30, shard_tokens=400).shards.collect()
    assert sum(r["n"] for r in sizes) == 101
    assert all(r["n"] <= 30 and (r["tokens"] <= 400 or r["n"] == 1) for r in sizes)


def test_postings_are_left_packed(spark):
    frame = spark.createDataFrame(made(4000, 4, words=400), CHUNKS).coalesce(1)
    queries = spark.createDataFrame([(0, "w50 w300"), (1, "w0 w200"), (2, "nothing")], ASKS)
    index = block_max.BlockIndex.build(frame)
    counts = {r["query_id"]: r for r in index.opened(queries, 5).collect()}
    assert all(counts[q]["postings_read"] < 0.5 * counts[q]["postings"] for q in (0, 1))
    held = {r["term"]: r["n"] for r in index.blocks.groupBy("term").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert counts[0]["postings"] == held["w50"] + held["w300"]
    assert rows(index.search(queries, 5)) == rows(lexical.LexicalIndex.build(frame).search(queries, 5))


def test_groups_of_queries(spark, monkeypatch):
    frame, queries = spark.createDataFrame(made(80, 5), CHUNKS), spark.createDataFrame(asks(30, 6), ASKS)
    expected = rows(block_max.search_texts(frame, queries, 4))
    monkeypatch.setattr(block_max, "QUERY_TERMS", 20)
    assert rows(block_max.search_texts(frame, queries, 4)) == expected == rows(lexical.LexicalIndex.build(frame).search(queries, 4))


def test_stored_blocks_read_their_terms_folders(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    with pytest.raises(lexical.NotIndexedError):
        block_max.load(spark, folder)
    chunks = made(120, 7)
    for part in (chunks[:50], chunks[50:]):
        index_store.write_tables(block_max.BlockIndex.build(spark.createDataFrame(part, CHUNKS)).tables(), folder, append=True)
    index, queries = block_max.load(spark, folder), spark.createDataFrame(asks(9, 8), ASKS)
    assert rows(index.search(queries, 5)) == rows(lexical.LexicalIndex.build(spark.createDataFrame(chunks, CHUNKS)).search(queries, 5))
    plan = index._of(["w9"])._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_nothing_to_find(spark):
    none, some = spark.createDataFrame([], CHUNKS), spark.createDataFrame([(1, "w1")], CHUNKS)
    query, silent = spark.createDataFrame([(1, "w1 w2")], ASKS), spark.createDataFrame([(1, None), (2, "!")], ASKS)
    assert rows(block_max.search_texts(none, query)) == rows(block_max.search_texts(some, silent)) == rows(block_max.search_texts(some, query, 0)) == []
    assert rows(block_max.search_texts(some, spark.createDataFrame([], ASKS))) == []
    assert len(rows(block_max.search_texts(some, query))) == 1


def test_only_the_asked_terms_are_sent_to_python(spark, monkeypatch):
    def counting(run, wanted, window, shard_chunks, shard_tokens):
        def build(batches):
            for batch in batches:
                n = len(batch.column(2).flatten())
                names = [f.split() for f in block_max._BUILT.split(", ")]
                kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
                row = {"term": "x", "n": n, "tokens": sum(batch.column(1).to_pylist())}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(name)], kinds[kind]) for name, kind in names], [name for name, _ in names])

        return build

    monkeypatch.setattr(block_max, "_built", counting)
    chunks = spark.createDataFrame([(1, "red fox and red dog"), (2, "a blue whale"), (3, None)], "chunk_index long, text string").coalesce(1)
    assert block_max.BlockIndex.build(chunks, ["red", "whale", "it's"]).blocks.agg(F.sum("n")).first()[0] == 3
    assert block_max.BlockIndex.build(chunks, ["it's"]).blocks.agg(F.sum("n")).first()[0] == 0
    assert block_max.BlockIndex.build(chunks).blocks.agg(F.sum("n")).first()[0] == 8
