import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import dense, fusion, lexical
from lodestar.operators.models import hashed_embedding, model_embedder, model_generator
from lodestar.plans.pipeline import Retriever
from lodestar.sources import index_store, registry, store

SCHEMA = "doc_id long, tenant string, text string"
TIRE = "A flat tire comes off more easily once the lug nuts are loose."
PASTA = "Salt the water before the pasta goes in, for plain recipes too."
SOLAR = "On the roof, solar cells make electricity from sunlight all summer."
QUANTUM = "A quantum register holds many states until it is measured."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('store')}/corpus"
    assert store.restore(spark, folder) is None
    assert store.ingest(spark.createDataFrame([(0, "user_1", ""), (1, "user_1", None)], SCHEMA), folder) == 0
    assert store.restore(spark, folder) is None
    assert store.ingest(spark.createDataFrame([(0, "user_1", TIRE), (1, "user_1", PASTA)], SCHEMA), folder, hashed_embedding) == 2
    assert store.ingest(spark.createDataFrame([(0, "user_2", SOLAR), (1, "user_2", QUANTUM)], SCHEMA), folder, hashed_embedding) == 2
    return folder


def test_registry_after_ingest(spark, folder):
    chunks = store.restore(spark, folder).chunks
    assert registry.stats(chunks).first().asDict() == {"n_chunks": 4, "max_index": 3}
    assert [r[0] for r in registry.indices_of(chunks, "user_1").collect()] == [0, 1]
    assert [r["text"] for r in registry.by_tenant(chunks, "user_2").collect()] == [SOLAR, QUANTUM]
    assert registry.active_tenants(chunks).first()[0] == 2


def test_search_and_isolation(spark, folder):
    corpus = store.restore(spark, folder)
    asks = spark.createDataFrame([(0, "How to fix a flat tire?", "user_2"), (1, "flat tire", "user_1"), (2, "solar electricity", None)], "query_id long, text string, tenant string")
    asks = asks.withColumn("embedding", hashed_embedding(F.col("text")))
    hits = corpus.index.search(asks, 10)
    first = {r["query_id"]: r["chunk_index"] for r in hits.where("rank = 1").collect()}
    assert first == {0: 0, 1: 0, 2: 2}
    own = fusion.visible(hits, asks, corpus.chunks)
    assert {r["query_id"] for r in own.collect() if r["chunk_index"] == 0} == {1}
    found = Retriever(corpus.chunks, corpus.vectors, index=corpus.index).retrieve(asks, 1)
    assert {r["query_id"]: r["chunk_index"] for r in found.collect() if r["query_id"]} == {1: 0, 2: 2}
    assert dense.search(corpus.vectors, asks, 1).where("query_id = 2").first()["chunk_index"] == 2


def test_delete_and_ids_are_not_given_again(spark, folder):
    assert store.delete_tenant(spark, folder, "nobody") == 0
    assert store.delete_tenant(spark, folder, "user_2") == 2
    corpus = store.restore(spark, folder)
    assert corpus.chunks.count() == corpus.index.doc_stats.count() == corpus.vectors.count() == 2
    assert corpus.index.corpus_stats.first()["n"] == 2
    asks = spark.createDataFrame([(0, "solar quantum")], "query_id long, text string")
    assert corpus.index.search(asks).count() == 0
    assert store.ingest(spark.createDataFrame([(7, "user_3", SOLAR)], SCHEMA), folder, hashed_embedding) == 1
    assert [r[0] for r in registry.indices_of(store.restore(spark, folder).chunks, "user_3").collect()] == [4]
    assert index_store.current(spark, folder).next_index == 5


def test_the_newest_version_counts(spark, tmp_path, monkeypatch):
    """A marker that a dead writer has left doesn't hide what came after it, and two writers can't make one version."""
    folder = f"file://{tmp_path}/t"
    for i in range(11):
        assert index_store.write_tables({"x": spark.range(i, i + 1)}, folder) == i + 1
    for left in ("current-9", "current-12"):
        (tmp_path / "t" / left).touch()
    assert index_store.current(spark, folder).version == 11 and index_store.read_tables(spark, folder)["x"].first()["id"] == 10
    assert index_store.write_tables({"x": spark.range(20, 21)}, folder) == 13
    # another writer that looked before version 13 was there
    monkeypatch.setattr(index_store, "_versions", lambda *_: [12])
    monkeypatch.setattr(index_store, "current", lambda *_: index_store.Manifest(12, (), ()))
    with pytest.raises(RuntimeError):
        index_store.write_tables({"x": spark.range(1)}, folder)
    monkeypatch.undo()
    assert index_store.read_tables(spark, folder)["x"].first()["id"] == 20


def test_repeated_ids_in_a_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows = [(1, "a", PASTA), (1, "b", SOLAR), (1, "a", PASTA)]
    assert store.ingest(spark.createDataFrame(rows, SCHEMA), folder) == 3
    assert sorted((r["tenant"], r["text"]) for r in store.restore(spark, folder).chunks.collect()) == sorted(x[1:] for x in rows)


def test_vectors_are_searched_after_restore(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    for i, part in enumerate(([TIRE, PASTA], [SOLAR, QUANTUM])):
        store.ingest(spark.createDataFrame([(j, f"u{i}", t) for j, t in enumerate(part)], SCHEMA), folder, hashed_embedding)
    asks = spark.createDataFrame([(0, "solar sunlight electricity"), (1, "pasta recipes")], "query_id long, text string").withColumn("embedding", hashed_embedding(F.col("text")))
    corpus = store.restore(spark, folder)
    hits = [tuple(r) for r in corpus.vector_index.search(asks, 4, probes=9).collect()]
    # the stand-in has 64 buckets, so tokens may share one: what is nearest is what the exact search finds
    assert sorted(hits) == sorted(tuple(r) for r in dense.search(corpus.vectors, asks, 4).collect()) and len(hits) == 8
    assert next(chunk for query, chunk, _, rank in hits if (query, rank) == (0, 1)) == 2


def test_model_adapters(spark):
    df = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string")
    embed = model_embedder(lambda: lambda texts: np.array([[len(t), 3.0] for t in texts]), batch=2)
    rows = [r["v"] for r in df.select(embed(F.col("t")).alias("v")).collect()]
    assert rows[1] == [0.0, 1.0] and rows[2] == pytest.approx([0.8, 0.6])
    answer = model_generator(lambda: lambda prompts: [p.upper() for p in prompts], batch=2)
    assert [r["a"] for r in df.select(answer(F.col("t")).alias("a")).collect()] == ["AB", "", "ABCD"]


def test_ingest_leaves_nothing_but_the_store(spark, tmp_path):
    from urllib.parse import urlparse

    shared = urlparse(spark.conf.get("spark.checkpoint.dir")).path
    before = set(os.listdir(shared))
    docs = spark.createDataFrame([(1, "a", "A cat sat. It purred."), (2, "b", "A dog.")], "doc_id long, tenant string, text string")
    assert store.ingest(docs, f"file://{tmp_path}/corpus") > 0
    assert not {n for n in set(os.listdir(shared)) - before if n.split("-")[0] in ("documents", "unnumbered", "numbered", "chunks", "postings")}
    assert store.restore(spark, f"file://{tmp_path}/corpus").index.postings.count() > 0


def test_numbers_are_given_in_ranges_that_one_task_can_sort(spark):
    rows = registry.numbered(spark.range(120_000).select(F.col("id").alias("doc_id")), "doc_id", [], 0)
    assert len({f for f in rows.inputFiles() if "/numbered-" in f}) >= 3
    assert rows.where("chunk_index <> doc_id").count() == 0 and rows.count() == 120_000


def test_statistics_are_made_of_postings_that_were_counted_once(spark):
    index = lexical.LexicalIndex.build(spark.createDataFrame([(1, "a b a"), (2, "b")], "chunk_index long, text string"))
    for table in (index.term_stats, index.corpus_stats, index.postings):
        assert "regexp_extract_all" not in table._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["term"], r["df"]) for r in index.term_stats.collect()) == [("a", 1), ("b", 2)]


def test_a_batch_is_written_once_and_its_postings_are_not_shuffled_to_be_counted(spark, tmp_path, monkeypatch):
    """Of texts there are no copies but those of the numbering and the store; a term is counted in its chunk's row."""
    made = []
    for module in (store, registry):
        monkeypatch.setattr(module, "materialized", lambda df, purpose, f=module.materialized: made.append((purpose, df)) or f(df, purpose))
    folder = f"file://{tmp_path}/t"
    texts = ["A cat sat. The cat saw a cat!", "", "é ü.", "Dogs dig. Dogs run, a dog digs."]
    assert store.ingest(spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], SCHEMA), folder) == 4
    assert [purpose for purpose, _ in made] == ["unnumbered", "numbered", "postings"]
    assert "HashAggregate" not in made[2][1]._jdf.queryExecution().executedPlan().toString()
    tables = index_store.read_tables(spark, folder)
    assert sorted(tables) == ["chunks", "doc_stats", "postings"] and len(index_store.current(spark, folder).parts) == 1
    tokens = lexical.tokenized(tables["chunks"])
    assert tables["postings"].count() > 0
    assert sorted(map(tuple, tables["postings"].collect())) == sorted(map(tuple, lexical.index_postings(tokens).select("term", "chunk_index", "tf", "dl").collect()))
    assert sorted(map(tuple, tables["doc_stats"].collect())) == sorted(map(tuple, lexical.doc_stats(tokens).collect()))
