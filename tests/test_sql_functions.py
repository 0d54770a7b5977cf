"""The library's functions called from SQL text against the DataFrame operators."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import sql, text
from lodestar.operators import chunking

TEXTS = [None, "", " \t", "One. Two? Three!", "a.b c", "no end", "Alike words here. Alike words here. Other things now! " * 3, "long " * 300 + ". Short one. " + "again " * 200]


@pytest.fixture
def docs(spark):
    sql.register(spark)
    sql.register(spark)  # a second registration replaces the first
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_scalars(spark, docs):
    mine = docs.select("doc_id", text.tokenize(F.col("text")), text.split_sentences(F.col("text")), text.words(F.col("text")), text.word_count(F.col("text")))
    found = spark.sql("SELECT doc_id, tokens(text), split_sentences(text), words(text), word_count(text) FROM {docs}", docs=docs)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, mine.collect()))


@pytest.mark.parametrize(("threshold", "tokens"), [(0.1, 128), (0.5, 4), (0.0, 1), (2.0, 64)])
def test_chunks(spark, docs, threshold, tokens):
    rows = spark.sql(f"SELECT doc_id, semantic_chunks(text, {threshold}D, {tokens}) AS cs FROM {{docs}}", docs=docs)
    found = [(d, i, c) for d, cs in rows.collect() for i, c in enumerate(cs)]
    assert sorted(found) == sorted(map(tuple, chunking.semantic_chunks(docs, threshold, tokens).collect()))
    by_rows = chunking.semantic_chunks(docs, threshold, tokens, embed=chunking.token_set)
    assert sorted(found) == sorted(map(tuple, by_rows.collect()))


def test_chunks_need_no_shuffle(spark, docs):
    rows = spark.sql("SELECT doc_id, semantic_chunks(text, 0.1D, 128) AS cs FROM {docs}", docs=docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_packer(spark, docs):
    """Ties by rank, a chunk that doesn't fit passed over, no room at all, partitions of their own."""
    rows = [(1, 10, 5, 10, 0.9, 1), (1, 11, 6, 10, 0.8, 2), (1, 12, 5, 10, 0.8, 3), (1, 13, 0, 10, 0.1, 4), (2, 14, 1, 0, 1.0, 1), (3, 15, 3, 3, 1.0, 1)]
    c = spark.createDataFrame(rows, "query_id long, chunk_index long, cost long, available long, score double, rank long")
    found = spark.sql("SELECT * FROM pack_budget(TABLE(SELECT * FROM {c}) PARTITION BY query_id ORDER BY (score DESC, rank))", c=c)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 1, 5), (1, 12, 3, 10), (1, 13, 4, 10), (3, 15, 1, 3)]
    assert spark.sql("SELECT * FROM pack_budget(TABLE(SELECT * FROM {c}) PARTITION BY query_id ORDER BY rank)", c=c.where("query_id > 9")).collect() == []
