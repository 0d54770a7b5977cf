"""Search of stored postings, scored in the tasks that hold the chunks."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import lexical, posting_search
from lodestar.sources import index_store

WORDS = ("dog", "park", "sun", "tire", "pasta", "fox", "rain")


@pytest.fixture(scope="module")
def rows(spark):
    """Texts of mixed words with copies, so that scores tie within tasks and between them."""
    made = [(i, " ".join(WORDS[(i * j) % 7] for j in range(1, 2 + i % 5))) for i in range(120)] + [(i, "dog park sun") for i in range(120, 160)] + [(200, "other"), (201, "")]
    return spark.createDataFrame(made, "chunk_index long, text string")


@pytest.fixture(scope="module")
def asks(spark):
    return spark.createDataFrame([(0, "dog park"), (1, "sun sun fox"), (2, "rain tire nothing"), (3, "nothing"), (4, ""), (5, None)], "query_id long, text string")


def _hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "chunk_index", "score").collect())


def _paired(index, asks, k):
    """The ranks by a table of all pairs of queries and chunks."""
    terms = lexical.query_terms(asks)
    known = index.postings.join(index.term_stats, "term").crossJoin(index.corpus_stats).join(terms, "term")
    return _hits(lexical.ranked(lexical._scores(known, lexical.K1, lexical.B, lexical.DELTA), k))


def test_same_as_all_pairs(spark, rows, asks, monkeypatch):
    index = lexical.LexicalIndex.build(rows)
    for k in (1, 7, 1000):
        assert _hits(index.search(asks, k)) == _paired(index, asks, k) != []
    monkeypatch.setattr(posting_search, "TASK_POSTINGS", 20)  # many tasks
    monkeypatch.setattr(posting_search, "QUERY_TERMS", 2)  # several groups of queries
    assert _hits(index.search(asks, 7)) == _paired(index, asks, 7)
    monkeypatch.setattr(lexical, "FILTER_TERMS", 1)  # terms are joined, not filtered
    assert _hits(index.search(asks, 7)) == _paired(index, asks, 7)
    assert index.search(asks, 0).count() == 0 and index.search(asks.limit(0), 7).count() == 0 and index.search(asks.where("query_id > 2"), 7).count() == 0


def test_no_row_for_a_pair_of_query_and_chunk(spark, rows):
    many = spark.range(60).select(F.col("id").alias("query_id"), F.lit("dog park sun").alias("text"))
    index = lexical.LexicalIndex.build(rows)
    plan = index.search(many, 2)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[query_id" not in plan
    # what the tasks give are k rows for each query: of tied chunks those of the larger ids
    assert {(r["query_id"], r["chunk_index"]) for r in index.search(many, 2).collect()} == {(q, c) for q in range(60) for c in (158, 159)}


def test_deleted_chunks_are_no_hits(spark, rows, asks, tmp_path):
    folder = f"file://{tmp_path}/t"
    index_store.write_tables({n: t for n, t in lexical.LexicalIndex.build(rows).tables().items() if n in ("postings", "doc_stats")}, folder)
    index_store.delete_rows(rows.where("chunk_index % 3 = 0").select("chunk_index"), folder)
    tables = index_store.read_tables(spark, folder)
    corpus = lexical.corpus_stats(tables["doc_stats"])
    left = lexical.LexicalIndex(tables["postings"], tables["doc_stats"], lexical.term_stats(tables["postings"], corpus), corpus)
    assert _hits(left.search(asks, 9)) == _hits(lexical.LexicalIndex.build(rows.where("chunk_index % 3 <> 0")).search(asks, 9)) == _paired(left, asks, 9)
