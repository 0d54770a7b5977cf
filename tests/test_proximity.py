"""Scores by proximity against a plain restatement."""

import random
import re

import pytest

from lodestar.operators import proximity

CHUNKS, ASKS, HITS = "chunk_index long, text string", "query_id long, text string", "query_id long, chunk_index long, rank long"


def plain(query, text, window):
    q, t = re.findall("[a-z0-9]+", query or ""), re.findall("[a-z0-9]+", text or "")
    if not q:
        return 0.0
    pairs = set(zip(q, q[1:], strict=False))
    ordered = sum(any(t[i : i + 2] == list(p) for i in range(len(t))) for p in pairs)
    near = sum(any(t[i] == a and t[j] == b and i != j and abs(i - j) < window for i in range(len(t)) for j in range(len(t))) for a, b in pairs)
    n = max(1, len(pairs))
    return round(0.8 * len(set(q) & set(t)) / len(set(q)) + 0.1 * ordered / n + 0.1 * near / n, 6)


@pytest.mark.parametrize("window", [2, 8])
def test_scores_as_restated(spark, window):
    """Repeated terms, null and empty texts, queries without tokens, a term twice in a row."""
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    chunks = [(i, text(rng.randint(0, 30))) for i in range(30)] + [(100, None), (101, ""), (102, "a a"), (103, "a")]
    queries = [(i, text(rng.randint(1, 6))) for i in range(8)] + [(50, None), (51, "?"), (52, "a a"), (53, "b")]
    index = proximity.positions(spark.createDataFrame(chunks, CHUNKS))
    hits = [(q, c, n + 1) for q, _ in queries for n, (c, _) in enumerate(chunks)]
    found = proximity.rerank(spark.createDataFrame(hits, HITS), spark.createDataFrame(queries, ASKS), index, 4, window).collect()
    expected = []
    for q, asked in queries:
        best = sorted(((-plain(asked, t, window), n + 1, c) for n, (c, t) in enumerate(chunks)))[:4]
        expected += [(q, c, -s, r + 1, n) for r, (s, n, c) in enumerate(best)]
    assert sorted((r["query_id"], r["chunk_index"], r["score"], r["rank"], r["stage1_pos"]) for r in found) == sorted(expected)


def test_nothing_to_rerank(spark):
    index = proximity.positions(spark.createDataFrame([(1, "a b")], CHUNKS))
    asks, none = spark.createDataFrame([(1, "a")], ASKS), spark.createDataFrame([], HITS)
    assert proximity.rerank(none, asks, index).collect() == []
    assert proximity.rerank(spark.createDataFrame([(1, 1, 1)], HITS), asks, proximity.positions(spark.createDataFrame([], CHUNKS))).first()["score"] == 0
