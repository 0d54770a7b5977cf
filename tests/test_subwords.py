"""Counts of subwords against the library, and a budget that uses them against a plain restatement."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import subwords
from lodestar.operators import budget

P = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", "  ", "one two three", "naïve Ünïcode 你好 🙂", "<|endoftext|> as text", "word " * 20_000, "one two three"]


@pytest.fixture(scope="module")
def path():
    return P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def size(path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda t: len(library.encode(t or "", add_special_tokens=False).ids)


def test_counts_as_the_library(spark, path, size):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")
    found = dict(rows.select("i", subwords.subword_count(path)(F.col("text"))).collect())
    assert found == {i: size(t) for i, t in enumerate(TEXTS)}


def test_calls_are_cut_anywhere_alike(path, monkeypatch):
    texts = ["a b c"] * 7 + ["", "x"]
    whole = subwords.lengths(path, texts).tolist()
    monkeypatch.setattr(subwords, "CALL_CHARS", 8)
    assert subwords.lengths(path, texts).tolist() == whole
    assert subwords.lengths(path, []).tolist() == []


def test_budget_in_subwords(spark, path, size):
    chunks = [(i, f"piece {i} " + "strawberry " * (7 * i % 23)) for i in range(40)] + [(40, None)]
    hits = [(1, i, 1.0 / (1 + i % 5), n + 1) for n, (i, _) in enumerate(chunks)]
    args = spark.createDataFrame(hits, "query_id long, chunk_index long, score double, rank long"), spark.createDataFrame([(1, "which berry?"), (2, "none")], "query_id long, text string")
    found = budget.pack(*args, spark.createDataFrame(chunks, "chunk_index long, text string"), "a system text", 200, 20, count=subwords.subword_count(path))
    rows = {r["query_id"]: r for r in found.collect()}
    room, used, kept = 180 - size("a system text") - size("which berry?"), 0, []
    for _, i, _, _ in sorted(hits, key=lambda h: (-h[2], h[3])):
        cost = size(chunks[i][1])
        if used + cost <= room:
            used, kept = used + cost, [*kept, i]
    assert rows[1]["available"] == room and [x["chunk_index"] for x in rows[1]["kept"]] == kept and 0 < len(kept) < len(chunks)
    assert rows[2]["n_candidates"] == 0
