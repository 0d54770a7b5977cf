"""Text vectors against numpy's decomposition of the same matrix."""

import random

import numpy as np
import pytest

from lodestar.operators import dense, text_vectors
from lodestar.operators.text_vectors import TextVectors
from lodestar.plans import catalog
from lodestar.sources import index_store

CHUNKS = "chunk_index long, text string"
FEATURES = 512


def corpus(n=150):
    """Texts on five subjects, each with words of its own."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice([f"s{i % 5}w{rng.randint(0, 30)}", f"common{rng.randint(0, 20)}"]) for _ in range(rng.randint(5, 40)))) for i in range(n)]
    return [*rows, (900, None), (901, ""), (902, "!!")]


def matrix(spark, rows):
    """The rows of weights by a plain restatement, from the stored counts of features."""
    counts = {r["chunk_index"]: dict(zip(r["features"], r["counts"], strict=True)) for r in text_vectors.feature_counts(spark.createDataFrame(rows, CHUNKS), FEATURES).collect()}
    df = np.zeros(FEATURES)
    for c in counts.values():
        df[list(c)] += 1
    idf = np.log((1 + len(counts)) / (1 + df)) + 1
    out = np.zeros((len(counts), FEATURES))
    for i, key in enumerate(sorted(counts)):
        for f, n in counts[key].items():
            out[i, f] = (1 + np.log(n)) * idf[f]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None], sorted(counts)


@pytest.mark.parametrize("block", [text_vectors.BLOCK_WEIGHTS, 7])
def test_values_and_vectors_as_numpys(spark, monkeypatch, block):
    monkeypatch.setattr(text_vectors, "BLOCK_WEIGHTS", block)
    frame = spark.createDataFrame(corpus(), CHUNKS).repartition(3)
    model = TextVectors.fit(frame, dims=4, features=FEATURES, passes=8)
    rows, ids = matrix(spark, corpus())
    _, values, right = np.linalg.svd(rows, full_matrices=False)
    assert np.allclose(model.values, values[:4], rtol=1e-3)
    # the same subspace: both sets of directions are orthonormal
    assert np.linalg.norm(model.directions.T @ right[:4].T) ** 2 > 4 - 1e-2
    exact = rows @ right[:4].T
    exact /= np.maximum(np.linalg.norm(exact, axis=1), 1e-12)[:, None]
    found = {r["chunk_index"]: np.array(r["embedding"]) for r in model.embed(frame).collect()}
    mine = np.stack([found[i] for i in ids])
    assert np.allclose(mine @ mine.T, exact @ exact.T, atol=0.05)
    assert all(not found[i].any() for i in (900, 901, 902)) and len(found) == 153


def test_texts_of_a_subject_are_near(spark):
    frame = spark.createDataFrame(corpus(), CHUNKS)
    model = TextVectors.fit(frame, dims=8, features=FEATURES)
    asks = model.embed(spark.createDataFrame([(i, f"s{i}w1 s{i}w2 s{i}w3 s{i}w4") for i in range(5)], CHUNKS)).withColumnRenamed("chunk_index", "query_id")
    hits = dense.search(model.embed(frame), asks, 10).collect()
    assert np.mean([r["chunk_index"] % 5 == r["query_id"] for r in hits]) > 0.9


def test_stored_and_loaded(spark, tmp_path):
    frame = spark.createDataFrame(corpus(40), CHUNKS)
    model = TextVectors.fit(frame, dims=4, features=FEATURES)
    index_store.write_tables(model.tables(spark), f"file://{tmp_path}/m")
    again = text_vectors.load(spark, f"file://{tmp_path}/m")
    assert (again.idf == model.idf).all() and (again.directions == model.directions).all() and (again.values == model.values).all()


def test_no_texts(spark):
    none = spark.createDataFrame([], CHUNKS)
    model = TextVectors.fit(none, dims=4, features=FEATURES)
    assert model.embed(none).collect() == [] and model.directions.shape == (FEATURES, 4)
    assert len(model.embed(spark.createDataFrame([(1, "a b"), (None, "c")], CHUNKS)).collect()) == 1


def test_hybrid_on_text_vectors_finds_the_passages(spark):
    """Questions are passages that some documents hold: those documents come first."""
    small = "/root/testdata/sf0.001"
    hits = catalog.queries()["text_hybrid_topk"](spark, small).join(catalog.chunks(spark, small), "chunk_index").join(catalog.table(spark, small, "benchmark").withColumnRenamed("text", "asked"), catalog.F.col("item_id") == catalog.F.col("query_id")).collect()
    assert {r["rank"] for r in hits if r["asked"] in r["text"]} <= {1, 2, 3}
    assert any(r["asked"] in r["text"] for r in hits)
