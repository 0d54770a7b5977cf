import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.operators import lexical
from lodestar.sources import index_store


def chunks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_index long, text string")


def asks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def found(hits):
    return [(r["chunk_index"], r["score"]) for r in hits.orderBy("query_id", "rank").collect()]


DOGS = ("the quick brown fox", "a dog in the park on a sunny day", "nothing here", "dog park")


def test_idf_closed_form(spark):
    index = lexical.LexicalIndex.build(chunks(spark, "hello world", "hello foo", "hello bar"))
    idf = {r["term"]: r["idf"] for r in index.term_stats.collect()}
    assert idf["world"] == pytest.approx(0.980829253, rel=1e-8)
    assert idf["hello"] == pytest.approx(0.133531393, rel=1e-8)


def test_frequency_effect(spark):
    hits = found(lexical.search_texts(chunks(spark, "cat cat cat dog", "cat dog"), asks(spark, "cat")))
    assert [h[0] for h in hits] == [0, 1]
    assert hits[0][1] == pytest.approx(0.462816, rel=1e-5)
    assert hits[1][1] == pytest.approx(0.396818, rel=1e-5)


def test_tenanted_scores(spark):
    # fixed values: the scores below are those of these texts
    texts = (
        "Replacing a punctured rubber wheel with a spare is a straightforward process. First, locate the jack and spare tire in your vehicle. Then, loosen the lug nuts before lifting the car.",
        "The best pasta recipes use fresh ingredients and slow-simmered sauces.",
        "Solar panels convert sunlight into electricity through photovoltaic cells.",
        "Quantum computing leverages superposition and entanglement for computation.",
    )
    index = lexical.LexicalIndex.build(chunks(spark, *texts))
    assert index.corpus_stats.first()["avg_dl"] == 14.75
    hits = index.search(asks(spark, "How to fix a flat tire?", "solar energy benefits"))
    assert [(r["query_id"], r["chunk_index"], r["score"]) for r in hits.orderBy("query_id").collect()] == [
        (0, 0, pytest.approx(4.786166, rel=1e-5)),
        (1, 2, pytest.approx(2.664084, rel=1e-5)),
    ]


def test_no_match_empty_query_and_k(spark):
    rows = chunks(spark, *DOGS)
    assert found(lexical.search_texts(rows, asks(spark, "xxx yyy", "", None))) == []
    assert len(found(lexical.search_texts(rows, asks(spark, "dog park"), k=1))) == 1
    assert found(lexical.search_texts(rows.limit(0), asks(spark, "dog"))) == []


def test_repeated_terms_count_each_time(spark):
    rows = chunks(spark, *DOGS)
    once, twice = (found(lexical.search_texts(rows, asks(spark, q))) for q in ("dog", "dog dog"))
    assert [(i, pytest.approx(2 * s, abs=2e-6)) for i, s in once] == twice


def test_index_and_texts_agree_and_round_trip(spark, tmp_path):
    rows, questions = chunks(spark, *DOGS), asks(spark, "dog park", "the fox")
    built = lexical.LexicalIndex.build(rows)
    folder = f"file://{tmp_path}/index"
    with pytest.raises(lexical.NotIndexedError, match="not indexed"):
        lexical.load_index(spark, folder)
    index_store.write_tables(built.tables(), folder)
    index_store.write_tables(built.tables(), folder)  # a second version replaces the first
    loaded = lexical.load_index(spark, folder)
    assert found(loaded.search(questions)) == found(built.search(questions)) == found(lexical.search_texts(rows, questions))


def test_tokenizer_edges(spark):
    text = "café foo_bar x-1 naïve Δx 3.14 éx ²x İa K9"
    row = spark.createDataFrame([(text,), (None,)], "text string").select(tokenize(F.col("text")).alias("t")).collect()
    assert row[0]["t"] == "x 1 3 14 e x i a k9".split()
    assert row[1]["t"] == []


def test_against_plain_python(spark, small):
    import re
    from collections import Counter

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    split = lambda t: [w for w in re.findall(r"\w+", t.lower()) if re.fullmatch("[a-z0-9]+", w)]
    freqs = {d["doc_id"]: Counter(split(d["text"])) for d in docs}
    n = len(freqs)
    avg = sum(sum(c.values()) for c in freqs.values()) / n
    df = Counter(t for c in freqs.values() for t in c)
    hits = lexical.search_texts(
        spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("doc_id", "chunk_index"), spark.read.parquet(f"{small}/benchmark.parquet").withColumnRenamed("item_id", "query_id"), 5
    )
    mine = {}
    for r in hits.orderBy("rank").collect():
        mine.setdefault(r["query_id"], []).append((r["chunk_index"], r["score"]))
    for item in items:
        scores = {}
        for t in split(item["text"]):
            idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
            for d, c in freqs.items():
                if c[t]:
                    dl = sum(c.values())
                    scores[d] = scores.get(d, 0) + idf * (c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / avg)) + 1)
        best = sorted(((round(s, 6), d) for d, s in scores.items()), reverse=True)[:5]
        assert [(d, pytest.approx(s, abs=2e-6)) for s, d in best] == mine[item["item_id"]]
