import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import prompt, text, vector
from lodestar.operators.vector_index import VectorIndex
from lodestar.operators import block_max, budget, chunking, dense, evaluation, fusion, lexical, metrics, rerank
from lodestar.plans.pipeline import Retriever, answer_prompts
from lodestar.sources import corpora, registry
from lodestar.sources.schemas import QueryRequest


def hits(spark, *ids):
    return spark.createDataFrame([(0, c, 0.0, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_index long, score double, rank long")


def rows_of(df):
    return [(r["chunk_index"], r["score"]) for r in df.orderBy("rank").collect()]


# Fusion


def test_rrf_merge_and_ties(spark):
    fused = rows_of(fusion.rrf([hits(spark, 0, 1, 2), hits(spark, 1, 3)], 4))
    assert fused == [(1, 0.032522), (0, 0.016393), (3, 0.016129), (2, 0.015873)]
    tied = rows_of(fusion.rrf([hits(spark, 10, 11), hits(spark, 12, 11)], 3))
    assert tied == [(11, 0.032258), (10, 0.016393), (12, 0.016393)]


def test_rrf_repeats_limit_and_empty(spark):
    assert rows_of(fusion.rrf([hits(spark, 7, 7), hits(spark)], 5)) == [(7, 0.032522)]
    assert len(rows_of(fusion.rrf([hits(spark, *range(10)), hits(spark)], 3))) == 3
    assert rows_of(fusion.rrf([hits(spark), hits(spark)], 3)) == []
    assert rows_of(fusion.rrf([hits(spark, 1), hits(spark)], 0)) == []


def test_rrf_keeps_first_of_equal_texts(spark):
    texts = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other")], "chunk_index long, text string")
    assert [c for c, _ in rows_of(fusion.rrf([hits(spark, 2, 1, 3), hits(spark)], 5, texts=texts))] == [2, 3]


def test_visibility(spark):
    chunks = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "chunk_index long, tenant string")
    found = hits(spark, 2, 1, 0)

    def seen(tenant, **options):
        asks = spark.createDataFrame([(0, tenant)], "query_id long, tenant string")
        return [(r["chunk_index"], r["rank"]) for r in fusion.visible(found, asks, chunks, **options).orderBy("rank").collect()]

    assert seen("a") == [(1, 1), (0, 2)]
    assert seen(None) == [(2, 1), (1, 2), (0, 3)]
    assert seen("nobody") == []
    assert seen("nobody", legacy=True) == [(2, 1), (1, 2), (0, 3)]


# Vectors


def vectors(spark, rows, name="chunk_index"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_cosine_search_and_threshold(spark):
    base = vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0])])
    asks = vectors(spark, [(9, [3.0, 0.0])], "query_id")
    assert rows_of(dense.search(base, asks, 3)) == [(0, 1.0), (2, 1.0), (1, 0.0)]
    assert rows_of(dense.search(base, asks, 3, threshold=0.5)) == [(0, 1.0), (2, 1.0)]
    assert rows_of(dense.search(base, asks, 3, vector_rows=1, query_rows=1)) == [(0, 1.0), (2, 1.0), (1, 0.0)]
    assert rows_of(dense.search(base.limit(0), asks, 3)) == []
    assert dense.at_least(base, asks, 0.5).count() == 2


def test_vector_validation(spark):
    with pytest.raises(Exception, match="expected 2 components, found 1"):
        dense.validated(vectors(spark, [(0, [1.0])]), 2).collect()


def pairs(hits):
    return {(r["query_id"], r["chunk_index"]) for r in hits.collect()}


def test_vector_index_recall(spark, small):
    """On the given vectors, which have no clusters: recall holds, whatever share of them it takes."""
    base = spark.read.parquet(f"{small}/../sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_index"), "embedding")
    asks = base.where("chunk_index % 20 = 0").withColumnRenamed("chunk_index", "query_id")
    exact, near = pairs(dense.search(base, asks, 10)), pairs(VectorIndex.build(base).search(asks, 10))
    assert len(exact & near) >= 0.9 * len(exact)


def test_vector_index_scores_few_pairs(spark):
    """On clustered vectors at most a tenth of all pairs are scored, with recall of at least 0.9."""
    import numpy as np

    rng = np.random.default_rng(2)
    middle = rng.normal(size=(60, 32))
    rows = [(i, (middle[i % 60] + 0.4 * rng.normal(size=32)).tolist()) for i in range(3000)]
    base = spark.createDataFrame(rows, "chunk_index long, embedding array<float>")
    asks = base.where("chunk_index % 30 = 7").withColumnRenamed("chunk_index", "query_id")
    index = VectorIndex.build(base)
    exact, near = pairs(dense.search(base, asks, 10)), pairs(index.search(asks, 10))
    sizes = index.vectors.groupBy("list").count()
    scored = index.probed(asks).join(sizes, "list").agg(F.sum("count")).first()[0]
    assert len(exact & near) >= 0.9 * len(exact) and scored <= 0.1 * 3000 * asks.count()


def test_mean_pool_and_normalize(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1), (0, [3.0, 6.0], 1), (0, [100.0, 100.0], 0), (1, [5.0, 5.0], 0)], "g int, v array<double>, m int")
    pooled = {r["g"]: r["pooled"] for r in vector.mean_pool(rows, "g", "v", "m").collect()}
    assert pooled == {0: [2.0, 4.0], 1: [0.0, 0.0]}
    unit = rows.limit(1).select(vector.l2_normalize(F.col("v")).alias("u")).first()["u"]
    assert sum(x * x for x in unit) == pytest.approx(1)


# Second stage, packing, prompts


def test_rerank_and_model_scorer(spark):
    chunks = spark.createDataFrame([(0, "cats and dogs"), (1, "a cat"), (2, "dogs run")], "chunk_index long, text string")
    asks = spark.createDataFrame([(0, "dogs run")], "query_id long, text string")
    assert rows_of(rerank.rerank(hits(spark, 0, 1, 2), asks, chunks, 2)) == [(2, 1.0), (0, 0.5)]
    scorer = rerank.model_scorer(lambda: lambda queries, texts: [float(len(t)) for t in texts])
    assert rows_of(rerank.rerank(hits(spark, 0, 1, 2), asks, chunks, 2, scorer)) == [(0, 13.0), (2, 8.0)]


def pack(spark, costs, available):
    x = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).cast("long").alias("cost")) for i, c in enumerate(costs)])
    return [r["i"] for r in spark.range(1).select(budget.fold(x, F.lit(available).cast("long")).alias("k")).first()["k"]]


def test_fold_skips_and_goes_on(spark):
    assert pack(spark, [50, 60, 40], 100) == [0, 2]
    assert pack(spark, [50], 0) == []
    rng = random.Random(3)
    for _ in range(20):
        costs, available = [rng.randint(1, 40) for _ in range(8)], rng.randint(1, 120)
        used, kept = 0, []
        for i, c in enumerate(costs):
            if used + c <= available:
                used += c
                kept.append(i)
        assert pack(spark, costs, available) == kept


def test_pack_orders_by_score(spark):
    chunks = spark.createDataFrame([(0, "x" * 180), (1, "y" * 10)], "chunk_index long, text string")
    asks = spark.createDataFrame([(0, ""), (1, "nothing")], "query_id long, text string")
    found = spark.createDataFrame([(0, 0, 0.1, 2), (0, 1, 0.9, 1)], "query_id long, chunk_index long, score double, rank long")
    packed = budget.pack(found, asks, chunks, "", 200, 50, count=lambda c: F.char_length(c).cast("long"))
    kept = {r["query_id"]: r["kept"] for r in packed.collect()}
    assert [k["chunk_index"] for k in kept[0]] == [1]
    assert not kept[1]


def test_prompts(spark):
    def made(chunks, template):
        c = F.array(*map(F.lit, chunks)).cast("array<string>")
        return spark.range(1).select(prompt.build_prompt(F.lit("S"), F.lit("Q"), c, template).alias("p")).first()["p"]

    assert made([], "chatml") == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n"
    assert "user\nContext:\n[1] a\n[2] b\n\nQ<|im_end|>" in made(["a", "b"], "chatml")
    assert made([], "llama3").startswith("<|begin_of_text|><|start_header_id|>system<|eot_id|>\nS<|eot_id|>\n")
    with pytest.raises(ValueError, match="template"):
        made([], "other")


def test_pipeline_without_retriever(spark):
    asks = spark.createDataFrame([(0, "hello")], "query_id long, text string")
    row = answer_prompts(None, asks).first()
    assert row["n_used"] == 0 and "Context:" not in row["prompt"]


def test_request_defaults():
    request = QueryRequest("q")
    assert (request.top_k, request.threshold, request.max_tokens, request.user_id, request.use_reranker) == (5, 0.5, 512, None, False)
    with pytest.raises(TypeError):
        QueryRequest(None)


def test_retriever_modes(spark):
    chunks = spark.createDataFrame([(i, "ab"[i % 2], f"word{i} common") for i in range(6)], "chunk_index long, tenant string, text string")
    base = vectors(spark, [(i, [1.0, float(i)]) for i in range(6)])
    asks = spark.createDataFrame([(0, "common word3", [1.0, 3.0], "b")], "query_id long, text string, embedding array<float>, tenant string")
    for mode in ("post", "pre"):
        found = Retriever(chunks, base, tenancy=mode, recall_k=4).retrieve(asks, 3).collect()
        assert found and all(r["chunk_index"] % 2 for r in found)
        assert found[0]["chunk_index"] == 3
    with pytest.raises(ValueError):
        Retriever(chunks, base, tenancy="x").candidates(asks)


# Chunking


def split(words, limit):
    done, held, n = [], [], 0
    for s in words:
        k = len(s.split())
        if n + k > limit and held:
            done.append(" ".join(held))
            held, n = [], 0
        if k > limit:
            w = s.split()
            done += [" ".join(w[i : i + 64]) for i in range(0, len(w), 64)]
        else:
            held.append(s)
            n += k
    return done + ([" ".join(held)] if held else [])


def test_split_by_tokens_random(spark):
    rng = random.Random(5)
    cases = [[" ".join("w" for _ in range(rng.choice([1, 3, 8, 150]))) for _ in range(rng.randint(0, 9))] for _ in range(30)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, parts array<string>")
    found = df.select("i", chunking.split_by_tokens(F.col("parts"), 20).alias("c")).collect()
    assert all(r["c"] == split(cases[r["i"]], 20) for r in found)


def test_semantic_chunks(spark):
    docs = spark.createDataFrame([(0, "The cat sat. The cat ran! Stocks fell today. Stocks fell again."), (1, ""), (2, None)], "doc_id long, text string")
    found = [r["text"] for r in chunking.semantic_chunks(docs, 0.3).orderBy("doc_id", "pos").collect()]
    assert found == ["The cat sat. The cat ran!", "Stocks fell today. Stocks fell again."]


def test_sentences_and_preview(spark):
    df = spark.createDataFrame([("  One. Two!\n\nThree?  Four.five ",)], "t string")
    assert df.select(text.split_sentences(F.col("t")).alias("s")).first()["s"] == ["One.", "Two!", "Three?", "Four.five"]
    assert spark.range(1).select(text.preview(F.lit("x" * 121)).alias("p")).first()["p"] == "x" * 120 + "..."


def test_a_search_without_queries_sends_nothing_to_python(spark, monkeypatch):
    """Where each query has a tenant, the search for those without one built an index of all chunks and dealt out all vectors."""
    monkeypatch.setattr(block_max.BlockIndex, "build", lambda *_, **__: pytest.fail("an index for no queries"))
    chunks = spark.createDataFrame([(i, f"src{i % 2}", "apple pie") for i in range(40)], "chunk_index long, tenant string, text string")
    base = spark.range(40).select(F.col("id").alias("chunk_index"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    asks = spark.createDataFrame([(1, "apple", [1.0, 0.0], "src1")], "query_id long, text string, embedding array<double>, tenant string")
    found = Retriever(chunks, base, tenancy="pre").candidates(asks)
    assert {r["chunk_index"] % 2 for r in found.where("rank <= 5").collect()} == {1}
    none = dense.search(base, asks.where("tenant IS NULL"), 3)
    assert none.columns == ["query_id", "chunk_index", "score", "rank"] and none.count() == 0
    assert "Range" not in none._jdf.queryExecution().optimizedPlan().toString()
    words = lexical.search_texts(chunks, asks.where("tenant IS NULL"), 3)
    assert words.schema["query_id"].dataType == asks.schema["query_id"].dataType and words.columns == none.columns and words.count() == 0


# Evaluation, registry, corpora, telemetry


def test_metrics_of_one_ranking(spark):
    found = hits(spark, 0, 1, 2, 3, 4)
    rel = spark.createDataFrame([(0, 1, 1), (0, 3, 1), (0, 99, 1), (0, 0, 0)], "query_id long, chunk_index long, rel int")
    value = lambda df, c: df.first()[c]
    assert value(evaluation.recall(found, rel, 5), "recall") == pytest.approx(2 / 3)
    assert value(evaluation.reciprocal_rank(found, rel), "rr") == 0.5
    assert value(evaluation.ndcg(found, rel, 5), "ndcg") == pytest.approx(0.650921, abs=1e-6)
    assert value(evaluation.ndcg(found, rel, 5, ideal="judged"), "ndcg") == pytest.approx(0.498189, abs=1e-6)
    none = spark.createDataFrame([(0, 1, 0)], "query_id long, chunk_index long, rel int")
    assert value(evaluation.ndcg(found, none, 5), "ndcg") == value(evaluation.recall(found, none, 5), "recall") == 0.0


def test_best_strategy(spark):
    table = spark.createDataFrame([("dense", 0.5), ("hybrid", 0.6)], "strategy string, ndcg double")
    row = evaluation.best_strategy(table, "dense").first()
    assert (row["best"], row["improvement_percent"]) == ("hybrid", 20.0)


def test_registry(spark, tmp_path):
    rows = spark.createDataFrame([(0, "u1", "a"), (1, "u1", "b"), (2, "u2", "c"), (3, "u2", "d")], "chunk_index long, tenant string, text string")
    assert registry.stats(rows).first().asDict() == {"n_chunks": 4, "max_index": 3}
    assert registry.stats(rows.limit(0)).first()["max_index"] == -1
    assert [r[0] for r in registry.indices_of(rows, "u2").collect()] == [2, 3]
    assert registry.without_tenant(rows, "u1").count() == 2
    assert registry.active_tenants(rows).first()[0] == 2
    new = spark.createDataFrame([(5, 0, "u3", "e"), (4, 1, "u3", "f"), (4, 0, "u3", "g")], "doc_id long, pos int, tenant string, text string")
    grown = registry.append(rows, new, "doc_id", ["pos"]).where("tenant = 'u3'").orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["text"]) for r in grown] == [(4, "g"), (5, "f"), (6, "e")]
    many = spark.range(50).select((F.col("id") * 7 % 50).alias("doc_id"), F.lit(0).alias("pos"))
    ids = registry.numbered(many, "doc_id", ["pos"], 10, bucket_rows=7)
    assert all(r["chunk_index"] == r["doc_id"] + 10 for r in ids.collect())
    registry.write(rows, f"{tmp_path}/registry")
    plan = registry.by_tenant(spark.read.parquet(f"{tmp_path}/registry"), "u1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_bucket" in plan


def test_corpora(spark, tmp_path):
    made = corpora.synthetic(spark, 100).orderBy("chunk_index").collect()
    assert made[0]["text"] == "[0] renewable energy solar wind power: Overview and introduction to key concepts."
    assert made[17]["text"].startswith("[17] space exploration") and made[17]["text"].endswith("Historical development and timeline.")
    assert corpora.rare_keyword(spark).count() == 100
    for name, rows, schema in (
        ("corpus", [("d1", "T", "x"), ("d2", "", "y"), ("d3", "Z", "")], "_id string, title string, text string"),
        ("queries", [("10", "q ten"), ("2", "q two"), ("3", "")], "_id string, text string"),
        ("qrels/train", [("10", "d1", 1), ("2", "d2", 1), ("3", "d3", 1)], "`query-id` string, `corpus-id` string, score int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    corpus, asks, rel = corpora.beir(spark, str(tmp_path))
    assert {r["text"] for r in corpus.collect()} == {"T. x", "y", "Z"}
    assert [r["query_id"] for r in asks.collect()] == ["10", "2"]
    assert rel.count() == 3


def test_histogram(spark):
    rows = spark.createDataFrame([("a", 0.004), ("a", 0.3), ("a", 9.0), ("a", None)], "label string, v double")
    found = {r["le"]: r["n"] for r in metrics.histogram(rows, ["label"], "v").collect()}
    assert found["0.005"] == 1 and found["0.5"] == 2 and found["5.0"] == 2 and found["+Inf"] == 3
    lines = [r["line"] for r in metrics.exposition("x", rows, ["label"], "v", "help").orderBy("part").collect()]
    assert lines[:2] == ["# HELP x help", "# TYPE x histogram"] and lines[2].startswith('x_bucket{label="a",le="0.005"}') and any(x.startswith('x_count{label="a"} ') for x in lines)
    odd = spark.createDataFrame([('q"\\\n', 1.0)], "label string, v double")
    assert any(r["line"] == 'x_count{label="q\\"\\\\\\n"} 1' for r in metrics.exposition("x", odd, ["label"], "v", "help").collect())


def test_streaming_ingest(spark, tmp_path):
    from lodestar.operators import lexical
    from lodestar.streaming import ingest

    schema = "doc_id long, tenant string, text string"
    source, folder = f"{tmp_path}/in", f"{tmp_path}/out"
    for n, rows in enumerate(([(0, "a", "The cat sat."), (1, "b", "Stocks fell.")], [(2, "a", "The cat ran.")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.start(spark, source, schema, folder, f"{tmp_path}/checkpoint").awaitTermination()
        assert spark.read.parquet(f"{folder}/chunks").count() == 2 + n
    asks = spark.createDataFrame([(0, "cat")], "query_id long, text string")
    assert ingest.read_index(spark, folder).search(asks).count() == 2
    assert ingest.read_index(spark, folder).corpus_stats.first() == lexical.corpus_stats(spark.read.parquet(f"{folder}/doc_stats")).first()


def test_a_sentence_keeps_a_leading_and_a_trailing_v(spark):
    docs = spark.createDataFrame([(1, "Ein Wort. verüber.\x0bvon v\x0b")], "doc_id long, text string")
    assert [r["sentence"] for r in chunking.sentences(docs).orderBy("pos").collect()] == ["Ein Wort.", "verüber.", "von v"]


def test_slices_of_a_long_text_find_its_words_once(spark):
    import time

    def seconds(n):
        rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string").select(text.word_slices(F.col("text")).alias("s"))
        began = time.perf_counter()
        slices = rows.first()["s"]
        assert " ".join(slices) == " ".join(f"w{i}" for i in range(n))
        return time.perf_counter() - began

    seconds(1000)
    # four times the words are four times the work; found anew for each slice they were sixteen times
    assert seconds(160_000) < 10
