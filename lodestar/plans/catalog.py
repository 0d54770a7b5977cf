"""The registered retrieval queries, each with DuckDB SQL that says the same.

Conventions on the given tables: ``documents`` are chunks (doc_id is the chunk, source the tenant),
``benchmark`` are queries, a query's vector is the embedding whose vec_id is its item_id, and a chunk's vector
the one whose vec_id is its doc_id. Text and vectors are unrelated, so hybrid results check plumbing.
``labels.quality`` stands for relevance grades in the evaluation queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import prompt, sql, subwords, text, vector
from lodestar.operators import block_max, budget, chunking, dense, evaluation, fusion, graph_index, lexical, metrics, proximity, rerank, telemetry, text_vectors
from lodestar.operators.vector_index import VectorIndex
from lodestar.plans.pipeline import Retriever, answer_prompts
from lodestar.plans.session import materialized, scratch
from lodestar.sources import corpora, index_store, registry, store

Query = Callable[[SparkSession, str], DataFrame]

K, RECALL_K, EVAL_K = 10, 50, 10
DIM = 64
COSINE_THRESHOLD = 0.3
CHUNK_THRESHOLD, CHUNK_TOKENS = 0.1, 128
WINDOW, GENERATION = 1024, 128
TENANT = "src3"
N_TENANTS = 20
KEYWORDS = ("tion", "ung", "ción", "eau")
CREATED = "2026-01-01 00:00:00"

_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# Tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_index"), F.col("source").alias("tenant"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_index"), "embedding")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, embedding, tenant)"""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    own = vectors(spark, sf_dir).withColumnRenamed("chunk_index", "query_id")
    tenant = F.concat(F.lit("src"), (F.col("query_id") % N_TENANTS).cast("string"))
    return rows.join(own, "query_id", "left").withColumn("tenant", tenant)


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("created_at", F.lit(CREATED).cast("timestamp_ntz"))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by label: a labelled chunk of the query's tenant is relevant if its quality is 1."""
    owned = chunks(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "chunk_index"), "chunk_index")
    rel = owned.select("chunk_index", F.col("tenant"), F.col("quality").alias("rel"))
    return asked(spark, sf_dir).select("query_id", "tenant").join(rel, "tenant").select("query_id", "chunk_index", "rel")


# SQL that several queries share

_WORDS = r"regexp_extract_all({0}, '\S+')"


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+'))"


def _n_words(column: str) -> str:
    return f"len({_WORDS.format(column)})"


_SENTENCES = r"""
sent AS (
  SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, ''), E' \t\n\r\f\v'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda s: trim(s, E' \t\n\r\f\v')), lambda s: s <> '') AS ss
    FROM documents
  )
)"""


def _index(source: str, key: str) -> str:
    return f"""
tok AS (SELECT {key} AS ci, {_tokens('text')} AS ts FROM {source}),
dl AS (SELECT ci, len(ts)::DOUBLE AS dl FROM tok),
cs AS (SELECT count(*)::BIGINT AS n, coalesce(avg(dl), 1.0) AS avg_dl FROM dl),
post AS (SELECT ci, term, count(*)::BIGINT AS tf FROM (SELECT ci, unnest(ts) AS term FROM tok) GROUP BY ci, term),
ts AS (SELECT term, count(*)::BIGINT AS df, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM post, cs GROUP BY term),
qs AS (SELECT item_id AS q, text, 'src' || (item_id % {N_TENANTS})::VARCHAR AS tenant FROM benchmark),
qt AS (SELECT q, term, count(*)::DOUBLE AS qtf FROM (SELECT q, unnest({_tokens('text')}) AS term FROM qs) GROUP BY q, term)"""


_INDEX = _index("documents", "doc_id")


def _bm25(k: int, k1: float = lexical.K1, b: float = lexical.B, delta: float = lexical.DELTA, name: str = "bm") -> str:
    return f"""
{name}_s AS (
  SELECT q, ci, round(sum(qtf * (idf * (tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avg_dl)) + {delta}::DOUBLE))), 6) AS score
  FROM qt JOIN post USING (term) JOIN ts USING (term) JOIN dl USING (ci), cs GROUP BY q, ci
),
{name} AS (SELECT q, ci, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, ci DESC) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_COSINE = """
cos AS (
  SELECT a.vec_id AS q, b.vec_id AS ci,
    round(list_inner_product(a.e, b.e) / (greatest(sqrt(list_inner_product(a.e, a.e)), 1e-9) * greatest(sqrt(list_inner_product(b.e, b.e)), 1e-9)), 6) AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) a,
    (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b
)"""


def _dense(k: int, name: str = "de") -> str:
    return f"{name} AS (SELECT q, ci, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, ci) AS rank FROM cos QUALIFY rank <= {k})"


def _own(source: str, name: str) -> str:
    """The rows of a hit list on the query's own tenant, ranked anew."""
    return f"""{name} AS (
  SELECT h.q, h.ci, h.score, row_number() OVER (PARTITION BY h.q ORDER BY h.rank) AS rank
  FROM {source} h JOIN qs ON qs.q = h.q JOIN documents d ON d.doc_id = h.ci AND d.source = qs.tenant
)"""


def _rrf(first: str, second: str, k: int, dedup: bool, name: str = "fu") -> str:
    """Fuses two lists; ``dedup`` keeps the first chunk of each text."""
    order = "raw DESC, r0 NULLS LAST, r1 NULLS LAST, ci"
    keep = f"SELECT u.* FROM {name}_u u JOIN documents d ON d.doc_id = u.ci QUALIFY row_number() OVER (PARTITION BY q, d.text ORDER BY {order}) = 1" if dedup else f"SELECT * FROM {name}_u"
    return f"""
{name}_u AS (
  SELECT q, ci, round(sum(1.0::DOUBLE / ({fusion.RRF_K} + rank)), 12) AS raw, min(rank) FILTER (l = 0) AS r0, min(rank) FILTER (l = 1) AS r1
  FROM (SELECT q, ci, rank, 0 AS l FROM {first} UNION ALL SELECT q, ci, rank, 1 AS l FROM {second}) GROUP BY q, ci
),
{name} AS (SELECT q, ci, round(raw, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY {order}) AS rank FROM ({keep}) QUALIFY rank <= {k})"""


def _reranked(source: str, k: int, name: str = "re") -> str:
    return f"""
{name}_s AS (
  SELECT h.q, h.ci, h.rank AS stage1_pos, round(coalesce(len(list_intersect(a, {_tokens('d.text')}))::DOUBLE / nullif(len(a), 0), 0), 6) AS score
  FROM {source} h JOIN (SELECT q, list_distinct({_tokens('text')}) AS a FROM qs) t ON t.q = h.q JOIN documents d ON d.doc_id = h.ci
),
{name} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, stage1_pos) AS rank FROM {name}_s QUALIFY rank <= {k})"""


_HIT = "q AS query_id, ci AS chunk_index, score, rank::BIGINT AS rank"
_HYBRID = f"WITH RECURSIVE {_INDEX}, {_bm25(RECALL_K)}, {_COSINE}, {_dense(RECALL_K)}"
_STAGE1 = f"{_HYBRID}, {_own('bm', 'bm_own')}, {_own('de', 'de_own')}, {_rrf('bm_own', 'de_own', RECALL_K, True)}"


# Text


@_query(f"SELECT doc_id, len(ts)::BIGINT AS n_tokens, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS ts FROM documents)")
def tokenize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.array_join("ts", " ").alias("tokens"))


@_query(f"WITH {_SENTENCES} SELECT doc_id, pos::BIGINT AS pos, sentence FROM sent")
def split_sentences(spark, sf_dir):
    return chunking.sentences(table(spark, sf_dir, "documents"))


@_query(f"SELECT doc_id, {_n_words('text')}::BIGINT AS n_words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@_query(
    f"WITH w AS (SELECT doc_id, {_WORDS.format('text')} AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(range(0, len(ws), {text.SLICE_WORDS})) AS i FROM w) "
    f"SELECT doc_id, (i // {text.SLICE_WORDS})::BIGINT AS pos, array_to_string(ws[i + 1 : i + {text.SLICE_WORDS}], ' ') AS piece FROM i"
)
def split_long_sentence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.word_slices(F.col("text"))).alias("pos", "piece"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@_query(f"SELECT doc_id, CASE WHEN length(text) > {text.PREVIEW_CHARS} THEN substr(text, 1, {text.PREVIEW_CHARS}) || '...' ELSE text END AS preview FROM documents")
def preview_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


# Index


@_query(f"WITH {_INDEX} SELECT ci AS chunk_index, dl::BIGINT AS dl FROM dl")
def doc_length(spark, sf_dir):
    return lexical.doc_stats(lexical.tokenized(chunks(spark, sf_dir)))


@_query(f"WITH {_INDEX} SELECT term, ci AS chunk_index, tf FROM post")
def postings_tf(spark, sf_dir):
    return lexical.postings(lexical.tokenized(chunks(spark, sf_dir)))


@_query(f"WITH {_INDEX} SELECT term, df, round(idf, 9) AS idf FROM ts")
def term_df_idf(spark, sf_dir):
    return lexical.LexicalIndex.build(chunks(spark, sf_dir)).term_stats.withColumn("idf", F.round("idf", 9))


@_query(f"WITH {_INDEX} SELECT DISTINCT term FROM post")
def vocabulary(spark, sf_dir):
    return lexical.tokenized(chunks(spark, sf_dir)).select(F.explode("tokens").alias("term")).distinct()


@_query(f"WITH {_INDEX} SELECT n, avg_dl FROM cs")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(lexical.doc_stats(lexical.tokenized(chunks(spark, sf_dir))))


@_query(f"WITH {_INDEX}, {_bm25(K)} SELECT {_HIT} FROM bm")
def index_roundtrip(spark, sf_dir):
    """Builds the index, writes it, reads it back and searches it."""
    folder = scratch(spark, "index")
    index_store.write_tables(lexical.LexicalIndex.build(chunks(spark, sf_dir)).tables(), folder)
    return lexical.load_index(spark, folder).search(asked(spark, sf_dir), K)


# Lexical


@_query(f"WITH {_INDEX}, {_bm25(K)} SELECT {_HIT} FROM bm")
def bm25_topk(spark, sf_dir):
    return lexical.search_texts(chunks(spark, sf_dir), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), K)


@_query(f"WITH {_INDEX}, {_bm25(K)} SELECT {_HIT} FROM bm")
def block_index_append(spark, sf_dir):
    """An index of blocks of half the chunks, stored, the other half appended to it, opened again and searched."""
    folder, rows = scratch(spark, "blocks"), chunks(spark, sf_dir)
    for half in (0, 1):
        index = block_max.BlockIndex.build(rows.where(F.col("chunk_index") % 2 == half))
        index_store.write_tables(index.tables(), folder, append=True)
    return block_max.load(spark, folder).search(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), K)


@_query(f"WITH {_INDEX}, {_bm25(K, 1.2, 0.5, 0.5)} SELECT {_HIT} FROM bm")
def bm25_params(spark, sf_dir):
    return lexical.search_texts(chunks(spark, sf_dir), asked(spark, sf_dir), K, k1=1.2, b=0.5, delta=0.5)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_RARE = " UNION ALL ".join(
    [f"SELECT i AS doc_id, {_sql_text(corpora.FILLER[0])} || i || {_sql_text(corpora.FILLER[1])} AS text FROM range(95) r(i)"]
    + [f"SELECT {95 + i} AS doc_id, {_sql_text(t)} AS text" for i, t in enumerate(corpora.RARE_TEXTS)]
)


def _among(planted: str) -> str:
    """CTEs that make ``documents`` the given ones and the planted texts (doc_id, text), numbered behind them."""
    return f"given AS (SELECT doc_id, text FROM documents), documents AS (SELECT * FROM given UNION ALL SELECT m + 1 + doc_id, text FROM ({planted}), (SELECT max(doc_id) AS m FROM given))"


def _planted(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """The given chunks and the few planted ones (chunk_index, text), numbered behind them."""
    given = chunks(spark, sf_dir).select("chunk_index", "text")
    behind = given.agg(F.max("chunk_index")).first()[0] + 1
    return materialized(given.unionByName(rows.select((F.col("chunk_index") + behind).alias("chunk_index"), "text")), "planted")


@_query(
    f"WITH {_among(_RARE)}, benchmark AS (SELECT 0 AS item_id, {_sql_text(corpora.RARE_KEYWORD)} AS text), {_INDEX}, {_bm25(RECALL_K)} "
    f"SELECT q::BIGINT AS query_id, min(rank)::BIGINT AS first_rank, count(*)::BIGINT AS n_found FROM bm JOIN documents ON doc_id = ci WHERE contains(text, {_sql_text(corpora.RARE_KEYWORD)}) GROUP BY q"
)
def rare_keyword_rank(spark, sf_dir):
    """At which rank lexical search first finds a chunk that names the rare keyword, in a set planted among all documents."""
    rows = _planted(spark, sf_dir, corpora.rare_keyword(spark))
    question = spark.createDataFrame([(0, corpora.RARE_KEYWORD)], "query_id long, text string")
    hits = lexical.search_texts(rows, question, RECALL_K).join(rows, "chunk_index").where(F.contains(F.col("text"), F.lit(corpora.RARE_KEYWORD)))
    return hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n_found"))


_TRAP = " UNION ALL ".join(f"SELECT {i} AS doc_id, {_sql_text(t)} AS text" for i, t in enumerate(corpora.TRAP_TEXTS))
_TRAP_ASKS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS item_id, {_sql_text(q)} AS text, [{', '.join(map(_sql_text, ws))}] AS keywords" for i, (q, ws) in enumerate(corpora.TRAP_QUERIES))


@_query(
    f"WITH {_among(_TRAP)}, benchmark AS ({_TRAP_ASKS}), {_INDEX}, {_bm25(5)} "
    "SELECT q AS query_id, count(*) FILTER (len(list_filter(b.keywords, lambda k: contains(lower(d.text), k))) > 0)::BIGINT AS n_hits, count(*)::BIGINT AS n_found "
    "FROM bm JOIN documents d ON d.doc_id = ci JOIN benchmark b ON b.item_id = q GROUP BY q"
)
def trap_recall(spark, sf_dir):
    """With the trap set planted among all documents, how many of the first five hits hold a keyword of the answer."""
    rows, asks = corpora.trap(spark)
    rows = _planted(spark, sf_dir, rows)
    hits = lexical.search_texts(rows, asks.select("query_id", "text"), 5).join(rows, "chunk_index").join(asks.select("query_id", "keywords"), "query_id")
    return hits.groupBy("query_id").agg(F.count_if(text.contains_any(F.col("text"), F.col("keywords"))).alias("n_hits"), F.count(F.lit(1)).alias("n_found"))


@_query(
    f"WITH {_INDEX}, {_bm25(5)} SELECT q AS query_id, count(*) FILTER ({' OR '.join(f'contains(lower(d.text), {_sql_text(k)})' for k in KEYWORDS)})::BIGINT AS n_hits "
    "FROM bm JOIN documents d ON d.doc_id = ci GROUP BY q"
)
def keyword_recall(spark, sf_dir):
    """How many of the first five hits hold any of the keywords."""
    rows = chunks(spark, sf_dir)
    hits = lexical.search_texts(rows, asked(spark, sf_dir), 5).join(rows, "chunk_index")
    found = text.contains_any(F.col("text"), F.array(*map(F.lit, KEYWORDS)))
    return hits.groupBy("query_id").agg(F.count_if(found).alias("n_hits"))


@_query(
    f"SELECT doc_id AS chunk_index, '[' || i || '] ' || [{', '.join(map(_sql_text, corpora.TOPICS))}][i % 10 + 1] || ': ' || "
    f"[{', '.join(map(_sql_text, corpora.VARIATIONS))}][(i // 10) % 10 + 1] AS text FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)"
)
def synthetic_corpus(spark, sf_dir):
    """A made text for each document, numbered by the documents' ids."""
    docs = registry.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [], 0)
    made = corpora.synthetic(spark, docs.count()).withColumnRenamed("chunk_index", "_i")
    return docs.join(made, F.col("chunk_index") == F.col("_i")).select(F.col("doc_id").alias("chunk_index"), "text")


# Vectors


@_query(f"WITH {_COSINE}, {_dense(K)} SELECT {_HIT} FROM de")
def cosine_topk(spark, sf_dir):
    own = asked(spark, sf_dir).where("embedding IS NOT NULL")
    return dense.search(vectors(spark, sf_dir), own, K)


@_query(f"WITH {_COSINE} SELECT q AS query_id, ci AS chunk_index, score FROM cos WHERE score >= {COSINE_THRESHOLD}")
def cosine_threshold(spark, sf_dir):
    own = asked(spark, sf_dir).where("embedding IS NOT NULL")
    return dense.at_least(vectors(spark, sf_dir), own, COSINE_THRESHOLD)


@_query(
    "SELECT vec_id AS chunk_index, dim::BIGINT AS dim, round(x / greatest(n, 1e-9), 6) AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, "
    "unnest(embedding::DOUBLE[]) AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
)
def l2_normalize(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("chunk_index", F.posexplode(vector.l2_normalize(F.col("embedding"))).alias("dim", "value"))
    return rows.select("chunk_index", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@_query(
    "SELECT label, dim::BIGINT AS dim, round(sum(m * x) / greatest(sum(m), 1e-9), 6) AS value FROM (SELECT label, (vec_id % 3 <> 0)::INT::DOUBLE AS m, "
    "unnest(range(len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, dim"
)
def mean_pool(spark, sf_dir):
    """Masked mean of the vectors of each label; every third vector is masked out."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    pooled = vector.mean_pool(rows, "label", "v", "mask").select("label", F.posexplode("pooled").alias("dim", "value"))
    return pooled.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@_query("SELECT vec_id AS chunk_index, len(embedding)::BIGINT AS dim FROM embeddings")
def vector_validate(spark, sf_dir):
    return dense.validated(vectors(spark, sf_dir), DIM).select("chunk_index", F.size("embedding").cast("long").alias("dim"))


def _loaded(spark: SparkSession, folder: str) -> VectorIndex:
    tables = index_store.read_tables(spark, folder)
    return VectorIndex(tables["centroids"], tables["vectors"])


@_query()
def ann_topk(spark, sf_dir):
    """Approximate search on an index of inverted lists that was written and read back."""
    folder = scratch(spark, "vectors")
    index_store.write_tables(VectorIndex.build(vectors(spark, sf_dir)).tables(), folder)
    return _loaded(spark, folder).search(asked(spark, sf_dir), K)


@_query(f"WITH {_COSINE}, {_dense(K)} SELECT {_HIT} FROM de")
def vector_append(spark, sf_dir):
    """An index of half the vectors, stored, and the other half appended to it; with all lists probed the search is exact."""
    folder, rows = scratch(spark, "vectors"), vectors(spark, sf_dir)
    index_store.write_tables(VectorIndex.build(rows.where("chunk_index % 2 = 0")).tables(), folder)
    more = _loaded(spark, folder).added(rows.where("chunk_index % 2 = 1"))
    index_store.write_tables({"vectors": more}, folder, append=True)
    return _loaded(spark, folder).search(asked(spark, sf_dir), K, probes=2**31 - 1)


def _embedder(spark: SparkSession, sf_dir: str) -> text_vectors.TextVectors:
    """Fitted on all documents, stored and loaded again."""
    folder = scratch(spark, "text-vectors")
    index_store.write_tables(text_vectors.TextVectors.fit(chunks(spark, sf_dir), DIM).tables(spark), folder)
    return text_vectors.load(spark, folder)


@_query(f"SELECT doc_id AS chunk_index, {DIM}::BIGINT AS dim, (len({_tokens('text')}) > 0)::INT::DOUBLE AS length FROM documents")
def embed_documents(spark, sf_dir):
    """Vectors of all documents from their own texts: how many components, and the length."""
    found = _embedder(spark, sf_dir).embed(chunks(spark, sf_dir))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x.cast("double")))
    return found.select("chunk_index", F.size("embedding").cast("long").alias("dim"), F.round(length, 4).alias("length"))


@_query()
def text_hybrid_topk(spark, sf_dir):
    """Lexical and dense hits fused, both from the texts: questions and documents have vectors by one fitted embedder."""
    model, rows = _embedder(spark, sf_dir), chunks(spark, sf_dir)
    asks = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    own = model.embed(asks.select(F.col("query_id").alias("chunk_index"), "text")).withColumnRenamed("chunk_index", "query_id")
    near = dense.search(model.embed(rows), own, RECALL_K)
    return fusion.rrf([lexical.search_texts(rows, asks, RECALL_K), near], K, texts=rows)


@_query()
def graph_topk(spark, sf_dir):
    """Approximate search on neighbour graphs that were written and read back."""
    folder = scratch(spark, "graphs")
    index_store.write_tables(graph_index.GraphIndex.build(vectors(spark, sf_dir)).tables(), folder)
    return graph_index.load(spark, folder).search(asked(spark, sf_dir), K)


@_query(f"WITH {_COSINE}, {_dense(K)} SELECT {_HIT} FROM de")
def graph_append(spark, sf_dir):
    """Graphs of two thirds of the vectors, stored, and graphs of the others appended; small shards are built anew, and beams as wide as the shards are exact."""
    folder, rows = scratch(spark, "graphs"), vectors(spark, sf_dir)
    for part in range(3):
        index = graph_index.GraphIndex.build(rows.where(F.col("chunk_index") % 3 == part))
        index_store.write_tables(index.tables(), folder, append=True)
    return graph_index.load(spark, folder).compacted().search(asked(spark, sf_dir), K, ef=2**31 - 1)


# Fusion and tenancy


def _lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    asks = asked(spark, sf_dir)
    return [lexical.search_texts(chunks(spark, sf_dir), asks, RECALL_K), dense.search(vectors(spark, sf_dir), asks.where("embedding IS NOT NULL"), RECALL_K)]


@_query(f"{_HYBRID}, {_rrf('bm', 'de', K, False)} SELECT {_HIT} FROM fu")
def rrf_fuse(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir), K)


@_query(f"{_HYBRID}, {_rrf('bm', 'de', K, True)} SELECT {_HIT} FROM fu")
def rrf_dedup(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir), K, texts=chunks(spark, sf_dir))


@_query(f"{_HYBRID}, {_own('bm', 'bm_own')}, {_own('de', 'de_own')}, {_rrf('bm_own', 'de_own', K, True)} SELECT {_HIT} FROM fu")
def tenant_post_filter(spark, sf_dir):
    asks, rows = asked(spark, sf_dir), chunks(spark, sf_dir)
    return fusion.rrf([fusion.visible(h, asks, rows) for h in _lists(spark, sf_dir)], K, texts=rows)


@_query(
    f"WITH {_INDEX}, {_bm25(2**31 - 1)}, {_COSINE}, {_dense(2**31 - 1)}, {_own('bm', 'bm_all')}, {_own('de', 'de_all')}, "
    f"bm_own AS (SELECT * FROM bm_all WHERE rank <= {RECALL_K}), de_own AS (SELECT * FROM de_all WHERE rank <= {RECALL_K}), {_rrf('bm_own', 'de_own', RECALL_K, True)} "
    f"SELECT {_HIT} FROM fu WHERE rank <= {K}"
)
def tenant_pre_filter(spark, sf_dir):
    found = Retriever(chunks(spark, sf_dir), vectors(spark, sf_dir), tenancy="pre").candidates(asked(spark, sf_dir))
    return found.where(F.col("rank") <= K)


# Second stage


@_query(f"WITH {_INDEX}, {_bm25(RECALL_K)}, {_reranked('bm', 5)} SELECT {_HIT}, stage1_pos::BIGINT AS stage1_pos FROM re")
def rerank_topk(spark, sf_dir):
    asks, rows = asked(spark, sf_dir), chunks(spark, sf_dir)
    return rerank.rerank(lexical.search_texts(rows, asks, RECALL_K), asks, rows, 5)


def _proximity(source: str, k: int, name: str = "px") -> str:
    """Candidates reranked by proximity, with positions as rows."""
    pair = f"FROM {source} c JOIN {name}_p p ON p.q = c.q JOIN {name}_k x ON x.ci = c.ci AND x.term = p.a JOIN {name}_k y ON y.ci = c.ci AND y.term = p.b"
    return f"""
{name}_t AS (SELECT q, {_tokens('text')} AS ts FROM qs),
{name}_p AS (SELECT DISTINCT q, ts[i] AS a, ts[i + 1] AS b FROM (SELECT q, ts, unnest(range(1, len(ts))) AS i FROM {name}_t)),
{name}_n AS (SELECT q, count(*) AS n FROM {name}_p GROUP BY q),
{name}_k AS (SELECT ci, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM tok WHERE ci IN (SELECT ci FROM {source})),
{name}_o AS (SELECT q, ci, count(*) AS n FROM (SELECT DISTINCT c.q, c.ci, p.a, p.b {pair} AND y.pos = x.pos + 1) GROUP BY q, ci),
{name}_u AS (SELECT q, ci, count(*) AS n FROM (SELECT DISTINCT c.q, c.ci, p.a, p.b {pair} AND y.pos <> x.pos AND abs(y.pos - x.pos) < {proximity.WINDOW}) GROUP BY q, ci),
{name}_s AS (
  SELECT h.q, h.ci, h.rank AS stage1_pos, round({proximity.TERMS}::DOUBLE * coalesce(len(list_intersect(t.ts, k.ts))::DOUBLE / nullif(len(list_distinct(t.ts)), 0), 0)
    + {proximity.ORDERED}::DOUBLE * coalesce(o.n::DOUBLE / n.n, 0) + {proximity.NEAR}::DOUBLE * coalesce(u.n::DOUBLE / n.n, 0), 6) AS score
  FROM {source} h JOIN {name}_t t ON t.q = h.q JOIN tok k ON k.ci = h.ci LEFT JOIN {name}_n n ON n.q = h.q
  LEFT JOIN {name}_o o ON o.q = h.q AND o.ci = h.ci LEFT JOIN {name}_u u ON u.q = h.q AND u.ci = h.ci
),
{name} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, stage1_pos) AS rank FROM {name}_s QUALIFY rank <= {k})"""


@_query(f"WITH {_INDEX}, {_bm25(RECALL_K)}, {_proximity('bm', 5)} SELECT {_HIT}, stage1_pos::BIGINT AS stage1_pos FROM px")
def proximity_rerank(spark, sf_dir):
    """Lexical candidates reranked by how their terms stand to each other, from an index of positions that was stored."""
    asks, rows, folder = asked(spark, sf_dir), chunks(spark, sf_dir), scratch(spark, "positions")
    index_store.write_tables({"positions": proximity.positions(rows)}, folder)
    found = materialized(lexical.search_texts(rows, asks, RECALL_K), "candidates")
    return proximity.rerank(found, asks, index_store.read_tables(spark, folder)["positions"], 5)


@_query(
    "SELECT vec_id AS chunk_index, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS one_label, "
    "round(exp(embedding[2]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)), 6) AS two_labels FROM embeddings"
)
def score_calibration(spark, sf_dir):
    """Logits to probabilities, with a vector's first two components as logits."""
    a, b = (F.get(F.col("embedding"), i).cast("double") for i in (0, 1))
    one, two = F.round(vector.sigmoid(a), 6).alias("one_label"), F.round(vector.softmax_second(a, b), 6).alias("two_labels")
    return vectors(spark, sf_dir).select("chunk_index", one, two)


@_query(f"{_STAGE1}, {_reranked('fu', 5)} SELECT {_HIT} FROM re")
def two_stage(spark, sf_dir):
    return Retriever(chunks(spark, sf_dir), vectors(spark, sf_dir)).retrieve(asked(spark, sf_dir), 5)


# Packing, prompts, pipeline

_PACK = f"""
av AS (SELECT q, text, ({WINDOW} - {GENERATION} - {_n_words(_sql_text(prompt.SYSTEM_PROMPT))} - {_n_words('text')})::BIGINT AS available FROM qs),
pk AS (
  SELECT h.q, h.ci, h.score, {_n_words('d.text')} AS cost, d.text, row_number() OVER (PARTITION BY h.q ORDER BY h.score DESC, h.rank) AS i
  FROM @SOURCE h JOIN documents d ON d.doc_id = h.ci
),
fold AS (
  SELECT q, available, 0::BIGINT AS i, 0::BIGINT AS used, NULL::BIGINT AS ci, false AS kept FROM av
  UNION ALL
  SELECT f.q, available, pk.i, CASE WHEN used + cost <= available THEN used + cost ELSE used END, pk.ci, available > 0 AND used + cost <= available
  FROM fold f JOIN pk ON pk.q = f.q AND pk.i = f.i + 1
)"""


@_query(f"{_STAGE1}, {_PACK.replace('@SOURCE', 'fu')} SELECT q AS query_id, ci AS chunk_index, i::BIGINT AS place, used::BIGINT AS used FROM fold WHERE kept")
def pack_budget(spark, sf_dir):
    """Which candidates fit a window of 1024 words, each with its place by score and the words used so far."""
    rows, asks = chunks(spark, sf_dir), asked(spark, sf_dir)
    found = Retriever(rows, vectors(spark, sf_dir)).candidates(asks)
    return _places(budget.pack(found, asks, rows, prompt.SYSTEM_PROMPT, WINDOW, GENERATION))


def _places(packed: DataFrame) -> DataFrame:
    kept = packed.select("query_id", F.posexplode("kept").alias("_i", "x"), "kept")
    used = F.aggregate(F.slice("kept", 1, F.col("_i") + 1), F.lit(0).cast("long"), lambda n, x: n + x["cost"])
    return kept.select("query_id", F.col("x.chunk_index").alias("chunk_index"), F.col("x.rank").alias("place"), used.alias("used"))


def _vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query()
def subword_budget(spark, sf_dir):
    """Which candidates fit a window of 1024 subwords: the places of ``pack_budget`` with a model's own counts."""
    rows, asks = chunks(spark, sf_dir), asked(spark, sf_dir)
    found = Retriever(rows, vectors(spark, sf_dir)).candidates(asks)
    return _places(budget.pack(found, asks, rows, prompt.SYSTEM_PROMPT, WINDOW, GENERATION, count=subwords.subword_count(_vocabulary_file())))


@_query(_ORACLE["pack_budget"])
def sql_pack_budget(spark, sf_dir):
    """``pack_budget`` by the packer for SQL text."""
    rows, asks = chunks(spark, sf_dir), asked(spark, sf_dir)
    found = Retriever(rows, vectors(spark, sf_dir)).candidates(asks)
    sql.register(spark)
    return spark.sql(
        "WITH c AS (SELECT q.query_id, h.chunk_index, h.score, h.rank, word_count(d.text) AS cost, :room - word_count(:system) - word_count(q.text) AS available "
        "FROM {hits} h JOIN {asks} q ON q.query_id = h.query_id JOIN {rows} d ON d.chunk_index = h.chunk_index) "
        "SELECT * FROM pack_budget(TABLE(c) PARTITION BY query_id ORDER BY (score DESC, rank))",
        args={"room": WINDOW - GENERATION, "system": prompt.SYSTEM_PROMPT},
        hits=found,
        asks=asks,
        rows=rows,
    )


_BUDGET = " UNION ALL ".join(
    f"SELECT {sum(c[0] for c in corpora.BUDGET_CHUNKS[:n])} + i AS doc_id, trim(repeat('word ', {words})) AS text, round({best}::DOUBLE - i * {step}::DOUBLE, 4) AS score FROM range({count}) r(i)"
    for n, (count, words, best, step) in enumerate(corpora.BUDGET_CHUNKS)
)


@_query(
    f"WITH RECURSIVE documents AS ({_BUDGET}), qs AS (SELECT item_id AS q, text FROM benchmark), src AS (SELECT q, doc_id AS ci, score, doc_id + 1 AS rank FROM documents, qs), "
    f"{_PACK.replace('@SOURCE', 'src')} SELECT q AS query_id, ci::BIGINT AS chunk_index, used::BIGINT AS used FROM fold WHERE kept"
)
def budget_set(spark, sf_dir):
    """Which of a few long and many short chunks fit a window of 1024 words beside each question."""
    rows = corpora.budget_chunks(spark)
    asks = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    few = F.broadcast(rows.select("chunk_index", "score", (F.col("chunk_index") + 1).alias("rank")))  # 20 rows
    found = asks.select("query_id").crossJoin(few)
    kept = budget.pack(found, asks, rows.select("chunk_index", "text"), prompt.SYSTEM_PROMPT, WINDOW, GENERATION).select("query_id", F.posexplode("kept").alias("_i", "x"), "kept")
    used = F.aggregate(F.slice("kept", 1, F.col("_i") + 1), F.lit(0).cast("long"), lambda n, x: n + x["cost"])
    return kept.select("query_id", F.col("x.chunk_index").alias("chunk_index"), used.alias("used"))


def _prompt_sql(template: str, context: str, system: str, query: str) -> str:
    a, b, c = (f"E{_sql_text(x)}".replace("\n", "\\n") for x in prompt.TEMPLATES[template])
    user = f"CASE WHEN {context} IS NULL THEN {query} ELSE {context} || chr(10) || chr(10) || {query} END"
    return f"{a} || {system} || {b} || {user} || {c}"


@_query(
    f"WITH {_INDEX}, {_bm25(3)}, c AS (SELECT q, 'Context:' || chr(10) || string_agg('[' || rank || '] ' || d.text, chr(10) ORDER BY rank) AS ctx FROM bm JOIN documents d ON d.doc_id = ci GROUP BY q) "
    + " UNION ALL ".join(f"SELECT q AS query_id, '{t}' AS template, {_prompt_sql(t, 'ctx', _sql_text(prompt.SYSTEM_PROMPT), 'text')} AS prompt FROM qs LEFT JOIN c USING (q)" for t in prompt.TEMPLATES)
)
def build_prompt(spark, sf_dir):
    """Prompts in both templates around the first three lexical hits."""
    rows, asks = chunks(spark, sf_dir), asked(spark, sf_dir)
    hits = lexical.search_texts(rows, asks, 3).join(rows, "chunk_index")
    ordered = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    both = asks.select("query_id", "text").join(ordered, "query_id", "left")
    texts = F.coalesce(F.transform("c", lambda x: x["text"]), F.array().cast("array<string>"))
    made = [F.struct(F.lit(t).alias("template"), prompt.build_prompt(F.lit(prompt.SYSTEM_PROMPT), F.col("text"), texts, t).alias("prompt")) for t in prompt.TEMPLATES]
    return both.select("query_id", F.explode(F.array(*made)).alias("x")).select("query_id", "x.template", "x.prompt")


@_query(f"{_STAGE1} SELECT {_HIT} FROM fu WHERE rank <= 5")
def pipeline_topk(spark, sf_dir):
    """The pipeline's choice of chunks without the second stage."""
    return Retriever(chunks(spark, sf_dir), vectors(spark, sf_dir)).retrieve(asked(spark, sf_dir), 5, use_reranker=False)


@_query(
    f"{_STAGE1}, {_reranked('fu', 5)}, {_PACK.replace('@SOURCE', 're')}, "
    "k AS (SELECT f.q, f.ci, pk.text, row_number() OVER (PARTITION BY f.q ORDER BY f.i) AS n FROM fold f JOIN pk ON pk.q = f.q AND pk.ci = f.ci WHERE kept), "
    "c AS (SELECT q, 'Context:' || chr(10) || string_agg('[' || n || '] ' || text, chr(10) ORDER BY n) AS ctx, count(*) AS n_used FROM k GROUP BY q), "
    "t AS (SELECT q, count(*) AS n FROM re GROUP BY q), "
    f"p AS (SELECT qs.q, coalesce(t.n, 0)::BIGINT AS n_retrieved, coalesce(n_used, 0)::BIGINT AS n_used, {_prompt_sql('chatml', 'ctx', _sql_text(prompt.SYSTEM_PROMPT), 'qs.text')} AS prompt "
    f"FROM qs LEFT JOIN c USING (q) LEFT JOIN t USING (q)) SELECT q AS query_id, prompt, n_retrieved, n_used, {_n_words('prompt')}::BIGINT AS prompt_tokens FROM p"
)
def pipeline_prompt(spark, sf_dir):
    """The whole pipeline: two stages, packing, prompt and its count of words."""
    made = answer_prompts(Retriever(chunks(spark, sf_dir), vectors(spark, sf_dir)), asked(spark, sf_dir), 5, True, window=WINDOW, max_generation=GENERATION)
    return made.drop("chunks_used")


@_query(
    f"WITH {_INDEX}, {_bm25(3)}, w AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark), t AS (SELECT item_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM w), "
    """c AS (SELECT q, string_agg('{"chunk_index":' || ci || ',"rank":' || rank || '}', ',' ORDER BY rank) AS cs FROM bm GROUP BY q) """
    "SELECT item_id AS query_id, i::BIGINT AS pos, 'data: ' || to_json({'token': ws[i], 'is_end': false}) || chr(10) || chr(10) AS event FROM t UNION ALL "
    """SELECT item_id, (len(ws) + 1)::BIGINT, 'data: {"token":"","is_end":true,"sources":[' || coalesce(cs, '') || ']}' || chr(10) || chr(10) FROM w LEFT JOIN c ON c.q = item_id"""
)
def sse_events(spark, sf_dir):
    """A stream of token events for each query's words, with a last event that ends it and names the chunks used."""
    asks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = lexical.search_texts(chunks(spark, sf_dir), asks, 3)
    sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_index"))), lambda x: F.struct(x["chunk_index"].alias("chunk_index"), x["rank"].alias("rank"))).alias("sources"))
    ws = text.words(F.col("text"))
    rows = asks.select("query_id", F.posexplode(ws).alias("pos", "token"), F.lit(False).alias("is_end"))
    events = rows.select("query_id", (F.col("pos") + 1).cast("long").alias("pos"), prompt.sse_event(F.struct("token", "is_end")).alias("event"))
    none = F.array().cast("array<struct<chunk_index: bigint, rank: bigint>>")
    last = F.struct(F.lit("").alias("token"), F.lit(True).alias("is_end"), F.coalesce("sources", none).alias("sources"))
    ends = asks.join(sources, "query_id", "left").select("query_id", (F.size(ws) + 1).cast("long").alias("pos"), prompt.sse_event(last).alias("event"))
    return events.unionByName(ends)


# Chunking

_BOUNDARIES = f"""{_SENTENCES},
sv AS (SELECT *, list_distinct({_tokens('sentence')}) AS v FROM sent),
sl AS (SELECT *, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM sv),
sb AS (
  SELECT doc_id, pos, sentence, CASE WHEN pos > 0 THEN round(CASE WHEN len(v) > 0 AND len(b) > 0 THEN len(list_intersect(b, v)) / sqrt(len(b)::DOUBLE * len(v)) ELSE 0.0 END, 9) END AS similarity
  FROM sl
),
bd AS (SELECT *, pos = 0 OR similarity < {CHUNK_THRESHOLD} AS is_boundary FROM sb),
gr AS (SELECT *, sum(is_boundary::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS grp FROM bd)"""


def _fold(source: str) -> str:
    """Greedy filling of sentences (doc_id, grp, i from 1, sentence): each with the chunk it falls into."""
    return f"""
sn AS (SELECT doc_id, grp, i, sentence, {_n_words('sentence')} AS n FROM {source}),
fl AS (
  SELECT DISTINCT doc_id, grp, 0::BIGINT AS i, 0::BIGINT AS cur, 0::BIGINT AS nxt, NULL::BIGINT AS chunk, false AS long FROM sn
  UNION ALL
  SELECT s.doc_id, s.grp, s.i,
    CASE WHEN s.n > {CHUNK_TOKENS} THEN 0 WHEN f.cur + s.n > {CHUNK_TOKENS} THEN s.n ELSE f.cur + s.n END,
    CASE WHEN s.n > {CHUNK_TOKENS} THEN f.nxt + (f.cur > 0)::BIGINT + ceil(s.n / {text.SLICE_WORDS}.0)::BIGINT WHEN f.cur > 0 AND f.cur + s.n > {CHUNK_TOKENS} THEN f.nxt + 1 ELSE f.nxt END,
    CASE WHEN f.cur > 0 AND f.cur + s.n > {CHUNK_TOKENS} THEN f.nxt + 1 ELSE f.nxt END, s.n > {CHUNK_TOKENS}
  FROM fl f JOIN sn s ON s.doc_id = f.doc_id AND s.grp = f.grp AND s.i = f.i + 1
),
ch AS (
  SELECT f.doc_id, f.grp, f.chunk, string_agg(s.sentence, ' ' ORDER BY f.i) AS text FROM fl f JOIN sn s USING (doc_id, grp, i) WHERE NOT long AND f.i > 0 GROUP BY f.doc_id, f.grp, f.chunk
  UNION ALL
  SELECT doc_id, grp, chunk + j // {text.SLICE_WORDS}, array_to_string(ws[j + 1 : j + {text.SLICE_WORDS}], ' ') FROM (
    SELECT doc_id, grp, chunk, {_WORDS.format('sentence')} AS ws, unnest(range(0, n, {text.SLICE_WORDS})) AS j FROM fl JOIN sn USING (doc_id, grp, i) WHERE long)
)"""


@_query(f"WITH {_BOUNDARIES} SELECT doc_id, pos::BIGINT AS pos, similarity, is_boundary FROM bd")
def chunk_boundaries(spark, sf_dir):
    return chunking.boundaries(table(spark, sf_dir, "documents"), CHUNK_THRESHOLD).drop("sentence")


@_query(f"WITH {_BOUNDARIES} SELECT doc_id, grp::BIGINT AS grp, count(*)::BIGINT AS n_sentences, string_agg(sentence, ' ' ORDER BY pos) AS text FROM gr GROUP BY doc_id, grp")
def chunk_groups(spark, sf_dir):
    found = chunking.groups(chunking.boundaries(table(spark, sf_dir, "documents"), CHUNK_THRESHOLD))
    return found.select("doc_id", "grp", F.size("sentences").cast("long").alias("n_sentences"), "text")


@_query(f"WITH RECURSIVE {_SENTENCES}, src AS (SELECT doc_id, 0 AS grp, pos + 1 AS i, sentence FROM sent), {_fold('src')} SELECT doc_id, chunk::BIGINT AS pos, text FROM ch")
def split_by_tokens(spark, sf_dir):
    """Whole documents as one group, split by a count of words."""
    parts = chunking.split_by_tokens(text.split_sentences(F.col("text")), CHUNK_TOKENS)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@_query(
    f"WITH RECURSIVE {_BOUNDARIES}, src AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) AS i, sentence FROM gr), {_fold('src')} "
    "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY grp, chunk) - 1)::BIGINT AS pos, text FROM ch"
)
def semantic_chunks(spark, sf_dir):
    """The whole chunker: boundaries, groups, and splits of groups that are too long."""
    return chunking.semantic_chunks(table(spark, sf_dir, "documents"), CHUNK_THRESHOLD, CHUNK_TOKENS)


@_query(_ORACLE["semantic_chunks"])
def sql_semantic_chunks(spark, sf_dir):
    """The chunker called from SQL text. OUTER keeps Spark from making the chunks once more to filter texts without any."""
    sql.register(spark)
    return spark.sql(
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, chunk AS text FROM (SELECT doc_id, semantic_chunks(text, CAST(:threshold AS DOUBLE), :tokens) AS cs FROM {docs}) "
        "LATERAL VIEW OUTER posexplode(cs) e AS pos, chunk WHERE chunk IS NOT NULL",
        args={"threshold": CHUNK_THRESHOLD, "tokens": CHUNK_TOKENS},
        docs=table(spark, sf_dir, "documents"),
    )


# Registry

_REGISTRY = f"reg AS (SELECT doc_id AS chunk_index, source AS tenant, text, TIMESTAMP '{CREATED}' AS created_at FROM documents)"


@_query(f"WITH {_REGISTRY} SELECT * FROM reg ORDER BY chunk_index")
def registry_all(spark, sf_dir):
    return registry.all_chunks(registered(spark, sf_dir))


@_query(f"WITH {_REGISTRY} SELECT * FROM reg WHERE tenant = '{TENANT}' ORDER BY chunk_index")
def registry_by_tenant(spark, sf_dir):
    return registry.by_tenant(registered(spark, sf_dir), TENANT)


@_query(f"WITH {_REGISTRY} SELECT chunk_index FROM reg WHERE tenant = '{TENANT}'")
def tenant_indices(spark, sf_dir):
    return registry.indices_of(registered(spark, sf_dir), TENANT)


def _in_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry written in two goes in folders by tenant, and read back."""
    folder, rows = scratch(spark, "registry"), registered(spark, sf_dir)
    for half in (0, 1):
        registry.write(rows.where(F.col("chunk_index") % 2 == half), folder, append=True)
    return spark.read.parquet(folder)


@_query(f"WITH {_REGISTRY} SELECT * FROM reg WHERE tenant = '{TENANT}' ORDER BY chunk_index")
def tenant_folder_scan(spark, sf_dir):
    """One tenant's chunks from a registry that lies in folders by tenant."""
    return registry.by_tenant(_in_folders(spark, sf_dir), TENANT)


@_query(f"WITH {_INDEX}, {_bm25(RECALL_K)}, {_own('bm', 'bm_own')} SELECT {_HIT} FROM bm_own")
def tenant_folder_filter(spark, sf_dir):
    """Lexical hits on the queries' own tenants' chunks, with the registry in folders by tenant."""
    asks = asked(spark, sf_dir)
    return fusion.visible(lexical.search_texts(chunks(spark, sf_dir), asks, RECALL_K), asks, _in_folders(spark, sf_dir))


@_query(f"WITH {_REGISTRY} SELECT count(*)::BIGINT AS n_chunks, coalesce(max(chunk_index), -1)::BIGINT AS max_index FROM reg")
def registry_stats(spark, sf_dir):
    return registry.stats(registered(spark, sf_dir))


@_query(f"WITH {_REGISTRY} SELECT tenant, count(*)::BIGINT AS n_chunks FROM reg WHERE tenant <> '{TENANT}' GROUP BY tenant")
def delete_tenant(spark, sf_dir):
    """What is left of each tenant after one is deleted."""
    return registry.without_tenant(registered(spark, sf_dir), TENANT).groupBy("tenant").agg(F.count(F.lit(1)).alias("n_chunks"))


@_query(
    f"WITH RECURSIVE {_SENTENCES}, src AS (SELECT doc_id, 0 AS grp, pos + 1 AS i, sentence FROM sent), {_fold('src')}, {_REGISTRY}, "
    "m AS (SELECT max(chunk_index) AS m FROM reg) SELECT chunk_index, tenant, text FROM reg UNION ALL "
    "SELECT (m + row_number() OVER (ORDER BY ch.doc_id, chunk))::BIGINT, source, ch.text FROM ch JOIN documents d ON d.doc_id = ch.doc_id, m"
)
def ingest_append(spark, sf_dir):
    """Chunks of all documents appended to a registry, numbered on from its highest index."""
    docs = table(spark, sf_dir, "documents")
    parts = chunking.split_by_tokens(text.split_sentences(F.col("text")), CHUNK_TOKENS)
    new = docs.select("doc_id", F.col("source").alias("tenant"), F.posexplode(parts).alias("pos", "text"))
    return registry.append(chunks(spark, sf_dir), new, "doc_id", ["pos"])


@_query(
    f"WITH RECURSIVE {_BOUNDARIES}, src AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) AS i, sentence FROM gr), {_fold('src')}, "
    "st AS (SELECT row_number() OVER (ORDER BY doc_id, grp, chunk) - 1 AS chunk_index, text FROM ch), "
    f"{_index('st', 'chunk_index')}, {_bm25(K)} SELECT {_HIT} FROM bm"
)
def ingest_search(spark, sf_dir):
    """Documents ingested into a stored corpus, which is opened again and searched."""
    folder = scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant"), "text")
    store.ingest(docs, folder, threshold=CHUNK_THRESHOLD, max_tokens=CHUNK_TOKENS)
    return store.restore(spark, folder).index.search(asked(spark, sf_dir), K)


def _remaining(order: str) -> str:
    """A search of the stored chunks, numbered in that order, when a tenant's are deleted."""
    return (
        f"WITH RECURSIVE {_BOUNDARIES}, src AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) AS i, sentence FROM gr), {_fold('src')}, "
        f"nb AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS chunk_index, doc_id, text FROM ch), "
        f"st AS (SELECT nb.chunk_index, nb.text FROM nb JOIN documents d ON d.doc_id = nb.doc_id WHERE d.source <> '{TENANT}'), "
        f"{_index('st', 'chunk_index')}, {_bm25(K)} SELECT {_HIT} FROM bm"
    )


@_query(_remaining("doc_id, grp, chunk"))
def delete_search(spark, sf_dir):
    """A stored corpus searched after a tenant's chunks were deleted from it, statistics included."""
    folder = scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant"), "text")
    store.ingest(docs, folder, threshold=CHUNK_THRESHOLD, max_tokens=CHUNK_TOKENS)
    store.delete_tenant(spark, folder, TENANT)
    return store.restore(spark, folder).index.search(asked(spark, sf_dir), K)


@_query(_remaining("doc_id % 2, doc_id, grp, chunk"))
def compacted_search(spark, sf_dir):
    """A corpus stored in two parts, a tenant deleted, and the parts merged without its rows."""
    folder = scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("tenant"), "text")
    for half in (0, 1):
        store.ingest(docs.where(F.col("doc_id") % 2 == half), folder, threshold=CHUNK_THRESHOLD, max_tokens=CHUNK_TOKENS)
    store.delete_tenant(spark, folder, TENANT)
    store.compact(spark, folder)
    return store.restore(spark, folder).index.search(asked(spark, sf_dir), K)


@_query("SELECT count(DISTINCT source)::BIGINT AS active_tenants FROM documents")
def active_tenants(spark, sf_dir):
    return registry.active_tenants(registered(spark, sf_dir))


# Evaluation

_QRELS = f"qr AS (SELECT qs.q, d.doc_id AS ci, l.quality AS rel FROM qs JOIN documents d ON d.source = qs.tenant JOIN labels l ON l.doc_id = d.doc_id)"
_JUDGED = f"jd AS (SELECT bm.q, bm.ci, bm.rank, coalesce(qr.rel, 0)::DOUBLE AS rel FROM bm LEFT JOIN qr ON qr.q = bm.q AND qr.ci = bm.ci)"
_EVAL = f"WITH {_INDEX}, {_bm25(RECALL_K)}, {_QRELS}, {_JUDGED}, nr AS (SELECT q, count(DISTINCT ci) AS n FROM qr WHERE rel > 0 GROUP BY q), aq AS (SELECT q FROM bm UNION SELECT q FROM nr)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_texts(chunks(spark, sf_dir), asked(spark, sf_dir), RECALL_K)


@_query(f"{_EVAL} SELECT q AS query_id, ci AS chunk_index, rank::BIGINT AS rank, rel FROM jd")
def qrels_join(spark, sf_dir):
    return evaluation.judged(_hits(spark, sf_dir), qrels(spark, sf_dir)).drop("score")


@_query(
    f"{_EVAL}, f AS (SELECT q, count(*) FILTER (rank <= {EVAL_K} AND rel > 0) AS k FROM jd GROUP BY q) "
    "SELECT aq.q AS query_id, round(coalesce(f.k / nr.n::DOUBLE, 0.0), 6) AS recall FROM aq LEFT JOIN f USING (q) LEFT JOIN nr USING (q)"
)
def recall_at_k(spark, sf_dir):
    found = evaluation.recall(_hits(spark, sf_dir), qrels(spark, sf_dir), EVAL_K)
    return found.withColumn("recall", F.round("recall", 6))


@_query(f"{_EVAL}, f AS (SELECT q, min(rank) FILTER (rel > 0) AS r FROM jd GROUP BY q) SELECT aq.q AS query_id, round(coalesce(1.0::DOUBLE / f.r, 0.0), 6) AS rr FROM aq LEFT JOIN f USING (q)")
def mrr(spark, sf_dir):
    return evaluation.reciprocal_rank(_hits(spark, sf_dir), qrels(spark, sf_dir)).withColumn("rr", F.round("rr", 6))


_GAIN = "rel / log2(rank + 1.0::DOUBLE)"


@_query(f"{_EVAL} SELECT q AS query_id, round(sum({_GAIN}), 6) AS dcg FROM jd WHERE rank <= {EVAL_K} GROUP BY q")
def dcg_at_k(spark, sf_dir):
    return evaluation.dcg(_hits(spark, sf_dir), qrels(spark, sf_dir), EVAL_K).withColumn("dcg", F.round("dcg", 6))


def _ndcg(rows: str, best: str) -> str:
    return f"""
nd_b AS (SELECT q, rel, place AS rank FROM (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY rel DESC) AS place FROM {best}) WHERE place <= {EVAL_K}),
nd_i AS (SELECT q, sum({_GAIN}) AS i FROM nd_b GROUP BY q),
nd_d AS (SELECT q, sum({_GAIN}) AS d FROM {rows} WHERE rank <= {EVAL_K} GROUP BY q),
nd AS (SELECT coalesce(nd_d.q, nd_i.q) AS q, coalesce(d / nullif(i, 0), 0.0) AS ndcg FROM nd_d FULL JOIN nd_i ON nd_d.q = nd_i.q)"""


_ND = "SELECT q AS query_id, round(ndcg, 6) AS ndcg FROM nd"


@_query(f"{_EVAL}, {_ndcg('jd', 'jd')} {_ND}")
def ndcg_at_k(spark, sf_dir):
    """With the retrieved list's own best order as ideal."""
    return evaluation.ndcg(_hits(spark, sf_dir), qrels(spark, sf_dir), EVAL_K).withColumn("ndcg", F.round("ndcg", 6))


@_query(f"{_EVAL}, {_ndcg('jd', 'qr')} {_ND}")
def ndcg_judged(spark, sf_dir):
    """With the best order of all judgements as ideal."""
    return evaluation.ndcg(_hits(spark, sf_dir), qrels(spark, sf_dir), EVAL_K, ideal="judged").withColumn("ndcg", F.round("ndcg", 6))


@_query(f"{_EVAL}, bi AS (SELECT q, ci, rank, (rel > 0)::INT::DOUBLE AS rel FROM jd WHERE rank <= {EVAL_K}), {_ndcg('bi', 'bi')} {_ND}")
def ndcg_binary(spark, sf_dir):
    return evaluation.ndcg(_hits(spark, sf_dir), qrels(spark, sf_dir), EVAL_K, binary=True).withColumn("ndcg", F.round("ndcg", 6))


def _strategy_sql(name: str, source: str) -> str:
    """CTEs for one strategy's row of the ablation."""
    p = name
    return f"""
{p}_h AS (SELECT q, ci, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank FROM {source} WHERE rank <= {EVAL_K}),
{p}_j AS (SELECT h.q, h.ci, h.rank, coalesce(qr.rel, 0)::DOUBLE AS rel FROM {p}_h h LEFT JOIN qr ON qr.q = h.q AND qr.ci = h.ci),
{p}_b AS (SELECT q, rel, row_number() OVER (PARTITION BY q ORDER BY rel DESC) AS rank FROM {p}_j),
{p}_i AS (SELECT q, sum({_GAIN}) AS i FROM {p}_b GROUP BY q),
{p}_d AS (SELECT q, sum({_GAIN}) AS d, count(*) FILTER (rel > 0) AS k, min(rank) FILTER (rel > 0) AS f FROM {p}_j GROUP BY q),
{p}_m AS (
  SELECT '{name}' AS strategy, count(*)::BIGINT AS n_queries, round(avg(coalesce(d / nullif(i, 0), 0.0)), 6) AS ndcg,
    round(avg(coalesce(k / nr.n::DOUBLE, 0.0)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / f, 0.0)), 6) AS mrr
  FROM {p}_d JOIN {p}_i USING (q) LEFT JOIN nr USING (q)
)"""


_ABLATION = (
    f"{_HYBRID}, {_rrf('bm', 'de', RECALL_K, True)}, {_reranked('fu', EVAL_K)}, {_QRELS}, nr AS (SELECT q, count(DISTINCT ci) AS n FROM qr WHERE rel > 0 GROUP BY q), "
    + ", ".join(_strategy_sql(n, s) for n, s in (("dense", "de"), ("hybrid", "fu"), ("reranked", "re")))
    + ", ab AS (SELECT * FROM dense_m UNION ALL SELECT * FROM hybrid_m UNION ALL SELECT * FROM reranked_m)"
)


def _ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, rows = asked(spark, sf_dir), chunks(spark, sf_dir)
    # at most RECALL_K rows for each query, used by several strategies
    words, near = (materialized(hits, "hits") for hits in _lists(spark, sf_dir))
    fused = materialized(fusion.rrf([words, near], RECALL_K, texts=rows), "hits")
    cut = lambda hits: hits.where(F.col("rank") <= EVAL_K).select("query_id", "chunk_index", "rank")
    strategies = {"dense": cut(near), "hybrid": cut(fused), "reranked": cut(rerank.rerank(fused, asks, rows, EVAL_K))}
    # judgements of queries that a strategy has no hits for don't count, as in a run over retrieved queries
    rel = qrels(spark, sf_dir)
    found = None
    for name, hits in strategies.items():
        own = rel.join(hits.select("query_id").distinct(), "query_id", "left_semi")
        row = evaluation.ablation({name: hits}, own, EVAL_K)
        found = row if found is None else found.unionByName(row)
    return found


@_query(f"{_ABLATION} SELECT * FROM ab")
def eval_ablation(spark, sf_dir):
    return _ablation(spark, sf_dir)


@_query()
def ablation_latency(spark, sf_dir):
    """Mean time per query of each strategy, run as a batch."""
    asks, rows = asked(spark, sf_dir).where("embedding IS NOT NULL"), chunks(spark, sf_dir)
    near = lambda: dense.search(vectors(spark, sf_dir), asks, EVAL_K)
    fused = lambda: fusion.rrf([lexical.search_texts(rows, asks, RECALL_K), dense.search(vectors(spark, sf_dir), asks, RECALL_K)], RECALL_K, texts=rows)
    strategies = {"dense": near, "hybrid": fused, "reranked": lambda: rerank.rerank(fused(), asks, rows, EVAL_K)}
    return evaluation.timed(strategies, asks.count(), spark)


_BEIR_N = 50


@_query(
    f"WITH sd AS (SELECT 'd' || doc_id AS sid, doc_id AS old, source, concat_ws('. ', nullif(source, ''), nullif(text, '')) AS text FROM documents), "
    f"sq AS (SELECT 'q' || item_id AS sid, item_id, text FROM benchmark WHERE text <> '' AND 'src' || (item_id % {N_TENANTS}) IN (SELECT source FROM documents JOIN labels USING (doc_id))), "
    f"documents AS (SELECT (row_number() OVER (ORDER BY sid) - 1)::BIGINT AS doc_id, * FROM sd), benchmark AS (SELECT * FROM sq ORDER BY sid LIMIT {_BEIR_N}), {_INDEX}, {_bm25(EVAL_K)}, "
    "rel AS (SELECT b.item_id AS q, d.doc_id AS ci FROM benchmark b JOIN documents d ON d.source = 'src' || (b.item_id % 20) JOIN labels l ON l.doc_id = d.old WHERE l.quality > 0), "
    "k AS (SELECT bm.q, count(rel.ci) AS n FROM bm LEFT JOIN rel ON rel.q = bm.q AND rel.ci = bm.ci GROUP BY bm.q), t AS (SELECT q, count(DISTINCT ci) AS n FROM rel GROUP BY q) "
    "SELECT b.sid AS query_id, round(coalesce(k.n / t.n::DOUBLE, 0.0), 6) AS recall FROM benchmark b LEFT JOIN k ON k.q = b.item_id LEFT JOIN t ON t.q = b.item_id WHERE k.q IS NOT NULL OR t.q IS NOT NULL"
)
def beir_recall(spark, sf_dir):
    """The given tables written as a corpus/queries/qrels folder, loaded again, its ids numbered, the first queries evaluated."""
    folder = scratch(spark, "beir")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("_id"), F.col("source").alias("title"), "text")
    docs.write.parquet(f"{folder}/corpus")
    table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("_id"), "text").write.parquet(f"{folder}/queries")
    made = qrels(spark, sf_dir).select(F.concat(F.lit("q"), "query_id").alias("query-id"), F.concat(F.lit("d"), "chunk_index").alias("corpus-id"), F.col("rel").alias("score"))
    made.write.parquet(f"{folder}/qrels/train")
    corpus, queries, rels = corpora.beir(spark, folder)
    numbers = registry.numbered(corpus, "doc_id", [], 0)
    asks = materialized(corpora.first_queries(queries, _BEIR_N), "queries")
    hits = lexical.search_texts(numbers, asks, EVAL_K)
    judged = rels.join(asks.select("query_id"), "query_id").join(numbers.select("doc_id", "chunk_index"), "doc_id")
    return evaluation.recall(hits, judged, EVAL_K).withColumn("recall", F.round("recall", 6))


@_query(
    f"{_ABLATION} SELECT arg_max(strategy, (ndcg, strategy)) AS best, max(ndcg) AS best_value, max(ndcg) FILTER (strategy = 'dense') AS base_value, "
    "round(coalesce((max(ndcg) - max(ndcg) FILTER (strategy = 'dense')) / nullif(max(ndcg) FILTER (strategy = 'dense'), 0) * 100, 0.0), 4) AS improvement_percent FROM ab"
)
def eval_best(spark, sf_dir):
    return evaluation.best_strategy(_ablation(spark, sf_dir), "dense")


# Telemetry

_LES = ", ".join(f"({b}::DOUBLE, '{b}')" for b in metrics.BUCKETS)


@_query(
    f"SELECT event_type, le, n FROM (SELECT event_type, le, count(*) FILTER (value / 100 <= b)::BIGINT AS n FROM events, (VALUES {_LES}) v(b, le) WHERE value IS NOT NULL GROUP BY event_type, le "
    "UNION ALL SELECT event_type, '+Inf', count(*)::BIGINT FROM events WHERE value IS NOT NULL GROUP BY event_type)"
)
def metrics_histogram(spark, sf_dir):
    """A cumulative latency histogram for each type of event, with a hundredth of its value as seconds."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("seconds"))
    return metrics.histogram(rows, ["event_type"], "seconds")


@_query("SELECT event_type, count(value)::BIGINT AS n, round(coalesce(sum(value), 0.0), 4) AS total FROM events GROUP BY event_type")
def metrics_counter(spark, sf_dir):
    return metrics.counter(table(spark, sf_dir, "events"), ["event_type"], "value")


_LE = ", ".join(f"({b}::DOUBLE, '{b}')" for b in metrics.BUCKETS) + ", ('inf'::DOUBLE, '+Inf')"


@_query(
    "WITH e AS (SELECT 'event_type=\"' || event_type || '\"' AS ls, value / 100 AS s FROM events WHERE value IS NOT NULL) "
    f"SELECT 'event_seconds_bucket{{' || ls || ',le=\"' || le || '\"}} ' || count(*) FILTER (s <= b) AS line FROM e, (VALUES {_LE}) v(b, le) GROUP BY ls, le "
    "UNION ALL SELECT 'event_seconds_sum{' || ls || '} ' || round(sum(s), 6)::DECIMAL(38, 6)::VARCHAR FROM e GROUP BY ls UNION ALL SELECT 'event_seconds_count{' || ls || '} ' || count(*) FROM e GROUP BY ls "
    "UNION ALL SELECT '# HELP event_seconds Seconds of events' UNION ALL SELECT '# TYPE event_seconds histogram'"
)
def metrics_text(spark, sf_dir):
    """The histogram as a scraper reads it."""
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("seconds"))
    return metrics.exposition("event_seconds", rows, ["event_type"], "seconds", "Seconds of events").select("line")


@_query(
    f"WITH RECURSIVE {_SENTENCES}, src AS (SELECT doc_id, 0 AS grp, pos + 1 AS i, sentence FROM sent), {_fold('src')}, "
    f"m AS (SELECT 'documents' AS series, count(*) AS rows, sum({_n_words('text')}) AS words FROM documents UNION ALL SELECT 'chunks', count(*), sum({_n_words('text')}) FROM ch) "
    "SELECT series, 'rows' AS name, rows::BIGINT AS value FROM m UNION ALL SELECT series, 'words', coalesce(words, 0)::BIGINT FROM m"
)
def stream_metrics(spark, sf_dir):
    """What a stream that splits documents saw go in and come out, as its listener heard it from the running batches."""
    folder = scratch(spark, "stream-metrics")
    path = f"{sf_dir}/documents.parque[t]"  # a file stream takes a single file by a pattern only
    words = F.sum(text.word_count(F.col("text")))
    docs = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).select("doc_id", "text")
    seen = docs.observe("documents", F.count(F.lit(1)).alias("rows"), words.alias("words"))
    parts = chunking.split_by_tokens(text.split_sentences(F.col("text")), CHUNK_TOKENS)
    found = seen.select("doc_id", F.posexplode(parts).alias("pos", "text")).observe("chunks", F.count(F.lit(1)).alias("rows"), words.alias("words"))
    heard = telemetry.StreamMetrics("documents", "chunks")
    spark.streams.addListener(heard)
    try:
        heard.wait(found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/chunks"))
    finally:
        spark.streams.removeListener(heard)
    return telemetry.as_rows(spark, heard.totals)
