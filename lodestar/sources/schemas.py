"""Declared schemas, and requests and responses. Their field names and defaults, which are the interface."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("chunk_index", T.LongType(), False),
        T.StructField("tenant", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)
POSTINGS = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("chunk_index", T.LongType(), False), T.StructField("tf", T.LongType(), False), T.StructField("dl", T.LongType(), False)])
DOC_STATS = T.StructType([T.StructField("chunk_index", T.LongType(), False), T.StructField("dl", T.LongType(), False)])
TERM_STATS = T.StructType([T.StructField("term", T.StringType(), False), T.StructField("df", T.LongType(), False), T.StructField("idf", T.DoubleType(), False)])
CORPUS_STATS = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("avg_dl", T.DoubleType(), False)])
VECTORS = T.StructType(
    [T.StructField("chunk_index", T.LongType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()), False), T.StructField("list", T.IntegerType(), True)]
)
CENTROIDS = T.StructType([T.StructField("list", T.IntegerType(), False), T.StructField("centroid", T.ArrayType(T.DoubleType()), False), T.StructField("probes", T.IntegerType(), False)])
BLOCKS = "shard string, term string, n long, windows binary, counts binary, max_tf binary, min_dl binary, places binary, tf binary, bucket int"
SHARDS = "shard string, n long, tokens long, ids binary, lengths binary"
GRAPHS = "shard string, dims int, n long, ef int, ids binary, nodes binary, vectors binary, links binary, entries binary"
TERM_VECTORS = "feature int, idf double, vector array<double>"
POSITIONS = "term string, chunk_index long, positions array<int>"
HITS = T.StructType(
    [
        T.StructField("query_id", T.LongType(), False),
        T.StructField("chunk_index", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("rank", T.LongType(), False),
    ]
)


@dataclass(frozen=True)
class QueryRequest:
    """One request with its defaults; a null user sees everything, since no tenancy was asked for."""

    query: str
    top_k: int = 5
    threshold: float = 0.5
    max_tokens: int = 512
    user_id: str | None = None
    use_reranker: bool = False

    def __post_init__(self):
        if not isinstance(self.query, str):
            raise TypeError("query must be a string")


@dataclass(frozen=True)
class IngestRequest:
    user_id: str
    documents: tuple[str, ...]


@dataclass(frozen=True)
class IngestResponse:
    chunks_ingested: int
    user_id: str


@dataclass(frozen=True)
class RAGResponse:
    answer: str
    #: The chunks used, as (chunk_index, score).
    sources: tuple[dict, ...] = ()


@dataclass(frozen=True)
class StreamChunk:
    token: str
    is_end: bool = False
