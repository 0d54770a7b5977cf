"""Streaming ingest: each micro-batch of documents is chunked and appended to stored tables.

Appends are by batch id, so a batch that runs again overwrites its own part and nothing else. Postings and
lengths only grow; document frequencies and the average length are global, so they are made from the stored
parts when an index is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators import lexical
from lodestar.operators.chunking import MAX_TOKENS, THRESHOLD, semantic_chunks


def ingest_batch(docs: DataFrame, folder: str, batch_id: int, threshold: float = THRESHOLD, max_tokens: int = MAX_TOKENS) -> None:
    """Chunks of (doc_id, tenant, text), their postings and lengths, as part ``batch_id`` of each table.

    A chunk's id is made of the batch, the document and its position: it needs no count of what came before.
    """
    # the tenant travels with the text; rows of one id are told apart by it and the text
    rows = docs.select(F.struct("doc_id", "tenant", F.xxhash64("text").alias("row")).alias("doc_id"), "text").dropDuplicates()
    chunks = semantic_chunks(rows, threshold, max_tokens).select("doc_id.doc_id", "doc_id.tenant", "doc_id.row", "pos", "text")
    chunk_index = F.xxhash64(F.lit(batch_id), "doc_id", "tenant", "row", "pos")
    chunks = chunks.select(chunk_index.alias("chunk_index"), "doc_id", "pos", "tenant", "text")
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")
    written = docs.sparkSession.read.parquet(f"{folder}/chunks/batch={batch_id}")
    tokens = lexical.tokenized(written)
    lexical.index_postings(tokens).write.mode("overwrite").parquet(f"{folder}/postings/batch={batch_id}")
    lexical.doc_stats(tokens).write.mode("overwrite").parquet(f"{folder}/doc_stats/batch={batch_id}")


def start(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Ingests Parquet files (doc_id, tenant, text) as they appear below ``source``, until all present are done."""
    stream = spark.readStream.schema(schema).parquet(source)
    run = lambda docs, batch_id: ingest_batch(docs, folder, batch_id, **options)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, folder: str) -> lexical.LexicalIndex:
    posts = spark.read.parquet(f"{folder}/postings").select("term", "chunk_index", "tf", "dl")
    docs = spark.read.parquet(f"{folder}/doc_stats").select("chunk_index", "dl")
    corpus = lexical.corpus_stats(docs)
    return lexical.LexicalIndex(posts, docs, lexical.term_stats(posts, corpus), corpus)
