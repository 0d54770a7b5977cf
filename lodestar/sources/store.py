"""A stored corpus: ingest of documents, deletion of a tenant, compaction, restore after a restart.

Ingest chunks the documents, numbers the chunks on from the highest id ever given, and appends chunks, postings,
lengths and (with an embedder) vectors as one part, so it costs what the new documents cost. Document
frequencies and the average length are global and made from the stored parts when the index is opened.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.operators.chunking import MAX_TOKENS, THRESHOLD, semantic_chunks
from lodestar.operators.vector_index import VectorIndex
from lodestar.plans.session import discard, materialized
from lodestar.sources import index_store, registry


@dataclass(frozen=True)
class Corpus:
    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame | None
    vector_index: VectorIndex | None = None


def restore(spark: SparkSession, folder: str) -> Corpus | None:
    """The stored corpus; None where nothing was ingested yet."""
    tables = index_store.read_tables(spark, folder)
    if tables is None:
        return None
    corpus = lexical.corpus_stats(tables["doc_stats"])
    index = lexical.LexicalIndex(tables["postings"], tables["doc_stats"], lexical.term_stats(tables["postings"], corpus), corpus)
    near = VectorIndex(tables["centroids"], tables["vectors"]) if "centroids" in tables else None
    vectors = tables["vectors"].select("chunk_index", "embedding") if "vectors" in tables else None
    return Corpus(tables["chunks"], index, vectors, near)


def ingest(
    docs: DataFrame,
    folder: str,
    embed: Callable[[Column], Column] | None = None,
    threshold: float = THRESHOLD,
    max_tokens: int = MAX_TOKENS,
    created_at: Column | None = None,
) -> int:
    """Adds the documents (doc_id, tenant, text); returns how many chunks they gave. Without chunks nothing is written."""
    spark = docs.sparkSession
    before = index_store.current(spark, folder)
    start = before.next_index if before else 0
    # the tenant travels with the text, so an id that occurs twice in a batch gives each row's chunks once
    rows = docs.select(F.struct("doc_id", "tenant", F.monotonically_increasing_id().alias("row")).alias("doc_id"), "text")
    found = semantic_chunks(rows, threshold, max_tokens).select("doc_id.doc_id", "doc_id.tenant", "doc_id.row", "pos", "text")
    # evaluates the rows once, so each keeps the number that it has there
    numbered = registry.numbered(found, "doc_id", ["row", "pos"], start)
    n = numbered.count()
    if not n:
        discard(numbered)
        return 0
    created = F.current_timestamp() if created_at is None else created_at
    chunks = numbered.select("chunk_index", "tenant", "text", created.cast("timestamp").alias("created_at"))
    # the chunks are written once, to the part itself; no version names it yet
    part, new = index_store.begin_part("chunks", chunks, folder)
    discard(numbered)
    tokens = lexical.tokenized(new)
    postings = materialized(lexical.chunk_postings(tokens), "postings")
    tables = {"postings": lexical.laid_out(postings), "doc_stats": lexical.doc_stats(tokens)}
    if embed is not None:
        vectors = materialized(new.select("chunk_index", embed(F.col("text")).cast("array<float>").alias("embedding")), "vectors")
        stored = restore(spark, folder)
        known = stored.vector_index if stored else None
        tables |= {"vectors": known.added(vectors)} if known else VectorIndex.build(vectors).tables()
    # ids were given on from this version, so no other may have come in between
    index_store.write_tables(tables, folder, append=True, next_index=start + n, expected=before.version if before else 0, part=part)
    discard(postings)
    return n


def delete_tenant(spark: SparkSession, folder: str, tenant: str) -> int:
    """Takes a tenant's chunks out of every table; returns how many there were. Their ids aren't given again.

    Only the ids are written; the rows stay on disk, unseen, until ``compact`` and then ``index_store.purge``.
    """
    found = index_store.current(spark, folder)
    if found is None:
        return 0
    chunks = index_store.read_tables(spark, folder, found)["chunks"]
    gone = chunks.where(F.col("tenant") == tenant).select("chunk_index")
    n = gone.count()
    if n:
        index_store.delete_rows(gone, folder, found.version)
    return n


def compact(spark: SparkSession, folder: str, small_bytes: int = index_store.SMALL_PART, lost_share: float = 0.2) -> int:
    """Merges small parts and those that have lost many rows; returns how many were replaced. Searches give the same."""
    return index_store.compact(spark, folder, small_bytes, lost_share)
