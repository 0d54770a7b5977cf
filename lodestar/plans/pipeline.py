"""The retrieval pipeline: two-stage retrieval, budget packing and prompt, for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.prompt import SYSTEM_PROMPT, build_prompt
from lodestar.functions.text import word_count
from lodestar.operators import budget, dense, fusion, lexical
from lodestar.operators.rerank import Scorer, lexical_score, rerank

RECALL_K = 50


@dataclass(frozen=True)
class Retriever:
    """Chunks (chunk_index, tenant, text) and vectors (chunk_index, embedding), with what a search needs."""

    chunks: DataFrame
    vectors: DataFrame
    scorer: Scorer = lexical_score
    recall_k: int = RECALL_K
    rrf_k: int = fusion.RRF_K
    #: post: tenants are filtered after each list's cut; pre: before it.
    tenancy: str = "post"
    threshold: float | None = None
    index: lexical.LexicalIndex | None = None

    def candidates(self, queries: DataFrame) -> DataFrame:
        """Stage 1: (query_id, chunk_index, score, rank) for queries (query_id, text, embedding, tenant)."""
        if self.tenancy not in ("post", "pre"):
            raise ValueError("tenancy must be 'post' or 'pre'")
        if self.tenancy == "post":
            lists = [fusion.visible(hits, queries, self.chunks) for hits in (self._lexical(queries), self._dense(queries))]
        else:  # a query with a tenant meets the chunks of that tenant only, the others meet all
            owned, others = queries.where(F.col("tenant").isNotNull()), queries.where(F.col("tenant").isNull())
            lists = [f(owned, True).unionByName(f(others)) for f in (self._lexical, self._dense)]
        return fusion.rrf(lists, self.recall_k, self.rrf_k, self.chunks)

    def _lexical(self, queries: DataFrame, within: bool = False) -> DataFrame:
        if self.index:
            return self.index.search(queries, self.recall_k, owners=self.chunks if within else None)
        return lexical.search_texts(self.chunks, queries, self.recall_k, within=within)

    def _dense(self, queries: DataFrame, within: bool = False) -> DataFrame:
        asked = queries.where(F.col("embedding").isNotNull())
        vectors = self.vectors.join(self.chunks.select("chunk_index", "tenant"), "chunk_index") if within else self.vectors
        return dense.search(vectors, asked, self.recall_k, self.threshold, within=within)

    def retrieve(self, queries: DataFrame, k: int = 5, use_reranker: bool = True) -> DataFrame:
        """The k best of stage 2, or without it of stage 1; what isn't asked for isn't in the plan."""
        found = self.candidates(queries)
        if not use_reranker:
            return found.where(F.col("rank") <= k)
        return rerank(found, queries, self.chunks, k, self.scorer).drop("stage1_pos")


def answer_prompts(
    retriever: Retriever | None,
    queries: DataFrame,
    k: int = 5,
    use_reranker: bool = False,
    system: str = SYSTEM_PROMPT,
    window: int = budget.CONTEXT_WINDOW,
    max_generation: int = budget.MAX_GENERATION,
    template: str = "chatml",
    count=word_count,
) -> DataFrame:
    """(query_id, prompt, chunks_used, n_retrieved, n_used, prompt_tokens); without a retriever the context is empty."""
    if retriever is None:
        rows = queries.select("query_id", F.col("text").alias("query"), F.lit(0).cast("long").alias("n_candidates"), F.lit(None).alias("kept"))
        texts = F.array().cast("array<string>")
        used = F.array().cast("array<struct<chunk_index: bigint, score: double>>")
    else:
        found = retriever.retrieve(queries, k, use_reranker)
        rows = budget.pack(found, queries, retriever.chunks, system, window, max_generation, count=count)
        kept = F.coalesce(F.col("kept"), F.filter(F.col("kept"), lambda _: F.lit(True)))
        texts = F.coalesce(F.transform(kept, lambda c: c["text"]), F.array().cast("array<string>"))
        used = F.transform(kept, lambda c: F.struct(c["chunk_index"].alias("chunk_index"), c["score"].alias("score")))
    prompt = build_prompt(F.lit(system), F.col("query"), texts, template)
    out = rows.select("query_id", prompt.alias("prompt"), used.alias("chunks_used"), F.col("n_candidates").alias("n_retrieved"), F.size(texts).cast("long").alias("n_used"))
    return out.withColumn("prompt_tokens", count(F.col("prompt")))
