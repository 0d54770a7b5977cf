"""Greedy packing of ranked chunks into a token budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import word_count

CONTEXT_WINDOW, MAX_GENERATION = 8192, 512


def fold(ranked: Column, available: Column) -> Column:
    """The elements of an array of structs with ``cost`` that fit, each being taken if it still fits, else passed over."""
    none = F.filter(ranked, lambda _: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("used"), none.alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = state["used"] + x["cost"] <= available
        return F.struct(
            F.when(fits, state["used"] + x["cost"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"),
        )

    return F.when(available > 0, F.aggregate(ranked, start, step, lambda s: s["kept"])).otherwise(none)


def pack(
    candidates: DataFrame,
    queries: DataFrame,
    chunks: DataFrame,
    system: str,
    window: int = CONTEXT_WINDOW,
    max_generation: int = MAX_GENERATION,
    overhead: int = 0,
    count: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """(query_id, query, available, n_candidates, kept): chunks by score, ties by rank, that fit the budget.

    The budget is the window less system text, query, generation and ``overhead``. A query's array holds its own
    candidates, at most as many as were retrieved. A query without candidates keeps an empty array.
    """
    asked = queries.select("query_id", F.col("text").alias("query"))
    available = F.lit(window - max_generation - overhead) - count(F.lit(system)) - count(F.col("query"))
    rows = chunks.select("chunk_index", "text").join(candidates, "chunk_index")
    x = F.struct((-F.col("score")).alias("order"), "rank", "chunk_index", "score", "text", count(F.col("text")).alias("cost"))
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(x)).alias("ranked"))
    both = asked.join(grouped, "query_id", "left").withColumn("available", available.cast("long"))
    kept = F.when(F.col("ranked").isNotNull(), fold(F.col("ranked"), F.col("available")))
    return both.select("query_id", "query", "available", F.coalesce(F.size("ranked"), F.lit(0)).cast("long").alias("n_candidates"), kept.alias("kept"))
