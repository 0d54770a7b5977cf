"""Semantic chunking: sentences, boundaries between unlike neighbours, groups, and splits by token count.

An embedder is injected as a function of a sentence column to any column, with a similarity of two such
columns. The built-in pair compares the sets of tokens; a model goes through a pandas UDF that gives vectors,
with ``functions.vector.cosine``.

All of a document lies in one row, so ``semantic_chunks`` with the built-in pair makes its chunks there, by array
functions and without a shuffle. An injected embedder needs a row for each sentence, and its way groups them again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import SLICE_WORDS, split_sentences, tokenize, word_count, word_slices
from lodestar.plans.session import spread

THRESHOLD, MAX_TOKENS = 0.5, 512
SIMILARITY_DIGITS = 9


def token_set(sentence: Column) -> Column:
    return F.array_distinct(tokenize(sentence))


def set_cosine(a: Column, b: Column) -> Column:
    """The cosine of the sets' indicator vectors; 0 where one is empty."""
    size = F.sqrt(F.size(a).cast("double") * F.size(b))
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence)"""
    rows = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def boundaries(
    docs: DataFrame, threshold: float = THRESHOLD, embed: Callable[[Column], Column] = token_set, similarity: Callable[[Column, Column], Column] = set_cosine
) -> DataFrame:
    """(doc_id, pos, sentence, similarity, is_boundary): whether a sentence is less like the one before than the threshold."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = sentences(docs).withColumn("_v", embed(F.col("sentence"))).withColumn("_before", F.lag("_v").over(order))
    rows = rows.withColumn("similarity", F.when(F.col("pos") > 0, F.round(similarity(F.col("_before"), F.col("_v")), SIMILARITY_DIGITS)))
    first = F.col("pos") == 0
    return rows.withColumn("is_boundary", F.coalesce(first | (F.col("similarity") < threshold), first)).drop("_v", "_before")


def groups(bounded: DataFrame) -> DataFrame:
    """(doc_id, grp, sentences, text): runs of sentences from one boundary to the next."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = bounded.withColumn("grp", F.sum(F.col("is_boundary").cast("long")).over(order) - 1)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "sentence")))
    grouped = numbered.groupBy("doc_id", "grp").agg(F.transform(ordered, lambda s: s["sentence"]).alias("sentences"))
    return grouped.withColumn("text", F.array_join("sentences", " "))


def split_by_tokens(parts: Column, max_tokens: int = MAX_TOKENS, count: Callable[[Column], Column] = word_count) -> Column:
    """An array of sentences as chunks of at most ``max_tokens``, filled in order.

    A sentence that alone has more is cut into slices of 64 words; the slices' own counts aren't looked at again.
    """
    counted = F.transform(parts, lambda s: F.struct(s.alias("sentence"), count(s).alias("n")))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).cast("long").alias("n"))

    def flush(state: Column) -> Column:
        return F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(F.array_join(state["open"], " ")))).otherwise(state["done"])

    def step(state: Column, x: Column) -> Column:
        sentence, n = x["sentence"], x["n"].cast("long")
        over = (state["n"] + n > max_tokens) & (F.size(state["open"]) > 0)
        done = F.when(over, flush(state)).otherwise(state["done"])
        kept, held = F.when(over, empty).otherwise(state["open"]), F.when(over, F.lit(0).cast("long")).otherwise(state["n"])
        long = n > max_tokens
        return F.struct(
            F.when(long, F.concat(done, word_slices(sentence, SLICE_WORDS))).otherwise(done).alias("done"),
            F.when(long, kept).otherwise(F.concat(kept, F.array(sentence))).alias("open"),
            F.when(long, held).otherwise(held + n).alias("n"),
        )

    return F.aggregate(counted, start, step, flush)


def local_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, groups): a document's sentences in runs from one boundary to the next, an array of arrays, made in its own row.

    A null, empty or blank text has no groups. Rows that share an id are documents of their own.
    """
    rows = spread(docs.select("doc_id", "text")).select("doc_id", split_sentences(F.col("text")).alias("_s"))
    rows = rows.withColumn("_v", F.transform("_s", token_set))
    unlike = lambda i: F.round(set_cosine(F.get(F.col("_v"), i - 1), F.get(F.col("_v"), i)), SIMILARITY_DIGITS) < threshold
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_b", F.filter(places, lambda i: (i == 0) | unlike(i)))
    run = lambda at, j: F.slice("_s", at + 1, F.coalesce(F.get(F.col("_b"), j + 1), F.size("_s")) - at)
    return rows.select("doc_id", F.transform("_b", run).alias("groups"))


def semantic_chunks(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    max_tokens: int = MAX_TOKENS,
    embed: Callable[[Column], Column] | None = None,
    similarity: Callable[[Column, Column], Column] = set_cosine,
    count: Callable[[Column], Column] = word_count,
) -> DataFrame:
    """(doc_id, pos, text): groups, with those over ``max_tokens`` split."""
    if embed is None:
        found = local_groups(docs, threshold)

        def parts_of(g: Column) -> Column:
            return F.when(count(F.array_join(g, " ")) <= max_tokens, F.array(F.array_join(g, " "))).otherwise(split_by_tokens(g, max_tokens, count))

        rows = found.select("doc_id", F.posexplode(F.flatten(F.transform("groups", parts_of))).alias("pos", "text"))
        return rows.withColumn("pos", F.col("pos").cast("long"))
    found = groups(boundaries(docs, threshold, embed, similarity))
    parts = F.when(count(F.col("text")) <= max_tokens, F.array("text")).otherwise(split_by_tokens(F.col("sentences"), max_tokens, count))
    rows = found.select("doc_id", "grp", F.posexplode(parts).alias("_i", "text"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("grp", "_i")).cast("long") - 1
    return rows.select("doc_id", pos.alias("pos"), "text")
