"""Second stage by proximity: how a query's terms stand to each other in a candidate, from an index of positions.

Three shares make a score: of the query's distinct terms that the chunk holds, of its pairs of neighbouring terms that stand
there side by side in order, and of these pairs that stand within ``WINDOW`` tokens of each other in any order. The
weights are those of sequential dependence models. The index has a row for each term of a chunk with the term's places;
a rerank joins it with the terms of its candidates before anything is compared, so only their rows go on.

A query without tokens scores 0 everywhere, one of a single token by the first share alone. Ties go to the earlier candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.operators import lexical
from lodestar.plans.session import broadcast_if_small

#: Tokens within which two terms are near each other, and the weights of the three shares.
WINDOW = 8
TERMS, ORDERED, NEAR = 0.8, 0.1, 0.1
SCORE_DIGITS = 6


def positions(chunks: DataFrame) -> DataFrame:
    """(term, chunk_index, positions) of chunks (chunk_index, text), laid out by term."""
    tokens = lexical.tokenized(chunks.where(F.col("chunk_index").isNotNull()))
    rows = tokens.select("chunk_index", F.posexplode("tokens").alias("pos", "term"))
    rows = rows.groupBy("term", "chunk_index").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return rows.repartitionByRange("term", "chunk_index").sortWithinPartitions("term", "chunk_index")


def _near(places: Column, window: int) -> Column:
    """All places within the window of one of these, themselves left out."""
    steps = F.array(*(F.lit(d) for d in range(-window + 1, window) if d))
    return F.flatten(F.transform(places, lambda p: F.transform(steps, lambda d: p + d)))


def _terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) and, for each two neighbours of a query, (query_id, first, second); both without repeats."""
    tokens = queries.select("query_id", tokenize(F.col("text")).alias("_ts"))
    pairs = F.transform(F.slice("_ts", F.lit(2), F.greatest(F.size("_ts") - 1, F.lit(0))), lambda t, i: F.struct(F.get(F.col("_ts"), i).alias("first"), t.alias("second")))
    return tokens.select("query_id", F.array_distinct("_ts").alias("terms"), F.array_distinct(pairs).alias("pairs"))


def scores(candidates: DataFrame, queries: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(query_id, chunk_index, score) of candidates (query_id, chunk_index), from the index of ``positions``."""
    asked = broadcast_if_small(_terms(queries))
    pairs = candidates.select("query_id", "chunk_index").join(asked, "query_id")
    wanted = pairs.select("query_id", "chunk_index", F.explode("terms").alias("term"))
    # the rows of the candidates' terms: where these are few, the index is read past them and not shuffled
    held = index.join(broadcast_if_small(wanted.select("chunk_index", "term").distinct()), ["chunk_index", "term"], "left_semi")
    found = wanted.join(held, ["chunk_index", "term"]).groupBy("query_id", "chunk_index").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
    known = found.join(asked, "query_id")
    at = lambda t: F.coalesce(F.try_element_at("places", t), F.array().cast("array<int>"))
    ordered = lambda p: F.arrays_overlap(F.transform(at(p["first"]), lambda x: x + 1), at(p["second"]))
    near = lambda p: F.arrays_overlap(_near(at(p["first"]), window), at(p["second"]))
    share = lambda test: F.coalesce(F.size(F.filter("pairs", test)) / F.nullif(F.size("pairs"), F.lit(0)), F.lit(0.0))
    score = TERMS * F.size("places") / F.size("terms") + ORDERED * share(ordered) + NEAR * share(near)
    scored = known.select("query_id", "chunk_index", F.round(score, SCORE_DIGITS).alias("score"))
    return candidates.select("query_id", "chunk_index").join(scored, ["query_id", "chunk_index"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def rerank(candidates: DataFrame, queries: DataFrame, index: DataFrame, k: int = 5, window: int = WINDOW) -> DataFrame:
    """(query_id, chunk_index, score, rank, stage1_pos): the k best candidates (query_id, chunk_index, rank) by proximity."""
    scored = scores(candidates, queries, index, window).join(candidates.select("query_id", "chunk_index", F.col("rank").alias("stage1_pos")), ["query_id", "chunk_index"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "stage1_pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
