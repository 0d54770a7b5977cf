"""Lexical search: BM25 with a lower bound on term weight (delta), over index tables.

The index is four tables: postings, doc_stats, term_stats, corpus_stats. A posting has its chunk's length, and
postings are stored in order of their terms, so a search reads those of its own terms and nothing else: the terms of
up to ``FILTER_TERMS`` reach the scan as a filter, more are joined before anything is grouped. Document frequencies are
counted on these postings. ``search_texts`` does the same straight from texts and tokenizes each text once: within
tenants the queries' terms are joined to the token stream before anything is grouped, and a row of its own for each chunk
carries the corpus statistics; without tenants ``block_max`` searches blocks that are made for the queries' terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.plans.session import broadcast_if_small, materialized, spread

K1, B, DELTA = 1.5, 0.75, 1.0
#: Scores are rounded to this many digits before they are ranked, so that ties don't depend on summation order.
SCORE_DIGITS = 6
#: Terms that are sent to the scan as a filter.
FILTER_TERMS = 2000


def tokenized(chunks: DataFrame) -> DataFrame:
    """(chunk_index, tokens)"""
    return spread(chunks.select("chunk_index", "text")).select("chunk_index", tokenize(F.col("text")).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_index", F.explode("tokens").alias("term")).groupBy("term", "chunk_index").agg(F.count(F.lit(1)).alias("tf"))


def counted_postings(tokens: DataFrame) -> DataFrame:
    """Postings with the length of their chunk, in no order, written once: layout and statistics read them several times."""
    rows = tokens.select("chunk_index", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return materialized(rows.groupBy("term", "chunk_index").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), "postings")


def chunk_postings(tokens: DataFrame) -> DataFrame:
    """Postings with the length of their chunk, of chunks whose ids are unique: counted in the chunk's own row, without a shuffle."""
    rows = tokens.select("chunk_index", F.sort_array("tokens").alias("_t"))
    places = F.when(F.size("_t") > 0, F.sequence(F.lit(0), F.size("_t") - 1)).otherwise(F.array().cast("array<int>"))
    # where the sorted tokens change
    rows = rows.withColumn("_b", F.filter(places, lambda i: (i == 0) | (F.get(F.col("_t"), i) != F.get(F.col("_t"), i - 1))))
    run = lambda at, j: F.struct(F.get(F.col("_t"), at).alias("term"), (F.coalesce(F.get(F.col("_b"), j + 1), F.size("_t")) - at).cast("long").alias("tf"))
    rows = rows.select("chunk_index", F.size("_t").cast("long").alias("dl"), F.explode(F.transform("_b", run)).alias("_p"))
    return rows.select("_p.term", "chunk_index", "_p.tf", "dl")


def laid_out(rows: DataFrame) -> DataFrame:
    """Postings in order of their terms."""
    return rows.repartitionByRange("term", "chunk_index").sortWithinPartitions("term", "chunk_index")


def index_postings(tokens: DataFrame) -> DataFrame:
    """Postings with the length of their chunk, laid out by term."""
    return laid_out(counted_postings(tokens))


def doc_stats(tokens: DataFrame) -> DataFrame:
    return tokens.select("chunk_index", F.size("tokens").cast("long").alias("dl"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row (n, avg_dl); avg_dl is 1.0 for an empty corpus."""
    return stats.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def term_stats(posts: DataFrame, corpus: DataFrame) -> DataFrame:
    counts = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.crossJoin(F.broadcast(corpus)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a repeated term counts each time."""
    terms = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def weight(tf: Column, dl: Column, avg_dl: Column, idf_: Column, k1: float = K1, b: float = B, delta: float = DELTA) -> Column:
    return idf_ * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl)) + delta)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score; ties to the larger chunk_index."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("chunk_index"))
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame) -> LexicalIndex:
        tokens = tokenized(chunks)
        counted, docs = counted_postings(tokens), materialized(doc_stats(tokens), "doc-stats")
        corpus = corpus_stats(docs)
        return cls(laid_out(counted), docs, term_stats(counted, corpus), corpus)

    def tables(self) -> dict[str, DataFrame]:
        return {"postings": self.postings, "doc_stats": self.doc_stats, "term_stats": self.term_stats, "corpus_stats": self.corpus_stats}

    def search(self, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, delta: float = DELTA, owners: DataFrame | None = None) -> DataFrame:
        """(query_id, chunk_index, score, rank); chunks that share no term with a query aren't hits.

        With ``owners`` (chunk_index, tenant) each of the ``queries`` sees its own tenant's chunks only. Without, no row is
        made for each pair of a query and a chunk, see ``posting_search``.
        """
        if owners is None:
            from lodestar.operators import posting_search

            return posting_search.search(self, queries, k, k1, b, delta)
        terms = query_terms(queries)
        wanted = [r["term"] for r in terms.select("term").distinct().limit(FILTER_TERMS + 1).collect()]
        posts = self.postings
        posts = posts.where(F.col("term").isin(wanted)) if len(wanted) <= FILTER_TERMS else posts.join(broadcast_if_small(terms.select("term").distinct()), "term")
        counts = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = posts.join(broadcast_if_small(counts), "term").crossJoin(F.broadcast(self.corpus_stats))  # one row
        known = known.withColumn("idf", idf(F.col("n"), F.col("df"))).join(owners.select("chunk_index", "tenant"), "chunk_index")
        return ranked(_scores(_asked(known, queries, terms), k1, b, delta), k)


def _asked(posts: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings beside the queries of the same tenant that ask for their terms."""
    owned = terms.join(queries.select("query_id", "tenant"), "query_id")
    return posts.join(broadcast_if_small(owned), ["term", "tenant"])


def _scores(found: DataFrame, k1: float, b: float, delta: float) -> DataFrame:
    w = weight(F.col("tf"), F.col("dl"), F.col("avg_dl"), F.col("idf"), k1, b, delta)
    return found.groupBy("query_id", "chunk_index").agg(F.round(F.sum(F.col("qtf") * w), SCORE_DIGITS).alias("score"))


def search_texts(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, delta: float = DELTA, within: bool = False) -> DataFrame:
    """The same hits straight from texts, without a stored index; frequencies are made for the queries' terms only.

    Without tenants this is ``block_max``, whose queries end early. With ``within`` each query sees the chunks of its own
    tenant only; frequencies are those of all chunks.
    """
    if not within:
        from lodestar.operators import block_max

        return block_max.search_texts(chunks, queries, k, k1, b, delta)
    terms = query_terms(queries)
    # no token is empty: one row for each chunk, for the statistics
    wanted = broadcast_if_small(terms.select("term").distinct().union(queries.sparkSession.createDataFrame([("",)], "term string")))
    tokens = tokenized(chunks).select("chunk_index", F.size("tokens").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("term"))
    posts = tokens.join(wanted, "term").groupBy("chunk_index", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    posts = materialized(posts, "postings")
    n, total = posts.where("term = ''").agg(F.count(F.lit(1)), F.sum("dl")).first()
    posts = posts.where("term <> ''")
    counts = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = posts.join(broadcast_if_small(counts.select("term", idf(F.lit(n), F.col("df")).alias("idf"))), "term")
    known = known.withColumn("avg_dl", F.lit((total or 0) / n if n else 1.0))
    known = known.join(chunks.select("chunk_index", "tenant"), "chunk_index")
    return ranked(_scores(_asked(known, queries, terms), k1, b, delta), k)


class NotIndexedError(RuntimeError):
    pass


def load_index(spark: SparkSession, folder: str) -> LexicalIndex:
    """The stored index of ``sources.index_store``; an error that says so if there is none."""
    from lodestar.sources.index_store import read_tables

    tables = read_tables(spark, folder)
    if tables is None:
        raise NotIndexedError(f"not indexed: no manifest in {folder}")
    return LexicalIndex(**{name: tables[name] for name in ("postings", "doc_stats", "term_stats", "corpus_stats")})
