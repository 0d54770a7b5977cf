"""Keeps a chunk store and its term statistics current as document files arrive.

A file stream takes the Parquet files (doc_id, source, text) of a folder, or of a pattern of paths, that its checkpoint doesn't know yet, up to
``files_per_batch`` at a time, and ends when all present are done. A batch of documents becomes a folder
``batch=N`` in each of three tables below ``output``:

* ``chunks`` (tenant, doc_id, pos, text, n_tokens), in folders by tenant: what a retriever searches;
* ``terms`` (tenant, term, df, tf), in folders by tenant: what the batch adds to each term's frequencies;
* ``ledger`` (doc_id, tenant, n_chunks, n_tokens): which documents it took in, those without chunks too.

Statistics are sums over batches, so they never have to be counted anew: ``statistics`` adds up the terms, ``tenants``
the ledger. The ledger is written last, and readers take the batches that it has, so a batch counts whole or
not at all. A batch that is run again after a failure has the same files, sees the same earlier batches, and overwrites its
own folders: the result is the same. A run without new files changes nothing.

A document is taken in once: one whose id an earlier batch has is left out, and of rows of one batch that share an id
the one with the least text (nulls last), and then the least tenant, stands. Rows without an id are left out. A null or
empty source is the tenant ``(none)``. Null and empty texts have no chunks. Other columns are ignored.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import prepared, read, run_from_command_line
from lodestar.functions.text import tokenize
from lodestar.operators.chunking import semantic_chunks
from lodestar.plans.session import broadcast_if_small, materialized

log = logging.getLogger("ingest_documents")

NO_TENANT = "(none)"
CHUNKS = "doc_id long, pos long, text string, n_tokens long, batch long, tenant string"
TERMS = "term string, df long, tf long, batch long, tenant string"
LEDGER = "doc_id long, tenant string, n_chunks long, n_tokens long, batch long"
COUNTS = ("rows_read", "documents", "chunks", "tokens")


def new_documents(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, tenant, text): one row for each id that the ledger doesn't have."""
    tenant = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(NO_TENANT))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), tenant.alias("tenant"), "text")
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"), "tenant")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    # the ledger is read past the batch's ids, not shuffled, where these are few
    known = ledger.select("doc_id").join(broadcast_if_small(rows.select("doc_id")), "doc_id", "left_semi")
    return rows.join(known, "doc_id", "left_anti")


def term_counts(chunks: DataFrame) -> DataFrame:
    """(tenant, term, df, tf) of chunks (tenant, text): in how many a term occurs, and how often.

    A chunk's tokens are sorted and their first occurrences marked in the row, so one aggregation gives both counts.
    """
    tokens = chunks.select("tenant", F.array_sort(tokenize(F.col("text"))).alias("_ts"))
    marked = F.transform("_ts", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get(F.col("_ts"), i - 1) != t)).alias("first")))
    rows = tokens.select("tenant", F.explode(marked).alias("_t")).select("tenant", "_t.*")
    return rows.groupBy("tenant", "term").agg(F.count_if("first").alias("df"), F.count(F.lit(1)).alias("tf"))


def ingest_batch(docs: DataFrame, batch: int, output: str, threshold: float, max_tokens: int) -> dict[str, int]:
    """Takes a batch's new documents into the three tables, the ledger last; returns what it read and wrote."""
    spark = docs.sparkSession
    earlier = read(spark, f"{output}/ledger", LEDGER).where(F.col("batch") < batch)
    new = materialized(new_documents(docs, earlier), "new-documents")
    named = new.select(F.struct("doc_id", "tenant").alias("doc_id"), "text")
    found = semantic_chunks(named, threshold, max_tokens).select("doc_id.doc_id", "doc_id.tenant", "pos", "text", F.size(tokenize(F.col("text"))).cast("long").alias("n_tokens"))
    # rebalance: one tenant may have a third of all rows, whose folder several tasks then write
    found.hint("rebalance", "tenant").write.mode("overwrite").partitionBy("tenant").parquet(f"{output}/chunks/batch={batch}")
    chunks = read(spark, f"{output}/chunks", CHUNKS).where(F.col("batch") == batch)
    term_counts(chunks).hint("rebalance", "tenant").write.mode("overwrite").partitionBy("tenant").parquet(f"{output}/terms/batch={batch}")
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    none = F.lit(0).cast("long")
    taken = new.join(counts, "doc_id", "left").select("doc_id", "tenant", F.coalesce("n_chunks", none).alias("n_chunks"), F.coalesce("n_tokens", none).alias("n_tokens"))
    taken.write.mode("overwrite").parquet(f"{output}/ledger/batch={batch}")
    wrote = read(spark, f"{output}/ledger", LEDGER).where(F.col("batch") == batch).agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chunks"), none), F.coalesce(F.sum("n_tokens"), none)).first()
    done = dict(zip(COUNTS, (docs.count(), *wrote), strict=True))
    log.info("batch %d: %s", batch, done)
    return done


def _of_whole_batches(spark: SparkSession, output: str, name: str, schema: str) -> DataFrame:
    """A table's rows of the batches that the ledger has: a short list, whose folders alone are read."""
    batches = [r["batch"] for r in read(spark, f"{output}/ledger", LEDGER).select("batch").distinct().collect()]
    return read(spark, f"{output}/{name}", schema).where(F.col("batch").isin(batches))


def chunks(spark: SparkSession, output: str) -> DataFrame:
    """(tenant, doc_id, pos, text, n_tokens); a filter on the tenant reads its folders only."""
    return _of_whole_batches(spark, output, "chunks", CHUNKS).drop("batch")


def statistics(spark: SparkSession, output: str) -> DataFrame:
    """(tenant, term, df, tf)"""
    return _of_whole_batches(spark, output, "terms", TERMS).groupBy("tenant", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def tenants(spark: SparkSession, output: str) -> DataFrame:
    """(tenant, n_docs, n_chunks, n_tokens): with ``statistics`` all that lexical weights need."""
    ledger = read(spark, f"{output}/ledger", LEDGER)
    return ledger.groupBy("tenant").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))


def whole_output(spark: SparkSession, output: str) -> DataFrame:
    """All three as one table: ``kind`` is chunk, term or tenant."""
    text, number = F.lit(None).cast("string"), F.lit(None).cast("long")
    parts = [
        chunks(spark, output).select(F.lit("chunk").alias("kind"), "tenant", "doc_id", "pos", "text", "n_tokens", number.alias("df"), number.alias("n_docs"), number.alias("n_chunks")),
        statistics(spark, output).select(F.lit("term"), "tenant", number, number, "term", "tf", "df", number, number),
        tenants(spark, output).select(F.lit("tenant"), "tenant", number, number, text, "n_tokens", number, "n_docs", "n_chunks"),
    ]
    return parts[0].union(parts[1]).union(parts[2])


def ingest_documents(spark: SparkSession, documents: str, output: str, checkpoint: str, threshold: float = 0.1, max_tokens: int = 128, files_per_batch: int = 500) -> dict[str, int]:
    """Takes in the documents of the files that are new; returns how many batches there were, rows read, and what was written."""
    for name, schema, folders in (("chunks", CHUNKS, ("batch", "tenant")), ("terms", TERMS, ("batch", "tenant")), ("ledger", LEDGER, ("batch",))):
        prepared(spark, f"{output}/{name}", schema, *folders)
    schema = spark.read.parquet(documents).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(documents)

    done = dict.fromkeys(("batches", *COUNTS), 0)

    def each(docs: DataFrame, batch: int) -> None:
        for name, n in ({"batches": 1} | ingest_batch(docs, batch, output, threshold, max_tokens)).items():
            done[name] += n

    query = stream.select("doc_id", "source", "text").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s, wrote %s: %s", documents, output, done)
    return done


if __name__ == "__main__":
    run_from_command_line(ingest_documents, ("documents", "output", "checkpoint"))
