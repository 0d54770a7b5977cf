"""A corpus pipeline of stages, each an operator of ``lodestar.llm``: (name, function of (spark, docs, sf_dir)).

All stages but the last return the columns of ``documents``; where a stage changes a text, n_chars follows it.

Null and empty texts have no words and go with the first stage. Rows whose id is null can't be named: they pass the
stages that compare documents as they are. Rows that share an id are one document: they stay or go together, so
rows that agree in id and text both stay, and each is cut by its own text. No rows give no rows. Other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, ngram_join, packing, quality_rules, substring_dedup
from lodestar.llm.common import stored, table
from lodestar.llm.tokens import default_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go."""
    return quality_rules.quality_filter(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: chunks of lines that occurred before are cut out."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", _length()).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of documents joined by links the smallest id stays, with all its rows."""
    found = ngram_join.ngram_jaccard_join(docs)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated paragraphs and passages are cut out."""
    return substring_dedup.substring_dedup(docs).withColumn("n_chars", _length()).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of documents laid out in windows."""
    return packing.pack_documents(docs, default_path("byte_bpe_50k.json"))


def _length():
    return F.coalesce(F.char_length("text"), F.lit(0)).cast("long")


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]
#: SQL has no way to say hashes of shingles, components or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what a stage returns is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
