"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, chat_format, hard_negatives, license_scan, line_dedup, ngram_join, packing, quality_rules, substring_dedup, token_files, topk_search, url_filter
from lodestar.llm.common import table
from lodestar.llm.tokens import default_path


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_words", "n_removed_words", "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = default_path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), end_id=2, with_ids=False)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_judgements(table(spark, sf_dir, "documents")).drop("rejected_by")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", "text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), end_id=0)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_substring_dedup,
        op2_byte_bpe,
        op3_exact_topk,
        op4_token_files,
        op5_url_filter,
        op6_quality_rules,
        op7_ngram_jaccard_join,
        op8_line_dedup,
        op9_chat_format,
        op10_packing,
        op11_hard_negatives,
        op12_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_topk": topk_search.ORACLE_SQL,
        "op5_url_filter": url_filter.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op7_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op8_line_dedup": line_dedup.ORACLE_SQL,
        "op11_hard_negatives": hard_negatives.ORACLE_SQL,
        "op12_license_scan": license_scan.ORACLE_SQL,
    }
