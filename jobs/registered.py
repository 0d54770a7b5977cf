"""The jobs as registered queries: each runs its job twice into a new folder and returns the whole output, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest_documents as ingest
from jobs import retrieval_report as report
from lodestar.plans import catalog
from lodestar.plans.session import scratch


def job1_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store that two runs of the ingest leave; the second finds nothing new."""
    folder = scratch(spark, "job1")
    # a pattern of one name: the table may be a folder or a single file, which a file stream takes by a pattern only
    documents = f"{sf_dir}/documents.parque[t]"
    for _ in range(2):
        ingest.ingest_documents(spark, documents, f"{folder}/store", f"{folder}/checkpoint", catalog.CHUNK_THRESHOLD, catalog.CHUNK_TOKENS)
    return ingest.whole_output(spark, f"{folder}/store")


_JOB1_SQL = f"""
WITH RECURSIVE {catalog._BOUNDARIES},
src AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id, grp ORDER BY pos) AS i, sentence FROM gr), {catalog._fold("src")},
own AS (SELECT doc_id, coalesce(nullif(source, ''), '{ingest.NO_TENANT}') AS tenant FROM documents WHERE doc_id IS NOT NULL),
ck AS (
  SELECT tenant, ch.doc_id, (row_number() OVER (PARTITION BY ch.doc_id ORDER BY grp, chunk) - 1)::BIGINT AS pos, text, {catalog._tokens("text")} AS ts
  FROM ch JOIN own ON own.doc_id = ch.doc_id
),
tm AS (SELECT tenant, doc_id, pos, unnest(ts) AS term FROM ck),
tf AS (SELECT tenant, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf FROM (SELECT tenant, doc_id, pos, term, count(*) AS tf FROM tm GROUP BY ALL) GROUP BY tenant, term)
SELECT 'chunk' AS kind, tenant, doc_id, pos, text, len(ts)::BIGINT AS n_tokens, NULL::BIGINT AS df, NULL::BIGINT AS n_docs, NULL::BIGINT AS n_chunks FROM ck
UNION ALL SELECT 'term', tenant, NULL, NULL, term, tf, df, NULL, NULL FROM tf
UNION ALL SELECT 'tenant', tenant, NULL, NULL, NULL, coalesce(sum(len(ts)), 0)::BIGINT, NULL, count(DISTINCT own.doc_id)::BIGINT, count(ck.doc_id)::BIGINT FROM own LEFT JOIN ck USING (tenant, doc_id) GROUP BY tenant
"""


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report that two runs over the same tables leave; the second replaces the first's rows by the same."""
    folder = scratch(spark, "job2")
    paths = [f"{sf_dir}/{name}.parquet" for name in ("documents", "embeddings", "benchmark", "labels")]
    for _ in range(2):
        report.retrieval_report(spark, *paths, folder, k=catalog.EVAL_K, recall_k=catalog.RECALL_K)
    return report.whole_output(spark, folder)


def _strategy_sql(name: str, source: str) -> str:
    """CTEs for one strategy: its hits with relevance, and its metrics for each question."""
    p, gain = f"s_{name}", catalog._GAIN
    return f"""
{p}_h AS (SELECT h.q, h.ci, h.rank, coalesce(qr.rel, 0)::DOUBLE AS rel FROM {source} h LEFT JOIN qr ON qr.q = h.q AND qr.ci = h.ci WHERE h.rank <= {catalog.EVAL_K}),
{p}_d AS (SELECT q, count(*)::BIGINT AS n_hits, sum({gain}) AS d, count(*) FILTER (rel > 0) AS found, min(rank) FILTER (rel > 0) AS first FROM {p}_h GROUP BY q),
{p}_m AS (
  SELECT '{name}' AS strategy, q, coalesce(n_hits, 0)::BIGINT AS n_hits, round(coalesce(found / nullif(n_relevant, 0)::DOUBLE, 0.0), 6) AS recall,
    round(coalesce(1.0::DOUBLE / first, 0.0), 6) AS rr, round(coalesce(d / nullif(ideal, 0), 0.0), 6) AS ndcg
  FROM {p}_d FULL JOIN ideals USING (q)
)"""


_FROM = {"dense": "de", "lexical": "bm", "hybrid": "fu", "reranked": "re"}
_HITS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS strategy, * FROM s_{n}_h" for n in _FROM)
_METRICS_SQL = " UNION ALL ".join(f"SELECT * FROM s_{n}_m" for n in _FROM)
_JOB2_SQL = f"""
{catalog._HYBRID}, {catalog._rrf("bm", "de", catalog.RECALL_K, True)}, {catalog._reranked("fu", catalog.EVAL_K)}, {catalog._QRELS},
best AS (SELECT q, ci, rel, row_number() OVER (PARTITION BY q ORDER BY rel DESC) AS rank FROM qr),
ideals AS (SELECT q, sum({catalog._GAIN}) FILTER (rank <= {catalog.EVAL_K}) AS ideal, count(DISTINCT ci) FILTER (rel > 0) AS n_relevant FROM best GROUP BY q),
{", ".join(_strategy_sql(*x) for x in _FROM.items())},
hs AS ({_HITS_SQL}), ms AS ({_METRICS_SQL})
SELECT 'hit' AS kind, strategy, q AS query_id, ci AS chunk_index, rank::BIGINT AS rank, rel, NULL::BIGINT AS n_hits, NULL::DOUBLE AS recall, NULL::DOUBLE AS rr,
  NULL::DOUBLE AS ndcg, NULL::DOUBLE AS baseline_ndcg, NULL::VARCHAR AS change FROM hs
UNION ALL SELECT 'metric', strategy, q, NULL, NULL, NULL, n_hits, recall, rr, ndcg, NULL, NULL FROM ms
UNION ALL SELECT 'change', m.strategy, m.q, NULL, NULL, NULL, NULL, NULL, NULL, m.ndcg, b.ndcg, CASE WHEN m.ndcg > b.ndcg THEN 'better' WHEN m.ndcg < b.ndcg THEN 'worse' ELSE 'same' END
FROM ms m JOIN ms b ON b.q = m.q AND b.strategy = 'dense'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest_documents, job2_retrieval_report)}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest_documents": _JOB1_SQL, "job2_retrieval_report": _JOB2_SQL}
