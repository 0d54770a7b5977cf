import pytest

from lodestar.plans import catalog

# Rows only: approximate by design, its recall has a test of its own; times; and a tokenizer's counts.
WITHOUT_SQL = {"ann_topk", "graph_topk", "text_hybrid_topk", "ablation_latency", "subword_budget"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, same_as_sql):
    same_as_sql(catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "chunk_index", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
