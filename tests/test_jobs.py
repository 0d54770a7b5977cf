"""The jobs: against their SQL, run again over growing input, after a failure, and on odd rows."""

import json
import os
import re
import subprocess
import sys

import pytest

from jobs import ingest_documents as ingest
from jobs import registered
from jobs import retrieval_report as report

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id long, source string, text string, rank int"


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_job_matches_sql(name, same_as_sql):
    same_as_sql(registered.queries()[name], registered.oracle_sql()[name])


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def deliver(spark, folder, rows):
    spark.createDataFrame([(*r, 1) for r in rows], DOCS).coalesce(1).write.mode("append").parquet(folder)


def some(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "text").orderBy("doc_id").limit(60)
    return [tuple(r) for r in docs.collect()]


@pytest.fixture
def place(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_two_runs_over_growing_input(spark, small, place):
    rows = some(spark, small)
    for part in (rows[:20], rows[20:40]):
        deliver(spark, place("in"), part)
    first = ingest.ingest_documents(spark, place("in"), place("out"), place("mark"), files_per_batch=1)
    assert (first["batches"], first["rows_read"], first["documents"]) == (2, 40, 40)
    # new rows, and two that were there: one as it was, one with another text
    deliver(spark, place("in"), [*rows[40:], rows[3], (rows[5][0], "src9", "Another text.")])
    second = ingest.ingest_documents(spark, place("in"), place("out"), place("mark"), files_per_batch=1)
    assert (second["batches"], second["rows_read"], second["documents"]) == (1, 22, 20)
    found = rows_of(ingest.whole_output(spark, place("out")))
    assert ingest.ingest_documents(spark, place("in"), place("out"), place("mark")) == dict.fromkeys(("batches", *ingest.COUNTS), 0)
    assert rows_of(ingest.whole_output(spark, place("out"))) == found
    deliver(spark, place("in2"), rows)
    ingest.ingest_documents(spark, place("in2"), place("out2"), place("mark2"))
    assert rows_of(ingest.whole_output(spark, place("out2"))) == found


@pytest.mark.parametrize("step", ["semantic_chunks", "term_counts"])
def test_a_batch_that_failed_runs_again(spark, small, place, monkeypatch, step):
    rows = some(spark, small)[:30]
    deliver(spark, place("in"), rows[:15])
    ingest.ingest_documents(spark, place("in"), place("out"), place("mark"))
    before = rows_of(ingest.whole_output(spark, place("out")))
    deliver(spark, place("in"), rows[15:])

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        m.setattr(ingest, step, fail)
        ingest.ingest_documents(spark, place("in"), place("out"), place("mark"))
    # what the dead run left isn't seen
    assert rows_of(ingest.whole_output(spark, place("out"))) == before
    assert ingest.ingest_documents(spark, place("in"), place("out"), place("mark"))["documents"] == 15
    deliver(spark, place("in2"), rows)
    ingest.ingest_documents(spark, place("in2"), place("out2"), place("mark2"))
    assert rows_of(ingest.whole_output(spark, place("out"))) == rows_of(ingest.whole_output(spark, place("out2")))


def test_statistics_as_counted_plainly(spark, place):
    texts = [(1, "01", "The cat sat. The cat ran. A dog barked."), (2, "1", "cat cat dog"), (3, None, "bird"), (4, "", "bird bird"), (5, "x", None), (6, "x", ""), (None, "x", "nobody"), (7, "a/b=c %", "Odd tenant.")]
    texts += [(8, "x", "same id, more"), (8, "x", "same id"), (8, "w", "same id"), (8, "x", None)]
    deliver(spark, place("in"), texts)
    ingest.ingest_documents(spark, place("in"), place("out"), place("mark"), threshold=0.0)
    found = {(r["tenant"], r["term"]): (r["df"], r["tf"]) for r in ingest.statistics(spark, place("out")).collect()}
    assert found["01", "cat"] == (1, 2) and found["01", "the"] == (1, 2) and found["1", "cat"] == (1, 2)
    assert found[ingest.NO_TENANT, "bird"] == (2, 3)
    assert found["w", "same"] == (1, 1) and ("x", "same") not in found and not any(t == "nobody" for _, t in found)
    sizes = {r["tenant"]: (r["n_docs"], r["n_chunks"], r["n_tokens"]) for r in ingest.tenants(spark, place("out")).collect()}
    assert sizes == {"01": (1, 1, 9), "1": (1, 1, 3), ingest.NO_TENANT: (2, 2, 3), "x": (2, 0, 0), "a/b=c %": (1, 1, 2), "w": (1, 1, 2)}


def test_a_tenant_reads_its_own_folders(spark, small, place):
    deliver(spark, place("in"), some(spark, small))
    ingest.ingest_documents(spark, place("in"), place("out"), place("mark"))
    own = ingest.chunks(spark, place("out")).where("tenant = 'src3'")
    assert own.count()
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "tenant" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_no_documents(spark, place):
    deliver(spark, place("in"), [])
    done = ingest.ingest_documents(spark, place("in"), place("out"), place("mark"))
    assert done["documents"] == 0 and ingest.whole_output(spark, place("out")).count() == 0


# The report


def tables(spark, place, docs, vectors, questions, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(place("documents"))
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(place("vectors"))
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(place("questions"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(place("labels"))
    return [place(n) for n in ("documents", "vectors", "questions", "labels")]


def test_report_again_and_in_parts(spark, place):
    docs = [(1, "src1", "red apple pie", 0), (2, "src1", "green apple", 0), (3, "src1", "blue sky", 0), (4, "src2", "apple", 0), (5, "src1", None, 0), (None, "src1", "apple", 0)]
    vectors = [(1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [1.0, 0.0]), (4, None), (21, [1.0, 0.0])]
    paths = tables(spark, place, docs, vectors, [(1, "apple pie"), (21, "green apple"), (41, None), (None, "apple")], [(1, 1), (2, 0), (3, 1), (9, 1), (4, None)])
    done = report.retrieval_report(spark, *paths, place("out"), k=2, recall_k=5)
    found = rows_of(report.whole_output(spark, place("out")))
    assert done["documents_read"] == 6 and done["questions_read"] == 4
    assert report.retrieval_report(spark, *paths, place("out"), k=2, recall_k=5) == done
    assert rows_of(report.whole_output(spark, place("out"))) == found
    # part by part, in another order, to the same end
    for part in (["reranked"], ["lexical", "dense"], ["hybrid"]):
        report.retrieval_report(spark, *paths, place("parts"), part, k=2, recall_k=5)
    assert rows_of(report.whole_output(spark, place("parts"))) == found
    rows = report.read(spark, place("out") + "/metrics", report.METRICS)
    own = {(r["strategy"], r["query_id"]): r for r in rows.collect()}
    assert own["lexical", 1]["recall"] == 0.5 and own["lexical", 1]["rr"] == 1.0
    assert own["dense", 21]["rr"] == 1.0 and own["lexical", 41]["n_hits"] == 0
    change = {(r["strategy"], r["query_id"]): r["change"] for r in report.read(spark, place("out") + "/changes", report.CHANGES).collect()}
    assert change["dense", 1] == "same" and set(change.values()) <= {"better", "worse", "same"}


def test_report_over_emptied_tables_leaves_nothing_old(spark, place, tmp_path):
    docs = [(1, "src1", "red apple", 0)]
    paths = tables(spark, place, docs, [(1, [1.0, 0.0])], [(1, "apple")], [(1, 1)])
    report.retrieval_report(spark, *paths, place("out"))
    assert report.whole_output(spark, place("out")).count() > 0
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(place("documents"))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(place("vectors"))
    report.retrieval_report(spark, *paths, place("out"))
    assert report.whole_output(spark, place("out")).count() == 0
    for wrong in ({"strategies": ["guess"]}, {"strategies": []}, {"baseline": "guess"}):
        with pytest.raises(ValueError, match="strateg"):
            report.retrieval_report(spark, *paths, place("out"), **wrong)


def test_report_broadcasts_no_judgements(spark, place):
    """A few MB of files held millions of judgements, which the driver got once for each strategy and measure."""
    shape = "query_id long, chunk_index long"
    spark.range(1000).selectExpr("id % 10 AS query_id", "id AS chunk_index", "cast(id % 2 AS int) AS rel").write.parquet(place("qrels"))
    spark.createDataFrame([(1, 1, 1, "dense"), (1, 2, 2, "dense"), (1, 11, 1, "lexical")], f"{shape}, rank long, strategy string").write.parquet(place("found"))
    qrels, found = (spark.read.parquet(place(n)) for n in ("qrels", "found"))
    judged = report.evaluation.judged(found, qrels)
    rows = report.metrics(judged, qrels, 2, ["dense", "lexical"])
    for frame in (judged, rows):  # joins with judgements are those on chunks too
        assert not re.search(r"Broadcast\w*Join \[.*chunk_index", frame._jdf.queryExecution().executedPlan().toString())
    own = {(r["strategy"], r["query_id"]): r for r in rows.collect()}
    assert len(own) == 20 and own["dense", 1]["n_hits"] == 2 and own["dense", 1]["recall"] == own["lexical", 1]["recall"] == 0.01
    assert own["lexical", 3]["n_hits"] == 0 and own["lexical", 1]["ndcg"] == pytest.approx(0.613147, abs=1e-6)


def test_report_counts_a_chunk_judged_twice_as_its_hits_do(spark, place):
    paths = tables(spark, place, [(1, "src1", "apple", 0), (2, "src1", "pie", 0)], [], [(1, "apple")], [(1, 1), (1, 1), (2, 1)])
    report.retrieval_report(spark, *paths, place("out"), ["lexical"], baseline="lexical")
    row = report.read(spark, place("out") + "/metrics", report.METRICS).first()
    assert (row["n_hits"], row["recall"], row["rr"]) == (2, 1.0, 1.0)  # as the SQL; 2.0 before, when hits met the judgements twice


def test_command_line(spark, small, place, tmp_path):
    deliver(spark, place("in"), some(spark, small)[:10])
    args = ["--documents", place("in"), "--output", place("out"), "--checkpoint", place("mark"), "--master", "local[2]"]
    ran = [subprocess.run([sys.executable, "-m", "jobs.ingest_documents", *args], cwd=ROOT, check=True, capture_output=True, text=True) for _ in range(2)]
    assert [json.loads(r.stdout.strip().splitlines()[-1])["documents"] for r in ran] == [10, 0]
    assert "batch 0: {'rows_read': 10, 'documents': 10" in ran[0].stderr
    assert ingest.chunks(spark, place("out")).count() > 0
