"""Deletion by bits, compaction and purging of stored tables."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.operators.block_max import BlockIndex
from lodestar.operators.models import hashed_embedding
from lodestar.sources import index_store, store

SCHEMA = "doc_id long, tenant string, text string"


def _size(folder):
    root = folder.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(root) for f in names)


def _ids(spark, folder, name="x"):
    return sorted(r["chunk_index"] for r in index_store.read_tables(spark, folder)[name].collect())


def _numbers(spark, *bounds):
    return spark.range(*bounds).select(F.col("id").alias("chunk_index"), F.concat(F.lit("row "), F.col("id")).alias("value"))


def _chosen(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "chunk_index long")


@pytest.fixture
def folder(spark, tmp_path):
    """Three parts of 100 rows."""
    folder = f"file://{tmp_path}/t"
    for i in range(3):
        index_store.write_tables({"x": _numbers(spark, 100 * i, 100 * i + 100)}, folder, append=True)
    return folder


def test_edges_of_words_repeats_and_nulls(spark, folder):
    gone = [0, 0, 1, 62, 63, 64, 65, 127, 128, 191, 192, 299, 5000, None]
    index_store.delete_rows(_chosen(spark, gone), folder)
    left = sorted(set(range(300)) - set(gone))
    assert _ids(spark, folder) == left
    # a second deletion that overlaps the first in the same words
    index_store.delete_rows(_chosen(spark, [1, 2, 66]), folder)
    assert _ids(spark, folder) == [i for i in left if i not in (2, 66)]
    index_store.delete_rows(_chosen(spark, []), folder)
    assert _ids(spark, folder) == [i for i in left if i not in (2, 66)]
    index_store.delete_rows(_chosen(spark, range(300)), folder)
    assert _ids(spark, folder) == []
    assert index_store.compact(spark, folder) == 3 and _ids(spark, folder) == []


def test_very_large_ids(spark, tmp_path):
    folder, high = f"file://{tmp_path}/t", 2**62
    index_store.write_tables({"x": _numbers(spark, high, high + 130)}, folder)
    index_store.delete_rows(_chosen(spark, [high, high + 63, high + 129]), folder)
    assert _ids(spark, folder) == [high + i for i in range(130) if i not in (0, 63, 129)]


def test_beyond_the_broadcast(spark, folder, monkeypatch):
    monkeypatch.setattr(index_store, "DELETED_WORDS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index_store.delete_rows(_chosen(spark, range(0, 300, 3)), folder)
        assert "Broadcast" not in index_store.read_tables(spark, folder)["x"]._jdf.queryExecution().executedPlan().toString()
        assert _ids(spark, folder) == [i for i in range(300) if i % 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_deletion_writes_what_is_deleted(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    index_store.write_tables({"x": _numbers(spark, 200_000).withColumn("value", F.sha2("value", 256))}, folder)
    before = _size(folder)
    index_store.delete_rows(_chosen(spark, range(0, 200_000, 997)), folder)
    # 201 words of 16 bytes, and the fixed cost of the files
    assert _size(folder) - before < 20_000 < before / 100
    plan = index_store.read_tables(spark, folder)["x"].where("value = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "PushedFilters: [IsNotNull(value), EqualTo(value,a)]" in plan


def test_compaction_takes_small_and_worn_parts(spark, folder):
    first = index_store.current(spark, folder)
    index_store.delete_rows(_chosen(spark, [*range(100, 150), 205]), folder)
    left = [i for i in range(300) if not 100 <= i < 150 and i != 205]
    # no part is small: only the second has lost enough, and the deletion stays for the third
    assert index_store.compact(spark, folder, small_bytes=0) == 1
    found = index_store.current(spark, folder)
    assert first.parts[1] not in found.parts and {first.parts[0], first.parts[2]} < set(found.parts)
    assert [d.of for d in found.deletions] == [(first.parts[2],)] and _ids(spark, folder) == left
    assert index_store.compact(spark, folder, small_bytes=0) == 0
    # all are small now
    assert index_store.compact(spark, folder) == 3
    found = index_store.current(spark, folder)
    assert len(found.parts) == 1 and not found.deletions and _ids(spark, folder) == left
    assert index_store.compact(spark, folder) == 0 and index_store.current(spark, folder) == found


def test_a_deletion_of_nothing_is_dropped(spark, folder):
    index_store.delete_rows(_chosen(spark, [777]), folder)
    assert index_store.compact(spark, folder, small_bytes=0) == 0
    assert not index_store.current(spark, folder).deletions and len(index_store.current(spark, folder).parts) == 3


def test_writers_that_die_or_come_late(spark, folder, monkeypatch):
    index_store.delete_rows(_chosen(spark, range(50)), folder)
    before, rows = index_store.current(spark, folder), _ids(spark, folder)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(index_store, "_publish", dies)
        for write in (lambda: index_store.compact(spark, folder), lambda: index_store.delete_rows(_chosen(spark, [60]), folder)):
            with pytest.raises(OSError):
                write()
    # what they have written is no part of the current version, and both can be run again
    assert index_store.current(spark, folder) == before and _ids(spark, folder) == rows

    written = index_store._write_part

    def late(tables, at):
        part = written(tables, at)
        monkeypatch.setattr(index_store, "_write_part", written)
        index_store.write_tables({"x": _numbers(spark, 300, 310)}, at, append=True)
        return part

    monkeypatch.setattr(index_store, "_write_part", late)
    with pytest.raises(RuntimeError):
        index_store.compact(spark, folder)
    assert _ids(spark, folder) == [*rows, *range(300, 310)]
    with pytest.raises(RuntimeError):
        index_store.write_tables({"x": _numbers(spark, 1)}, folder, expected=before.version)
    assert index_store.compact(spark, folder) == 4 and _ids(spark, folder) == [*rows, *range(300, 310)]


def test_purge(spark, folder):
    index_store.delete_rows(_chosen(spark, range(50)), folder)
    index_store.compact(spark, folder)
    rows, root = _ids(spark, folder), folder.removeprefix("file://")
    assert index_store.purge(spark, folder) == 0
    # three parts, a deletion, and the manifests of the versions before
    assert index_store.purge(spark, folder, older_than_hours=0) == 8
    found = index_store.current(spark, folder)
    assert {n for n in os.listdir(root) if not n.startswith((".", "current-"))} == {*found.parts, found.name}
    assert _ids(spark, folder) == rows


def test_packed_tables_are_refused(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    with pytest.raises(ValueError):
        index_store.delete_rows(_chosen(spark, [1]), folder)
    index_store.write_tables(BlockIndex.build(spark.createDataFrame([(1, "some words")], "chunk_index long, text string")).tables(), folder)
    with pytest.raises(ValueError, match="blocks"):
        index_store.delete_rows(_chosen(spark, [1]), folder)


def test_a_corpus_of_many_small_parts(spark, tmp_path):
    """Ingest, delete and ingest again: compaction changes no row, no score, and no id that comes after."""
    folder = f"file://{tmp_path}/c"
    texts = ["solar cells make power", "salt the pasta water", "loosen the lug nuts", "cells divide and grow"]
    for i, tenant in enumerate(("a", "b", "a", "c")):
        store.ingest(spark.createDataFrame([(i, tenant, texts[i])], SCHEMA), folder)
    assert store.delete_tenant(spark, folder, "a") == 2 and store.delete_tenant(spark, folder, "a") == 0
    asks = spark.createDataFrame([(0, "solar cells pasta")], "query_id long, text string")

    def seen():
        corpus = store.restore(spark, folder)
        return sorted(map(tuple, corpus.chunks.collect())), [tuple(r) for r in corpus.index.search(asks).orderBy("rank").collect()], corpus.index.corpus_stats.first()

    before = seen()
    assert [r[0] for r in before[0]] == [1, 3] and before[2]["n"] == 2
    assert store.compact(spark, folder) == 4
    assert seen() == before
    assert store.ingest(spark.createDataFrame([(9, "a", texts[0])], SCHEMA), folder) == 1
    assert [r[0] for r in seen()[0]] == [1, 3, 4]


def test_vectors_are_compacted_too(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    for i, (tenant, text) in enumerate((("a", "solar cells"), ("b", "salt the pasta"), ("b", "lug nuts"))):
        store.ingest(spark.createDataFrame([(i, tenant, text)], SCHEMA), folder, hashed_embedding)
    store.delete_tenant(spark, folder, "a")
    asks = spark.createDataFrame([(0, "solar pasta nuts")], "query_id long, text string").withColumn("embedding", hashed_embedding(F.col("text")))

    def seen():
        corpus = store.restore(spark, folder)
        return [sorted(map(str, df.collect())) for df in (corpus.vectors, corpus.vector_index.centroids, corpus.vector_index.search(asks, 3, probes=9))]

    before = seen()
    assert len(before[0]) == len(before[2]) == 2
    assert store.compact(spark, folder) == 3 and seen() == before
    assert len(index_store.current(spark, folder).parts) == 1
