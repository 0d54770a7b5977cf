"""Stored tables: immutable parts in Parquet, and a manifest for each version that lists its parts.

A write adds a part and then makes a new version current; a reader sees the old version or the new one whole.
Appending keeps the parts of the version before, so it writes nothing but the new rows. Nothing is pickled.

Versions are numbered upward and the greatest is current, so what a writer that died has left is never taken for
newer than what came after it. A version is a marker file that names its manifest. It is made only if there is none
of that number, so of two writers that started from the same version, the second gets an error; one that is empty was
left by a writer that died and stands for nothing.

Rows are deleted by their chunk: a deletion is a part of its own that holds one bit for each chunk deleted, and readers
leave those chunks out of every table, so deleting writes what is deleted and rewrites nothing. ``compact`` merges small
parts and those that have lost many rows, and ``purge`` removes what no version names any more. An id must not be given
again (see ``next_index``), for a deletion hides it for good.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.session import broadcast_if_small, shuffles_dropped
from lodestar.sources import schemas

SCHEMAS = {
    "postings": schemas.POSTINGS,
    "doc_stats": schemas.DOC_STATS,
    "term_stats": schemas.TERM_STATS,
    "corpus_stats": schemas.CORPUS_STATS,
    "vectors": schemas.VECTORS,
    "centroids": schemas.CENTROIDS,
    "chunks": schemas.CHUNKS,
    "blocks": schemas.BLOCKS,
    "shards": schemas.SHARDS,
    "graphs": schemas.GRAPHS,
    "term_vectors": schemas.TERM_VECTORS,
    "positions": schemas.POSITIONS,
}
#: Tables that are laid out in folders by a column, so that a filter on it reads its own.
FOLDERS = {"blocks": ("bucket",)}
#: In which order a compacted table's rows are laid out.
ORDER = {
    "chunks": ("chunk_index",),
    "doc_stats": ("chunk_index",),
    "postings": ("term", "chunk_index"),
    "positions": ("term", "chunk_index"),
    "vectors": ("list", "chunk_index"),
}
#: Tables without chunks that say nothing about single ones, so a deletion leaves them as they are.
INDEPENDENT = {"centroids"}
#: Parts of fewer bytes are merged.
SMALL_PART = 1 << 30
#: Words of 64 deletion bits that are broadcast at most, 16 bytes each; more are joined by a shuffle.
DELETED_WORDS = 1_000_000
_MANIFEST = "parts array<string>, tables array<string>, next_index long, deletions array<struct<part: string, of: array<string>>>"


@dataclass(frozen=True)
class Deletion:
    part: str
    #: The parts that may still hold its rows.
    of: tuple[str, ...]


@dataclass(frozen=True)
class Manifest:
    version: int
    parts: tuple[str, ...]
    tables: tuple[str, ...]
    #: Ids below this have been given out, whether or not their rows still exist.
    next_index: int = 0
    deletions: tuple[Deletion, ...] = ()
    #: The manifest's folder.
    name: str = ""


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    return path, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    _, root, system = _files(spark, folder)
    names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
    return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))


def current(spark: SparkSession, folder: str) -> Manifest | None:
    """The current version's manifest; None where nothing was written."""
    path, _, system = _files(spark, folder)
    for version in reversed(_versions(spark, folder)):
        stream = system.open(path(f"{folder}/current-{version}"))
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if name:
            row = spark.read.schema(_MANIFEST).json(f"{folder}/{name}").first()
            deletions = tuple(Deletion(d["part"], tuple(d["of"])) for d in row["deletions"] or ())
            return Manifest(version, tuple(row["parts"]), tuple(row["tables"]), row["next_index"], deletions, name)
    return None


def _begin(spark: SparkSession, folder: str, expected: int | None = None) -> tuple[Manifest | None, int]:
    """The version to start from, and the number of the next; what is made current in between makes ``_publish`` fail."""
    version = max(_versions(spark, folder), default=0) + 1
    before = current(spark, folder)
    if expected is not None and (before.version if before else 0) != expected:
        raise RuntimeError(f"another writer has made a version of {folder} after {expected}")
    return before, version


def _write_part(tables: dict[str, DataFrame], folder: str, part: str | None = None) -> str:
    part = part or uuid.uuid4().hex
    for name, df in tables.items():
        with shuffles_dropped(df.sparkSession):
            df.write.partitionBy(*FOLDERS.get(name, ())).parquet(f"{folder}/{part}/{name}")
    return part


def _publish(spark: SparkSession, folder: str, new: Manifest) -> int:
    """Makes the manifest's version current."""
    row = [(new.parts, new.tables, new.next_index, [(d.part, d.of) for d in new.deletions])]
    path, root, system = _files(spark, folder)
    manifest = f"manifest-{new.version}-{uuid.uuid4().hex}"
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.json(f"{folder}/{manifest}")
    try:
        stream = system.create(path(f"{folder}/current-{new.version}"), False)
    except Py4JJavaError as error:
        raise RuntimeError(f"another writer made version {new.version} of {folder}") from error
    stream.write(bytearray(manifest.encode()))
    stream.close()
    for found in system.listStatus(root):
        name = found.getPath().getName()
        if name.startswith("current-") and int(name.removeprefix("current-")) < new.version:
            system.delete(found.getPath(), True)
    return new.version


def begin_part(name: str, df: DataFrame, folder: str) -> tuple[str, DataFrame]:
    """Writes the first table of a new part and gives its rows as stored, for the part's other tables to be made of.

    The part belongs to no version before ``write_tables`` was called with it; until then it is what a dead writer leaves.
    """
    part = _write_part({name: df}, folder)
    return part, _stored(df.sparkSession, folder, (part,), name)


def write_tables(
    tables: dict[str, DataFrame], folder: str, append: bool = False, next_index: int | None = None, expected: int | None = None, part: str | None = None
) -> int:
    """Writes the tables as a part and makes a version current that has it, with ``append`` beside the earlier parts.

    With ``expected`` it is an error if the current version is another (0: none). A ``part`` of ``begin_part`` gets the tables
    beside the one it has.
    """
    spark = next(iter(tables.values())).sparkSession
    before, version = _begin(spark, folder, expected)
    _, place, system = _files(spark, f"{folder}/{part}")
    begun = [f.getPath().getName() for f in system.listStatus(place)] if part else []
    part = _write_part(tables, folder, part)
    given = next_index if next_index is not None else before.next_index if before else 0
    kept = before if before and append else Manifest(0, (), ())
    return _publish(spark, folder, Manifest(version, (*kept.parts, part), tuple(sorted({*tables, *begun, *kept.tables})), given, kept.deletions))


def read_tables(spark: SparkSession, folder: str, found: Manifest | None = None) -> dict[str, DataFrame] | None:
    """The current version's tables by name (or those of the version ``found``), with declared schemas and without
    deleted rows; None where nothing was written."""
    found = found or current(spark, folder)
    if found is None:
        return None
    gone = _deleted(spark, folder, found)
    return {name: _without(_stored(spark, folder, found.parts, name), gone) for name in found.tables}


def _stored(spark: SparkSession, folder: str, parts: tuple[str, ...], name: str) -> DataFrame | None:
    """A table's rows in these parts, deleted ones too; None where no part has it."""
    path, _, system = _files(spark, folder)
    places = [p for part in parts if system.exists(path(p := f"{folder}/{part}/{name}"))]
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    if not places:
        return None
    # folders below several roots are found one root at a time
    return reduce(DataFrame.unionByName, map(reader.parquet, places)) if name in FOLDERS else reader.parquet(*places)


def _deleted(spark: SparkSession, folder: str, found: Manifest) -> DataFrame | None:
    """(word, bits): deleted chunks, 64 of neighbouring ids in a word."""
    if not found.deletions:
        return None
    words = spark.read.schema("word long, bits long").parquet(*(f"{folder}/{d.part}/deleted" for d in found.deletions))
    return broadcast_if_small(words.groupBy("word").agg(F.bit_or("bits").alias("bits")), DELETED_WORDS)


def _is_gone(gone: DataFrame):
    bit = F.col("chunk_index").bitwiseAND(F.lit(63)).cast("int")
    return (F.shiftright("chunk_index", 6) == gone["word"]) & (F.getbit(gone["bits"], bit) == 1)


def _without(df: DataFrame, gone: DataFrame | None) -> DataFrame:
    return df if gone is None or "chunk_index" not in df.columns else df.join(gone, _is_gone(gone), "left_anti")


def delete_rows(ids: DataFrame, folder: str, expected: int | None = None) -> int:
    """Deletes the chunks (chunk_index) from all tables, writing nothing but their ids; returns the version made.

    Tables that keep chunks in packed form or sum over them can't lose single ones: a store that has any is refused.
    """
    spark = ids.sparkSession
    before, version = _begin(spark, folder, expected)
    if before is None:
        raise ValueError(f"nothing is stored in {folder}")
    packed = [name for name in before.tables if name not in INDEPENDENT and "chunk_index" not in _stored(spark, folder, before.parts, name).columns]
    if packed:
        raise ValueError(f"single chunks can't be deleted from {', '.join(packed)}")
    bit = F.expr("shiftleft(1L, CAST(chunk_index & 63 AS INT))")
    words = ids.where("chunk_index IS NOT NULL").groupBy(F.shiftright("chunk_index", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    part = _write_part({"deleted": words}, folder)
    return _publish(spark, folder, replace(before, version=version, deletions=(*before.deletions, Deletion(part, before.parts))))


def _losses(spark: SparkSession, folder: str, found: Manifest) -> dict[str, float]:
    """The share of rows deleted of each part that has lost any, over all its tables."""
    gone = _deleted(spark, folder, found)
    if gone is None:
        return {}
    rows = []
    for name in found.tables:
        df = _stored(spark, folder, found.parts, name)
        if "chunk_index" in df.columns:
            part = F.regexp_extract(F.col("_metadata.file_path"), f"/([0-9a-f]{{32}})/{name}/", 1)
            df = df.select("chunk_index", part.alias("part"))
            rows.append(df.join(gone, _is_gone(gone), "left").select("part", F.col("word").isNotNull().cast("int").alias("lost")))
    shares = reduce(DataFrame.unionByName, rows).groupBy("part").agg(F.avg("lost").alias("share")).where("share > 0")
    return {r["part"]: r["share"] for r in shares.collect()}  # a row for each part, as in the manifest


def compact(spark: SparkSession, folder: str, small_bytes: int = SMALL_PART, lost_share: float = 0.2) -> int:
    """Writes anew, as one part without the deleted rows, the parts below ``small_bytes`` (if there are several) and those
    that have lost more than ``lost_share`` of their rows; returns how many parts it replaced.

    Other parts aren't read but for their ids. Deletions that no part needs any more are dropped from the version. A
    version made meanwhile is an error, and nothing has changed then.
    """
    before, version = _begin(spark, folder)
    if before is None:
        return 0
    path, _, system = _files(spark, folder)
    losses = _losses(spark, folder, before)
    small = {p for p in before.parts if system.getContentSummary(path(f"{folder}/{p}")).getLength() < small_bytes}
    chosen = {p for p, share in losses.items() if share > lost_share} | (small if len(small) > 1 else set())
    old, kept = tuple(p for p in before.parts if p in chosen), tuple(p for p in before.parts if p not in chosen)
    needed = [Deletion(d.part, tuple(p for p in d.of if p in kept and p in losses)) for d in before.deletions]
    needed = tuple(d for d in needed if d.of)
    if not old and needed == before.deletions:
        return 0
    parts = kept
    if old:
        gone, tables = _deleted(spark, folder, before), {}
        for name in before.tables:
            df = _stored(spark, folder, old, name)
            if df is not None:
                rows, order = _without(df, gone), [c for c in ORDER.get(name, ()) if c in df.columns]
                tables[name] = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        parts = (*kept, _write_part(tables, folder))
    _publish(spark, folder, replace(before, version=version, parts=parts, deletions=needed))
    return len(old)


def purge(spark: SparkSession, folder: str, older_than_hours: float = 24.0) -> int:
    """Removes parts and manifests that the current version doesn't name and that are older; returns how many.

    Deleted rows are gone from disk after ``compact`` and this. A reader of an earlier version, or a writer that hasn't
    made its part current yet, must not be older than those hours.
    """
    found = current(spark, folder)
    if found is None:
        return 0
    _, root, system = _files(spark, folder)
    named = {*found.parts, *(d.part for d in found.deletions), found.name}
    limit = (time.time() - older_than_hours * 3600) * 1000
    old = [f for f in system.listStatus(root) if f.isDirectory() and f.getPath().getName() not in named and f.getModificationTime() <= limit]
    return sum(system.delete(f.getPath(), True) for f in old)
