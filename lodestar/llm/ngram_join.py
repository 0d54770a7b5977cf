"""Exact Jaccard self-join of documents on word shingles, by signature trees.

1. Every document becomes the set of its distinct shingle hashes. Documents with equal
   sets (two independent 64-bit names and the size) are one class, so copies cost nothing further.
2. Two sets with Jaccard similarity t share one of the first ``n - ceil(t * n) + 1`` members of each, under any
   common order of all shingles. The order used takes the shingles of the lower half of the hash range first, by the
   number of classes that hold them, so a shingle of a widespread passage comes last and a class whose first members
   are all its own is done. These first members route the sets through the forest of signature trees of ``links``,
   which decides every pair: leaves, then nodes, then sets; links are verified on the whole sets before they join
   components.

Shingles travel as blocks of packed integers, dealt out by hash into parts of about ``PART_SHINGLES`` each. A shingle
that ``HOT`` classes or more of one block hold is settled there: its part gets one row for the block, which says so,
and its holders go on directly, so no task sees all holders of a widespread shingle. Such shingles are last of their
half in the common order.

Null and empty texts have an empty set and link with nothing. Rows that share an id are one document: each row has its
own set and size, and all of them have the links of any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import small_side, stored
from lodestar.llm.components import connected_components
from lodestar.llm.kernels import mix, shingle_sets, slices
from lodestar.llm.links import verified_components

WIDTH = 5
#: Similarity as a fraction of integers: 100 * intersection >= 75 * union.
PERCENT = 75
#: Shingles of one block of the candidate search.
PART_SHINGLES = 1_500_000
BLOCK_SHINGLES, BLOCK_SETS = 1_500_000, 60_000
#: Classes of one block that make a shingle widespread; the count that it gets then, and the most that others get.
HOT, HOT_COUNT = 64, 65535
#: Hashes below this come first in the common order, by frequency.
HALF = np.uint64(1 << 63)

_U = np.uint64
_HOT_MARK = np.iinfo(np.int64).min


def set_names(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set of hashes, the same for equal sets."""
    if not len(hashes):
        return 0, 0
    value = hashes.view("<u8") * _U(0x9FB21C651E98DF25)
    value = (value ^ (value >> _U(29))) * _U(0xC4CEB9FE1A85EC53) + _U(len(hashes))
    return int(np.bitwise_xor.reduce(value).view("<i8")), int(np.add.reduce(mix(hashes + _U(0x2545F4914F6CDD1D))).view("<i8"))


def prefix_length(n: int, percent: int) -> int:
    """Two sets with that similarity share one of the first so many members of each, under any common order."""
    return n - -(-n * percent // 100) + 1


_SETS = "doc_id long, row long, n_shingles long, name_1 long, name_2 long, lower int"


def _sets(width: int):
    """Size and names of each document's shingle set; ``lower`` counts its hashes in the lower half of their range."""
    names = [x.split()[0] for x in _SETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, 4), np.int64)
            for i, s in shingle_sets(batch.column(2), width):
                found[i] = len(s), *set_names(s), np.searchsorted(s, HALF)
            arrays = [pa.array(found[:, i]) for i in range(3)] + [pa.array(found[:, 3].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    return run


def _members(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = [s.astype("<u8").tobytes() for _, s in shingle_sets(batch.column(1).slice(a, b - a), width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.binary())], ["owner", "members"])

    return run


def _cut(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, bytes of each column's rows of that part)."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    found, starts = np.unique(part, return_index=True)
    columns = [c[order] for c in columns]
    for p, a, b in zip(found, starts, np.append(starts[1:], len(part)), strict=True):
        yield int(p), *(c[a:b].tobytes() for c in columns)


_BLOCKS = "part int, home int, source int, tokens binary, owners binary, counts binary"


def _token_blocks(width: int, percent: int, parts: int, homes: int):
    """Blocks of a part's shingles (their upper 32 bits) and the classes that hold them.

    Rows with a home (other rows have -1) hold widespread shingles, on their way to the home of their classes; their
    part is one of the numbers from ``parts`` on, so that they are dealt out like the others.
    """

    def flush(tokens, owners):
        if not tokens:
            return
        t, o = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(t, kind="stable")
        t, o = t[order], o[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        held = np.diff(np.append(first, len(t)))
        hot = np.repeat(held >= HOT, held)
        part_of = lambda x: ((x & _U(0xFFFFFFFF)) * _U(parts) >> _U(32)).astype(np.int32)
        upper = lambda x: (x >> _U(32)).astype("<u4")
        marks = t[first[held >= HOT]]
        plain = np.concatenate((t[~hot], marks))
        rows = [(p, -1, p, a, b, b"") for p, a, b in _cut(part_of(plain), upper(plain), np.concatenate((o[~hot], np.full(len(marks), _HOT_MARK))))]
        t, o = t[hot], o[hot]
        home = (o % homes).astype(np.int64)
        for key, a, b in _cut(home * parts + part_of(t), upper(t), o):
            rows.append((parts + key // parts, key // parts, key % parts, a, b, np.full(len(b) // 8, HOT_COUNT, "<u2").tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, size = [], [], 0
        for batch in batches:
            vertices = batch.column(0).to_pylist()
            for i, s in shingle_sets(batch.column(1), width):
                if not len(s):
                    continue
                vertex = vertices[i]
                take = max(int(np.searchsorted(s, HALF)), prefix_length(len(s), percent))
                tokens.append(s[:take].copy())
                owners.append(np.full(take, vertex, np.int64))
                size += take
                if size > BLOCK_SHINGLES or len(tokens) > BLOCK_SETS:
                    yield from flush(tokens, owners)
                    tokens, owners, size = [], [], 0
        yield from flush(tokens, owners)

    return run


def _frequencies(homes: int):
    """To each class, of those of its shingles that others hold too, how many do."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, owners = [], []
        for pdf in batches:
            direct = pdf[pdf["home"] >= 0]
            if len(direct):
                yield direct[["home", "source", "tokens", "owners", "counts"]]
            for t, o in zip(pdf["tokens"][pdf["home"] < 0], pdf["owners"][pdf["home"] < 0], strict=True):
                tokens.append(np.frombuffer(t, "<u4"))
                owners.append(np.frombuffer(o, "<i8"))
        if not tokens:
            return
        t, o = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(t, kind="stable")
        t, o = t[order], o[order]
        near = np.zeros(len(t) + 1, bool)
        near[1:-1] = t[1:] == t[:-1]
        several = near[1:] | near[:-1]
        t, o = t[several], o[several]
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
        t, o = t[new], o[new]
        _, first, at, count = np.unique(t, return_index=True, return_inverse=True, return_counts=True)
        hot = (o[first] == _HOT_MARK)[at] if len(t) else np.zeros(0, bool)  # the mark is the least of its shingle's rows
        count = np.where(hot, HOT_COUNT, np.minimum(count[at], HOT_COUNT - 1))
        keep = (count > 1) & (o != _HOT_MARK)
        t, o, count = t[keep], o[keep], count[keep]
        rows = list(_cut((o % homes).astype(np.int32), t.astype("<u4"), o.astype("<i8"), count.astype("<u2")))
        yield pd.DataFrame({"home": [r[0] for r in rows], "source": key[0], "tokens": [r[1] for r in rows], "owners": [r[2] for r in rows], "counts": [r[3] for r in rows]})

    return run


def _prefixes(percent: int):
    """The first members of each set that other sets hold too."""

    def run(key: tuple, found: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(sets):
            return pd.DataFrame({"token": [], "owner": [], "n": []}, dtype="int64")
        o = np.concatenate([np.frombuffer(x, "<i8") for x in found["owners"]])
        t = np.concatenate([np.frombuffer(x, "<u4") for x in found["tokens"]])
        c = np.concatenate([np.frombuffer(x, "<u2") for x in found["counts"]])
        part = np.repeat(found["source"].to_numpy(np.int64), [len(x) // 8 for x in found["owners"]])
        upper = t >= np.uint32(1 << 31)
        order = np.lexsort((t, part, np.where(upper, 0, c), upper, o))
        o, t, part, upper = o[order], t[order], part[order], upper[order]
        names, first, held = np.unique(o, return_index=True, return_counts=True)
        lower_held = np.add.reduceat((~upper).astype(np.int64), first)
        sets = sets.set_index("vertex").loc[names]
        n, lower = sets["n_shingles"].to_numpy(), sets["lower"].to_numpy()
        length = n - -(-n * percent // 100) + 1
        own = lower - lower_held  # shingles of the lower half that no other set holds come first
        keep = np.where(lower >= length, np.maximum(0, length - own), held)
        place = np.arange(len(o)) - np.repeat(first, held)
        chosen = place < np.repeat(keep, held)
        return pd.DataFrame({"token": (part[chosen] << 32) | t[chosen].astype(np.int64), "owner": o[chosen], "n": np.repeat(n, held)[chosen]})

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links, the row's own id if it links with nothing. Other columns of
    ``docs`` are ignored. Null texts have n_shingles 0; a row whose id is null is left out, since it can't be named.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    repeated = not texts.groupBy("doc_id").count().where("count > 1").isEmpty()
    # a class is named by the least of its rows: by ids, or where ids repeat by a hash of id and text
    texts = texts.select("doc_id", (F.xxhash64("doc_id", "text") if repeated else F.col("doc_id")).alias("row"), "text")
    sets = stored(texts.mapInArrow(_sets(width), _SETS), "sets")
    filled = sets.where("n_shingles > 0")
    name = ["name_1", "name_2", "n_shingles"]
    classes = filled.groupBy(*name).agg(F.min("row").alias("vertex"), F.min("doc_id").alias("first_id"), F.first("lower").alias("lower"))
    # dealt out anew, so that Spark may split the join of a class with very many copies
    named = filled.select("doc_id", "row", *name).join(classes.select(*name, "vertex", "first_id").repartition("vertex"), name)
    named = stored(named.select("doc_id", "row", "n_shingles", "vertex", "first_id"), "classes")
    copies = named.where("row <> vertex").select("row").distinct()
    unique = texts.select("row", "text").where("text IS NOT NULL").join(small_side(copies), "row", "left_anti")
    if repeated:
        unique = unique.dropDuplicates(["row"])  # rows that agree in id and text

    total = filled.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(1, -(-total // (2 * PART_SHINGLES)))
    homes = max(1, -(-parts // 4))
    blocks = unique.mapInArrow(_token_blocks(width, percent, parts, homes), _BLOCKS)
    counted = blocks.groupBy("part").applyInPandas(_frequencies(homes), "home int, source int, tokens binary, owners binary, counts binary")
    at_home = classes.select(F.pmod("vertex", F.lit(homes)).cast("int").alias("home"), "vertex", "n_shingles", "lower")
    entries = counted.groupBy("home").cogroup(at_home.groupBy("home")).applyInPandas(_prefixes(percent), "token long, owner long, n long")
    entries = stored(entries, "entries")
    wanted = unique.join(small_side(entries.select(F.col("owner").alias("row")).distinct()), "row")
    joined = verified_components(entries, wanted.select("row", "text").mapInArrow(_members(width), "owner long, members binary"), percent)

    joined = joined.select(F.col("owner").alias("vertex"), "component")
    known = named.join(joined, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    if repeated:
        firsts = known.groupBy("doc_id").agg(F.min("component").alias("b"))
        same = connected_components(known.select("doc_id", F.col("component").alias("a")).join(firsts, "doc_id").select("a", "b"))
        known = known.join(same.select(F.col("vertex").alias("component"), F.col("component").alias("whole")), "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = known.join(least.repartition("component_id"), "component").select("doc_id", "n_shingles", "component_id")
    alone = sets.where("n_shingles = 0").select("doc_id", "n_shingles")
    if repeated:
        others = linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        alone = alone.join(others, "doc_id", "left")
    else:
        alone = alone.withColumn("component_id", F.lit(None).cast("long"))
    return linked.unionByName(alone.withColumn("component_id", F.coalesce("component_id", "doc_id")))


#: The same in DuckDB SQL, by counting the shingles that each pair of documents shares.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i : i + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WIDTH - 2}, 2))) AS i FROM w WHERE len(ws) > 0))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= {PERCENT} * (a.n + b.n - shared)
), r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) c USING (doc_id)
"""
