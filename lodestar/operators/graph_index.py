"""Approximate dense search on navigable neighbour graphs, one for each shard of vectors.

Vectors are dealt into shards of about ``SHARD_ROWS``; equal vectors of a shard are one node. A node is linked to near nodes,
but to none that is nearer to a neighbour it has already than to itself, so links lead in different directions; links
are also walked backwards, and a part that can't be reached from the entry nodes is linked to its nearest node that
can. A query walks from the entry nodes to the most similar node it hasn't looked around yet, keeping a beam of the
``ef`` best, and ends where the whole beam was looked around. Queries walk in step, as arrays. The shards' best are merged.

How wide the beam must be is measured when a shard is built: for some disturbed vectors the true neighbours are found by
brute force, and the narrowest beam that finds ``RECALL`` of them is stored with the shard. That suits queries that are
like some vector. With ``unlike`` they are looked for around vectors that the walk may not enter, as if they weren't
there; where the data have no clusters such queries need much wider beams. A beam as wide as the shard
scores all its vectors, which is the exact search. The index is a table of one row for each shard; vectors that come later
make shards of their own, and ``compacted`` builds small shards anew as large ones.

Scores are cosines as in ``dense``; ties go to the smaller chunk. Vectors that are null or empty or hold a null or a non-finite
component take no part, and a query meets vectors of its own length only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.vector import MIN_NORM
from lodestar.operators import dense
from lodestar.plans.session import materialized

#: Vectors of a shard, near nodes that links are chosen from, links that a node chooses (and as many backwards).
SHARD_ROWS, NEAR, LINKS = 16_384, 48, 12
#: Entry nodes, for each unit of the root of the number of nodes.
ENTRIES = 0.25
#: Beams that are tried, the share of true neighbours that one must find, how many neighbours, and of how many vectors.
BEAMS, RECALL, NEIGHBOURS, TRIED = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512), 0.95, 10, 100
#: How long the disturbance of a unit vector is.
DISTURBED = 0.3
#: Queries that walk in step, and queries that are sent to the tasks at once.
STEP_QUERIES, QUERY_ROWS = 256, 20_000
GRAPHS = "shard string, dims int, n long, ef int, ids binary, nodes binary, vectors binary, links binary, entries binary"
_SCHEMA = pa.schema([("shard", pa.string()), ("dims", pa.int32()), ("n", pa.int64()), ("ef", pa.int32()), *((n, pa.binary()) for n in ("ids", "nodes", "vectors", "links", "entries"))])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(axis=1)), MIN_NORM)[:, None]


# Building


def _near(units: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar other nodes of each node, and how similar they are."""
    ids, sims = np.empty((len(units), k), np.int32), np.empty((len(units), k), np.float32)
    for low in range(0, len(units), 1024):
        scores = units[low : low + 1024] @ units.T
        rows = np.arange(len(scores))
        scores[rows, low + rows] = -np.inf
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(scores, top, 1)
        order = np.argsort(-best, axis=1, kind="stable")
        ids[low : low + 1024], sims[low : low + 1024] = np.take_along_axis(top, order, 1), np.take_along_axis(best, order, 1)
    return ids, sims


def _chosen(units: np.ndarray, near: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Which of its near nodes a node is linked to."""
    kept = np.zeros(near.shape, bool)
    for low in range(0, len(near), 256):
        rows = units[near[low : low + 256]]
        among = rows @ rows.transpose(0, 2, 1)
        own, alive, chosen = sims[low : low + 256], np.ones(rows.shape[:2], bool), kept[low : low + 256]
        for a in range(near.shape[1]):
            chosen[:, a] = alive[:, a] & (chosen.sum(axis=1) < links)
            alive &= ~(chosen[:, a, None] & (among[:, a] > own))
    return kept


def _apart(units: np.ndarray, n: int) -> np.ndarray:
    """The most central node, and nodes one after the other that are least like those before."""
    found = [int(np.argmax(units @ units.mean(axis=0)))]
    most = units @ units[found[0]]
    while len(found) < n:
        found.append(int(np.argmin(most)))
        most = np.maximum(most, units @ units[found[-1]])
    return np.unique(found)


def _padded(source: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Links as an array, a row for each node; -1 where it has no more. Links come ordered by their source."""
    count = np.bincount(source, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1, np.int32)
    out[source, np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)] = target
    return out


def _reached(graph: np.ndarray, start: np.ndarray, seen: np.ndarray) -> None:
    while len(start):
        seen[start] = True
        after = np.unique(graph[start])
        start = after[(after >= 0) & ~seen[after]]


def graph_of(units: np.ndarray, near: int = NEAR, links: int = LINKS) -> tuple[np.ndarray, np.ndarray]:
    """(links, entry nodes) of distinct unit vectors."""
    n = len(units)
    units = units.astype(np.float32)
    entries = _apart(units, max(1, round(n**0.5 * ENTRIES)))
    if n == 1:
        return np.full((1, 1), -1, np.int32), entries
    ids, sims = _near(units, min(near, n - 1))
    kept = _chosen(units, ids, sims, links)
    source, place = np.nonzero(kept)
    target, sim = ids[source, place].astype(np.int64), sims[source, place]
    # forward links first, then backward ones by similarity, as many again
    pairs = np.concatenate((source * n + target, target * n + source))
    rank = np.concatenate((np.zeros(len(sim)), np.ones(len(sim))))
    order = np.lexsort((-np.concatenate((sim, sim)), rank, pairs // n))
    pairs = pairs[order]
    _, first = np.unique(pairs, return_index=True)
    pairs = pairs[np.sort(first)]
    count = np.bincount(pairs // n, minlength=n)
    pairs = pairs[np.arange(len(pairs)) - np.repeat(np.cumsum(count) - count, count) < 2 * links]
    graph = _padded(pairs // n, pairs % n, n)
    seen = np.zeros(n, bool)
    _reached(graph, entries, seen)
    more = []
    while not seen.all():
        lost = int(np.argmin(seen))
        known = np.flatnonzero(seen)
        more.append((int(known[np.argmax(units[known] @ units[lost])]), lost))
        _reached(graph, np.array([lost]), seen)
    if more:
        pairs = np.concatenate((pairs, [a * n + b for a, b in more]))
        pairs = pairs[np.argsort(pairs // n, kind="stable")]
        graph = _padded(pairs // n, pairs % n, n)
    return graph, entries


def walk(units: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, ef: int, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of each query's beam, -1 where there are fewer; how many nodes were scored); single precision.

    A query doesn't meet its ``hidden`` node.
    """
    m, every = len(queries), np.arange(len(queries))
    width = max(ef, len(entries))
    ids, sims, done = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf, np.float32), np.ones((m, width), bool)
    seen, scored = np.zeros((m, len(units)), bool), np.full(m, len(entries))
    ids[:, : len(entries)], sims[:, : len(entries)], done[:, : len(entries)] = entries, queries @ units[entries].T, False
    seen[:, entries] = True
    if hidden is not None:
        at = np.nonzero(ids == hidden[:, None])
        ids[at], sims[at], done[at] = -1, -np.inf, True
        seen[every, hidden] = True
    while True:
        open_ = np.where(done, -np.inf, sims)
        at = open_.argmax(axis=1)
        rows = np.flatnonzero(open_[every, at] > -np.inf)
        if not len(rows):
            return ids, scored
        done[rows, at[rows]] = True
        next_ = graph[ids[rows, at[rows]]]
        new = (next_ >= 0) & ~seen[rows[:, None], next_]
        r, c = np.nonzero(new)
        node = next_[r, c]
        seen[rows[r], node] = True
        scored[rows] += new.sum(axis=1)
        found = np.full(next_.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", queries[rows[r]], units[node])
        all_ids, all_sims, all_done = np.hstack((ids[rows], next_)), np.hstack((sims[rows], found)), np.hstack((done[rows], ~new))
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        ids[rows] = np.where(sims[rows] > -np.inf, ids[rows], -1)


def beam_width(units: np.ndarray, graph: np.ndarray, entries: np.ndarray, unlike: bool = False) -> int:
    """The narrowest beam that finds enough neighbours; the whole shard if none does."""
    n, rng = len(units), np.random.default_rng(2)
    if n <= BEAMS[0]:
        return n
    drawn = rng.choice(n, min(TRIED, n), replace=False)
    queries, k = units[drawn], min(NEIGHBOURS, n - 1)
    if not unlike:
        queries = _units(queries + rng.normal(0, DISTURBED / queries.shape[1] ** 0.5, queries.shape)).astype(np.float32)
    scores = queries @ units.T
    if unlike:
        scores[np.arange(len(drawn)), drawn] = -np.inf
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    for ef in BEAMS:
        if ef >= n:
            break
        ids, _ = walk(units, graph, entries, queries, ef, drawn if unlike else None)
        found = np.where(ids >= 0, np.take_along_axis(scores, np.maximum(ids, 0), 1), -np.inf)
        best = np.take_along_axis(ids, np.argpartition(-found, k - 1, axis=1)[:, :k], 1)
        if np.mean([len(np.intersect1d(a, b)) for a, b in zip(best, true, strict=True)]) >= RECALL * k:
            return ef
    return n


def _built(run: str, unlike: bool) -> Callable:
    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        dims, number = key[0].as_py(), key[1].as_py()
        values = rows.column("embedding").combine_chunks()
        vectors = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        nodes, node_of = np.unique(vectors, axis=0, return_inverse=True)
        ids = rows.column("chunk_index").to_numpy()
        order = np.lexsort((ids, node_of.reshape(-1)))
        units = _units(nodes).astype(np.float32)
        graph, entries = graph_of(units)
        ef = beam_width(units, graph, entries, unlike)
        binary = [ids[order].astype("<i8"), node_of.reshape(-1)[order].astype("<i4"), nodes.astype(nodes.dtype.newbyteorder("<")), graph.astype("<i4"), entries.astype("<i4")]
        return pa.table([[f"{run}-{dims}-{number}"], [dims], [len(ids)], [ef], *([x.tobytes()] for x in binary)], schema=_SCHEMA)

    return build


# Searching


_FOUND = pa.schema([("query", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64()), ("scored", pa.int64()), ("vectors", pa.int64())])


def _best_of_shard(row: dict, kind: str, queries: np.ndarray, k: int, ef: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, ids, cosines, nodes scored) for each query."""
    dims = row["dims"]
    ids, node_of = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nodes"], "<i4")
    units = _units(np.frombuffer(row["vectors"], kind).reshape(-1, dims))
    graph, entries = np.frombuffer(row["links"], "<i4").reshape(len(units), -1), np.frombuffer(row["entries"], "<i4")
    begin, count = np.searchsorted(node_of, np.arange(len(units))), np.bincount(node_of, minlength=len(units))
    width = max(k, row["ef"] if ef is None else ef)
    single = units.astype(np.float32)
    for low in range(0, len(queries), STEP_QUERIES):
        block = queries[low : low + STEP_QUERIES]
        if width >= len(units):
            beams, scored = np.broadcast_to(np.arange(len(units)), (len(block), len(units))), np.full(len(block), len(units))
        else:
            beams, scored = walk(single, graph, entries, block.astype(np.float32), width)
        for q, nodes in enumerate(beams):
            nodes = nodes[nodes >= 0]
            scores = np.round(units[nodes] @ block[q], dense.SCORE_DIGITS + 6)
            if len(nodes) > k:  # all that tie for the last place
                rounded = np.round(scores, dense.SCORE_DIGITS)
                keep = rounded >= np.partition(rounded, len(nodes) - k)[len(nodes) - k]
                nodes, scores = nodes[keep], scores[keep]
            # of equal vectors the smallest ids
            taken = np.minimum(count[nodes], k)
            ends = np.cumsum(taken)
            members = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[nodes] - ends + taken, taken)
            yield low + q, ids[members], np.repeat(scores, taken), int(scored[q])


def _search(queries: np.ndarray, kind: str, k: int, ef: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if row["dims"] != queries.shape[1]:
                    continue
                parts: list[list] = [[], [], [], [], []]
                for q, ids, scores, scored in _best_of_shard(row, kind, queries, k, ef):
                    # a row without a chunk has the counts
                    for part, values in zip(parts, ([q] * (len(ids) + 1), [*ids.tolist(), None], [*scores.tolist(), None], [0] * len(ids) + [scored], [0] * len(ids) + [row["n"]]), strict=True):
                        part += values
                yield pa.RecordBatch.from_arrays([pa.array(p, f.type) for p, f in zip(parts, _FOUND, strict=True)], schema=_FOUND)

    return run


def _usable(embedding: str) -> Column:
    x = F.col(embedding)
    return x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


@dataclass(frozen=True)
class GraphIndex:
    graphs: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, shard_rows: int = SHARD_ROWS, unlike: bool = False) -> GraphIndex:
        """The graphs of vectors (chunk_index, embedding), written once to the shared folder."""
        rows = vectors.where(F.col("chunk_index").isNotNull() & _usable("embedding")).select(F.col("chunk_index").cast("long").alias("chunk_index"), F.col("embedding").cast("array<float>").alias("embedding"))
        shards = max(1, -(-rows.count() // shard_rows))
        # dealt by id and content, so that an id that occurs often doesn't fill a shard
        dealt = rows.withColumn("dims", F.size("embedding")).withColumn("part", F.pmod(F.xxhash64("chunk_index", "embedding"), F.lit(shards)).cast("int"))
        return cls(materialized(dealt.repartition(shards, "dims", "part").groupBy("dims", "part").applyInArrow(_built(uuid.uuid4().hex, unlike), GRAPHS), "graphs"))

    def tables(self) -> dict[str, DataFrame]:
        return {"graphs": self.graphs}

    def vectors(self) -> DataFrame:
        """(chunk_index, embedding) as they were given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dims, ids, nodes, vectors in zip(*(batch.column(n).to_pylist() for n in ("dims", "ids", "nodes", "vectors")), strict=True):
                    rows = np.frombuffer(vectors, "<f4").reshape(-1, dims)[np.frombuffer(nodes, "<i4")]
                    yield pa.RecordBatch.from_pydict({"chunk_index": pa.array(np.frombuffer(ids, "<i8")), "embedding": pa.array(list(rows), pa.list_(pa.float32()))})

        return self.graphs.mapInArrow(run, "chunk_index long, embedding array<float>")

    def compacted(self, below: int = SHARD_ROWS // 4, shard_rows: int = SHARD_ROWS, unlike: bool = False) -> GraphIndex:
        """Shards of fewer vectors than ``below`` built anew as large ones; the others stay as they are."""
        small = GraphIndex(self.graphs.where(F.col("n") < below))
        return GraphIndex(self.graphs.where(F.col("n") >= below).unionByName(GraphIndex.build(small.vectors(), shard_rows, unlike).graphs))

    def found(self, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
        """(query_id, chunk_index, score, scored, vectors): the shards' hits, and rows without a chunk that count vectors."""
        asked = queries.where(F.col("query_id").isNotNull() & _usable("embedding")).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        groups = max(1, -(-asked.count() // QUERY_ROWS))
        spark, out = queries.sparkSession, []
        for g in range(groups):
            held = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).toArrow()  # a group of queries
            lengths = np.diff(held.column("embedding").combine_chunks().offsets.to_numpy()) if held.num_rows else np.zeros(0, int)
            for dims in np.unique(lengths).tolist():
                chosen = held.filter(pa.array(lengths == dims))
                units = _units(chosen.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dims))
                names = spark.createDataFrame(list(enumerate(chosen.column("query_id").to_pylist())), asked.select(F.lit(0).cast("long").alias("query"), "query_id").schema)
                rows = self.graphs.mapInArrow(_search(units, "<f4", max(k, 1), ef), "query long, chunk_index long, score double, scored long, vectors long")
                out.append(rows.join(F.broadcast(names), "query").drop("query"))
        none = asked.select("query_id", *(F.lit(None).cast(t).alias(n) for n, t in (("chunk_index", "long"), ("score", "double"), ("scored", "long"), ("vectors", "long")))).limit(0)
        return reduce(DataFrame.unionByName, out) if out else none

    def search(self, queries: DataFrame, k: int = 5, ef: int | None = None) -> DataFrame:
        """(query_id, chunk_index, score, rank); with ``ef`` another beam than the shards' own."""
        hits = self.found(queries, k, ef).where("chunk_index IS NOT NULL").withColumn("score", F.round("score", dense.SCORE_DIGITS))
        return dense.ranked(hits.select("query_id", "chunk_index", "score"), k)

    def scored(self, queries: DataFrame, k: int = 5, ef: int | None = None) -> DataFrame:
        """(query_id, scored, vectors): how many vectors a query was compared with, and how many there are."""
        counts = self.found(queries, k, ef).where("chunk_index IS NULL")
        return counts.groupBy("query_id").agg(F.sum("scored").alias("scored"), F.sum("vectors").alias("vectors"))


def load(spark: SparkSession, folder: str) -> GraphIndex:
    """The stored index of ``sources.index_store``."""
    from lodestar.sources.index_store import read_tables

    return GraphIndex(read_tables(spark, folder)["graphs"])
