"""Packing documents into training windows by lexical retrieval.

A document's ids fill as many whole windows as they can by themselves; what remains is shorter than a window.
Remainders are dealt out by content into shards of about ``SHARD_DOCS`` documents: their BM25 weights, projected
onto ``DIMS`` random directions, descend a tree of centroids that is fitted on a bounded sample, small leaves are
joined with the next and hot ones split by a hash. Each shard builds a BM25 inverted index over its remainders, with
token ids as terms and the document frequencies and mean length of the whole table. So like documents mostly meet,
but a seed sees its own shard only; README.md has the measured share of its neighbours in the whole table that it
finds there. The longest unused remainder is the seed of a window; the index returns its unused neighbours by score, and those that fit are placed. Room that is
left then takes the head of the best neighbour that is still unused (of any remainder, if none shares a term),
and its tail goes on as a remainder. So only a shard's last window has room; it is split into windows of
powers of two, which need no padding.

Null and empty texts have the end id only. A query uses all ids of the seed. Rows with null ids are packed as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_stored, stored
from lodestar.llm.kernels import mix, slices
from lodestar.llm.tokens import library_tokenizer

WINDOW = 1024
SHARD_DOCS = 2048
K1, B = 1.5, 0.75
#: The most terms of a shard with a row of weights.
ROWS = 2048
#: Directions that remainders are projected onto, children of a node of the tree, and the most remainders it is fitted on.
DIMS, BRANCHES, SAMPLE = 256, 128, 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Statistics:
    """Document frequencies and lengths of the whole table's remainders."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.mean = n, max(1.0, tokens / max(1, n))
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))


class InvertedIndex:
    """BM25 postings over the documents of a shard, sorted by term; ``whole`` are the statistics of all shards."""

    def __init__(self, docs: list[np.ndarray], k1: float = K1, b: float = B, whole: Statistics | None = None):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], np.float64)
        flat = np.concatenate(docs).astype(np.int64)
        keys = flat * self.n + np.repeat(np.arange(self.n), lengths.astype(np.int64))
        keys, tf = np.unique(keys, return_counts=True)
        term, self.doc = keys // self.n, (keys % self.n).astype(np.int32)
        self.terms, starts, df = np.unique(term, return_index=True, return_counts=True)
        self.starts = np.append(starts, len(keys))
        self.df = df
        idf = whole.idf[self.terms] if whole else np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lengths / (whole.mean if whole else max(1.0, lengths.mean())))
        self.weight = np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[self.doc])
        # the terms of most documents have a row of weights each, which adds faster than postings
        self.row = np.full(len(df), -1)
        often = np.argsort(-df, kind="stable")[:ROWS]
        often = often[df[often] * 32 > self.n]
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), np.float32)
        for i, t in enumerate(often):
            part = slice(self.starts[t], self.starts[t + 1])
            self.rows[i, self.doc[part]] = self.weight[part]

    def scores(self, ids: np.ndarray, terms: int | None = None) -> np.ndarray:
        """The score of every document for the terms of ``ids`` that other documents hold too, or the rarest of them."""
        at = np.searchsorted(self.terms, np.unique(ids))
        at = at[self.df[at] > 1]
        at = at[np.argsort(self.df[at], kind="stable")[:terms]]
        out = np.add.reduce(self.rows[self.row[at[self.row[at] >= 0]]], axis=0).astype(np.float64)
        parts = [slice(self.starts[i], self.starts[i + 1]) for i in at[self.row[at] < 0]]
        if parts:
            out += np.bincount(np.concatenate([self.doc[p] for p in parts]), weights=np.concatenate([self.weight[p] for p in parts]), minlength=self.n)
        return out


def _directions(n: int) -> np.ndarray:
    """DIMS signs for each of n terms."""
    x = np.arange(n, dtype=np.uint64)[:, None] * np.uint64(DIMS) + np.arange(DIMS // 64, dtype=np.uint64)
    bits = np.unpackbits(mix(x + np.uint64(1)).astype("<u8").view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def projected(docs: list[np.ndarray], whole: Statistics, directions: np.ndarray) -> np.ndarray:
    """The BM25 weights of each document along the directions: whole numbers, so that any order of sums gives the same."""
    out = np.zeros((len(docs), DIMS), np.float32)
    for i, d in enumerate(docs):
        if len(d):
            term, tf = np.unique(d, return_counts=True)
            weight = np.rint(16 * whole.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / whole.mean)))
            out[i] = weight.astype(np.float32) @ directions[term].astype(np.float32)
    return out


class ContentTree:
    """Leaves of like documents: k-means, again within each cluster, until a leaf stands for about one shard."""

    def __init__(self, sample: np.ndarray, leaves: int):
        x = sample[np.lexsort(sample.T)]
        self.mean = np.rint(x.mean(axis=0, dtype=np.float64)) if len(x) else np.zeros(DIMS)
        self.nodes: list[tuple[np.ndarray, list[int]] | int] = []
        self.leaves = 0
        x = x - self.mean.astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + np.float32(1e-9)
        self._grow(x, leaves, 12, np.random.default_rng(0))

    def _grow(self, x: np.ndarray, leaves: int, depth: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(self.leaves)
        n = min(leaves, BRANCHES, len(x))
        if n > 1 and depth:
            centre = x[rng.choice(len(x), n, replace=False)]
            for _ in range(8):
                label = np.argmax(x @ centre.T, axis=1)
                for i in range(n):
                    if (label == i).any():
                        centre[i] = x[label == i].mean(axis=0)
                        centre[i] /= np.linalg.norm(centre[i]) + 1e-9
            centre = np.rint(1024 * centre).astype(np.float64)  # whole numbers here too: a document's leaf is the same on any machine
            label = np.argmax(x @ centre.T, axis=1)
            below = []
            for i in range(n):
                mine = x[label == i]
                below.append(self._grow(mine, round(leaves * len(mine) / len(x)), depth - 1, rng))
            self.nodes[at] = (centre, below)
        else:
            self.leaves += 1
        return at

    def leaf(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64) - self.mean
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
                continue
            label = np.argmax(x[rows] @ node[0].T, axis=1)
            todo += [(child, rows[label == i]) for i, child in enumerate(node[1]) if (label == i).any()]
        return out


def shards_of_leaves(counts: np.ndarray, shard_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each leaf: small leaves share one with the next, large ones have several."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    shard = held = 0
    for i, n in enumerate(counts):
        if held and held + n > 1.5 * shard_docs:
            shard, held = shard + 1, 0
        first[i], parts[i] = shard, max(1, round(n / shard_docs))
        held += n
        if held >= shard_docs / 2:
            shard, held = shard + int(parts[i]), 0
    return first, parts


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, terms: int | None = None, whole: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, first id, number of ids); every id of ``docs`` (each shorter than a window) is in one."""
    index = InvertedIndex(docs, whole=whole)
    length = np.array([len(d) for d in docs])
    start = np.zeros(len(docs), np.int64)
    unused = length > 0
    by_length = np.argsort(-length, kind="stable")
    next_seed = 0
    tails: list[int] = []  # remainders that have been cut, to be used as seeds before others
    out: list[list[tuple[int, int, int]]] = []
    while True:
        seed = -1
        while tails and seed < 0:
            seed = tails.pop() if unused[tails[-1]] else (tails.pop(), -1)[1]
        while seed < 0 and next_seed < len(by_length):
            if unused[by_length[next_seed]]:
                seed = int(by_length[next_seed])
            next_seed += 1
        if seed < 0:
            return out
        unused[seed] = False
        pieces, room = [(seed, int(start[seed]), int(length[seed]))], window - int(length[seed])
        if room:
            score = index.scores(docs[seed], terms)
            order = np.flatnonzero(unused)
            order = order[np.argsort(-score[order], kind="stable")]
            fits = order[(length[order] <= room) & (score[order] > 0)]
            while room and len(fits):
                d = int(fits[0])
                pieces.append((d, int(start[d]), int(length[d])))
                unused[d] = False
                room -= int(length[d])
                fits = fits[1:]
                fits = fits[length[fits] <= room]
            for d in map(int, order):  # the best that is left is cut, or taken whole where it fits after all
                if not room:
                    break
                if not unused[d]:
                    continue
                n = min(room, int(length[d]))
                pieces.append((d, int(start[d]), n))
                start[d] += n
                length[d] -= n
                room -= n
                unused[d] = length[d] > 0
                if unused[d]:
                    tails.append(d)
        if not room:
            out.append(pieces)
            continue
        # nothing is left to fill it: windows of powers of two hold the same ids without padding
        total, at = window - room, 0
        flat = list(pieces)
        for bit in range(window.bit_length() - 1, -1, -1):
            size = 1 << bit
            if not total & size:
                continue
            part, need = [], size
            while need:
                d, first, n = flat[at]
                take = min(need, n)
                part.append((d, first, take))
                flat[at] = (d, first + take, n - take)
                at += n == take
                need -= take
            out.append(part)


def _encoded(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = library_tokenizer(path)
        width = np.dtype(tokenizer.dtype).itemsize
        end = np.array([end_id], tokenizer.dtype)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                n, crcs, rest = [], [], []
                for ids in tokenizer.encode_rows(part.column(1)):
                    whole = np.append(ids, end)
                    full = len(whole) // window
                    n.append(len(whole))
                    crcs.append(np.array([_crc(whole[i * window : (i + 1) * window]) for i in range(full)], "<u4").tobytes())
                    rest.append(whole[full * window :].tobytes())
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.binary()), pa.array(rest, pa.binary()), pa.array([width] * len(n), pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "doc_tokens", "crcs", "rest", "width"])
        tokenizer.forget()  # the worker may serve other operators next

    return run


def _remainders(rest: pa.Array, width: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{w}") for x, w in zip(rest.to_pylist(), width.to_pylist(), strict=True)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many remainders of a task each term occurs; term -1 has the remainders, term -2 their ids."""
    df, n, tokens = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        docs = [d for d in _remainders(batch.column(0), batch.column(1)) if len(d)]
        n, tokens = n + len(docs), tokens + sum(map(len, docs))
        for low in range(0, len(docs), 1024):
            found = np.bincount(np.concatenate([np.unique(d) for d in docs[low : low + 1024]]))
            if len(found) > len(df):
                df, found = found, df
            df[: len(found)] += found
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, tokens]))], ["term", "n"])


def _leaves(whole: Statistics, tree: ContentTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = _directions(len(whole.idf)) if tree.leaves > 1 else None
        for batch in batches:
            docs = _remainders(batch.column(3), batch.column(4))
            leaf = np.zeros(len(docs), np.int64) if directions is None else tree.leaf(projected(docs, whole, directions))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), *batch.columns], ["leaf", *batch.schema.names])

    return run


def _pack(window: int, terms: int | None, whole: Statistics):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "rest", "crcs"], kind="stable", na_position="first")  # any attempt packs alike
        ids = list(pdf["doc_id"])
        tokens = pdf["doc_tokens"].to_numpy()
        rest = [np.frombuffer(x, f"<u{w}") for x, w in zip(pdf["rest"], pdf["width"], strict=True)]
        rows = []
        sequence = int(key[0]) << 32
        for i, crcs in enumerate(pdf["crcs"]):
            for j, crc in enumerate(np.frombuffer(crcs, "<u4")):
                rows.append((ids[i], j * window, window, int(crc), tokens[i], sequence, 0))
                sequence += 1
        some = [i for i in range(len(rest)) if len(rest[i])]
        first = tokens - np.array([len(r) for r in rest])
        if some:
            for pieces in pack_shard([rest[i] for i in some], window, terms, whole):
                at = 0
                for d, start, n in pieces:
                    i = some[d]
                    rows.append((ids[i], first[i] + start, n, _crc(rest[i][start : start + n]), tokens[i], sequence, at))
                    at += n
                sequence += 1
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
    query_terms: int | None = None,
) -> DataFrame:
    """One row for each piece: which ids of which document lie where in which sequence.

    sequence_id holds the shard in its upper half and counts within it, so no step numbers all sequences.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    columns = "doc_id long, doc_tokens long, crcs binary, rest binary, width int"
    encoded = stored(rows.mapInArrow(_encoded(path, end_id, window), columns), "remainders")
    found = encoded.select("rest", "width").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(max(0, int(found["term"].max() if len(found) else 0)) + 1, np.int64)
    terms = found[found["term"] >= 0]
    df[terms["term"].to_numpy(np.int64)] = terms["n"].to_numpy(np.int64)
    n, tokens = (int(found.loc[found["term"] == x, "n"].sum()) for x in (-1, -2))
    whole = Statistics(n, tokens, df)
    shards = max(1, -(-encoded.count() // shard_docs))
    sample = np.zeros((0, DIMS), np.float32)
    if shards > 1:
        step = max(1, n // min(SAMPLE, 128 * shards))
        drawn = encoded.where((F.length("rest") > 0) & (F.pmod(F.xxhash64("rest"), F.lit(step)) == 0)).select("rest", "width").distinct().limit(SAMPLE).toPandas()
        sample = projected([np.frombuffer(x, f"<u{w}") for x, w in zip(drawn["rest"], drawn["width"], strict=True)], whole, _directions(len(df)))
    tree = ContentTree(sample, shards)
    dealt = stored(encoded.mapInArrow(_leaves(whole, tree), "leaf int, " + columns), "dealt")
    drop_stored(encoded)
    counts = np.zeros(tree.leaves, np.int64)
    for leaf, count in dealt.groupBy("leaf").count().collect():
        counts[leaf] = count
    first, parts = shards_of_leaves(counts, shard_docs)
    plan = dealt.sparkSession.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, parts, strict=True))], "leaf int, first int, parts int")
    # a leaf of several shards is spread row by row, whatever its rows have in common; ``dealt`` is a stored table, so the
    # numbers are the same in any attempt
    salt = F.xxhash64(F.monotonically_increasing_id())
    dealt = dealt.withColumn("salt", salt)
    shard = F.col("first") + F.pmod("salt", F.col("parts")).cast("int")
    dealt = dealt.join(F.broadcast(plan), "leaf").select(shard.alias("shard"), "doc_id", "doc_tokens", "crcs", "rest", "width")
    return dealt.groupBy("shard").applyInPandas(_pack(window, query_terms, whole), PIECES)
