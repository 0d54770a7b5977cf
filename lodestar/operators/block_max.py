"""Lexical search with early end: postings in blocks that say the most they can add to a score.

Chunks are dealt into shards of bounded size, as they come from the scan, so nothing is shuffled to build an index. In
a shard chunks are put in order of length, and ``WINDOW`` neighbours make a window. A term's postings in one window are a
block. A block keeps its greatest term frequency and its least chunk length, which give an upper bound of its weights
for any parameters and any mean length, also after more chunks were added. The postings themselves are packed.

A query first adds up the bounds of its terms' blocks, window by window, without looking at a posting. Windows are then
opened in order of their bounds, a few at a time, and only what is opened is unpacked and scored; the query ends where no
window left can reach its running k-th score. Some shards are searched first, and the k-th scores found there are
floors for all others. What leaves a shard is at most k rows for each query, so there is never a table of
all queries and chunks.

Ranks are those of ``lexical``: scores rounded to ``SCORE_DIGITS``, ties to the larger chunk. Queries are sent to the tasks
in groups of at most ``QUERY_TERMS`` terms, one group after the other. Chunks without an id are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.plans.session import materialized

#: Chunks and tokens that a shard holds at most (a single longer chunk is a shard), and chunks of a window (at most 256).
SHARD_CHUNKS, SHARD_TOKENS, WINDOW = 16_384, 4_000_000, 16
#: Tokens that are counted at once; what is held of a shard until it is full are counts.
SLICE_TOKENS = 500_000
#: Rows (query, term) of a group of queries.
QUERY_TERMS = 200_000
#: Windows that a query opens first; then twice as many, and so on.
FIRST_WINDOWS = 8
#: Folders that stored blocks are dealt to by their terms.
BUCKETS = 64

BLOCKS = "shard string, term string, n long, windows binary, counts binary, max_tf binary, min_dl binary, places binary, tf binary"
SHARDS = "shard string, n long, tokens long, ids binary, lengths binary"
_BUILT = BLOCKS + ", tokens long, ids binary, lengths binary"
_PLACE, _NUMBER = np.dtype("u1"), np.dtype("<u4")


# Building


def _packed(shard: str, ids: np.ndarray, dl: np.ndarray, owner: np.ndarray, codes: np.ndarray, tf: np.ndarray, terms: list[str], window: int) -> pa.Table:
    """A shard's rows: for each term its blocks, and one without a term for the chunks."""
    order = np.lexsort((ids, dl))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    ids, dl = ids[order], dl[order]
    posting = codes * np.int64(len(ids)) + place[owner]
    by_term = np.argsort(posting)
    posting, tf = posting[by_term], tf[by_term]
    code, at = np.divmod(posting, len(ids))
    in_window = at // window
    starts = np.flatnonzero(np.diff(code * len(ids) + in_window, prepend=-1))
    ends = np.append(starts[1:], len(posting))
    of_term = np.flatnonzero(np.diff(code[starts], prepend=-1))
    counts, most, least = ends - starts, np.maximum.reduceat(tf, starts) if len(starts) else tf, np.minimum.reduceat(dl[at], starts) if len(starts) else tf

    def cut(values: np.ndarray, kind: np.dtype, bounds: np.ndarray) -> pa.Array:
        raw = values.astype(kind).tobytes()
        offsets = np.append(bounds, len(values)).astype(np.int64) * kind.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())

    blocks = pa.table(
        {
            "shard": pa.array([shard] * len(of_term), pa.string()),
            "term": pa.array([terms[c] for c in code[starts][of_term]], pa.string()),
            "n": pa.array(np.diff(np.append(starts[of_term], len(posting))), pa.int64()),
            "windows": cut(in_window[starts], _NUMBER, of_term),
            "counts": cut(counts, _NUMBER, of_term),
            "max_tf": cut(most, _NUMBER, of_term),
            "min_dl": cut(least, _NUMBER, of_term),
            "places": cut(at % window, _PLACE, starts[of_term]),
            "tf": cut(tf, _NUMBER, starts[of_term]),
        }
    )
    own = {"shard": [shard], "n": [len(ids)], "tokens": [int(dl.sum())], "ids": [ids.astype("<i8").tobytes()], "lengths": [dl.astype(_NUMBER).tobytes()]}
    names = [f.split()[0] for f in _BUILT.split(", ")]
    kinds = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in _BUILT.split(", ")])
    return pa.concat_tables([blocks, pa.table(own)], promote_options="permissive").select(names).cast(kinds)


def _built(run: str, wanted: list[str] | None, window: int, shard_chunks: int, shard_tokens: int) -> Callable:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(wanted, pa.string()) if wanted is not None else None
        # of each slice its chunks' ids and lengths, and counts: the chunk's place in the slice, the term's code, how often
        held: list[tuple[np.ndarray, ...]] = []
        vocabulary: dict[str, int] = {}
        size = tokens = made = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, vocabulary, size, tokens, made
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            owner = np.concatenate([h[2] + f for h, f in zip(held, first, strict=False)])
            ids, dl, codes, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3, 4))
            terms, shard = list(vocabulary), f"{run}-{TaskContext.get().partitionId()}-{made}"
            held, vocabulary, size, tokens, made = [], {}, 0, 0, made + 1
            yield from _packed(shard, ids, dl, owner, codes, tf, terms, window).to_batches(max_chunksize=10_000)

        for batch in batches:
            dl, lists = batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            # slices of a batch, so that a shard never grows beyond its bounds
            ends = np.cumsum(dl)
            low = 0
            while low < len(dl):
                before = ends[low - 1] if low else 0
                room, slice_ = (int(x) for x in np.searchsorted(ends, (before + shard_tokens - tokens, before + SLICE_TOKENS), side="right"))
                if room <= low and held:
                    yield from flush()
                    continue
                high = max(low + 1, min(room, slice_, low + shard_chunks - size))
                n, own = high - low, lists.slice(low, high - low)
                flat, owner = own.flatten(), np.repeat(np.arange(n), np.diff(own.offsets.to_numpy()))
                if asked is not None:
                    chosen = pc.is_in(flat, value_set=asked)
                    flat, owner = flat.filter(chosen), owner[chosen.to_numpy(zero_copy_only=False)]
                coded = flat.dictionary_encode()
                codes = np.array([vocabulary.setdefault(t, len(vocabulary)) for t in coded.dictionary.to_pylist()], np.int64)
                found, tf = np.unique(codes[coded.indices.to_numpy()] * n + owner, return_counts=True)
                held.append((batch.column(0).slice(low, n).to_numpy(), dl[low:high], *(x.astype(np.int32) for x in (found % n, found // n, tf))))
                size, tokens, low = size + n, tokens + int(dl[low:high].sum()), high
                if size >= shard_chunks or tokens >= shard_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return build


# Searching


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Half up at the shortest decimal, as Spark rounds; equal scores are rounded once."""
    values, back = np.unique(scores, return_inverse=True)
    unit = Decimal(1).scaleb(-lexical.SCORE_DIGITS)
    return np.array([float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) for x in values.tolist()], np.float64)[back.reshape(-1)]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


@dataclass
class _Shard:
    """A shard's blocks, as they lie packed."""

    ids: np.ndarray
    lengths: np.ndarray
    window: int
    #: For each term of the shard its first block; one more for the end.
    first: dict[str, tuple[int, int]]
    windows: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    bound: np.ndarray
    places: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, own: pa.Table, blocks: pa.Table, window: int, tf_part: Callable) -> _Shard:
        joined = lambda name, kind: np.frombuffer(b"".join(blocks.column(name).to_pylist()), kind)
        counts = joined("counts", _NUMBER).astype(np.int64)
        sizes = np.array([len(x) // _NUMBER.itemsize for x in blocks.column("counts").to_pylist()], np.int64)
        ends = np.cumsum(sizes)
        first = {t: (int(e - s), int(e)) for t, s, e in zip(blocks.column("term").to_pylist(), sizes, ends, strict=True)}
        bound = np.maximum(tf_part(joined("max_tf", _NUMBER).astype(float), joined("min_dl", _NUMBER).astype(float)), 0.0)
        ids, lengths = (np.frombuffer(own.column(n)[0].as_py(), k) for n, k in (("ids", "<i8"), ("lengths", _NUMBER)))
        return cls(ids, lengths, window, first, joined("windows", _NUMBER).astype(np.int64), counts, np.cumsum(counts) - counts, bound, joined("places", _PLACE), joined("tf", _NUMBER))

    def best(self, terms: list[tuple[str, float]], k: int, floor: float, tf_part: Callable) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, rounded scores) of the k best chunks that reach the floor; postings unpacked, and all there are."""
        known = [(*self.first[t], w) for t, w in terms if t in self.first]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0), 0, 0
        blocks = _spread(np.array([a for a, _, _ in known]), np.array([b - a for a, b, _ in known]))
        factor = np.repeat([w for _, _, w in known], [b - a for a, b, _ in known])
        window = self.windows[blocks]
        bounds = np.bincount(window, factor * self.bound[blocks])
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        total, read = int(self.counts[blocks].sum()), 0
        found_ids, found = np.zeros(0, np.int64), np.zeros(0)
        slack = 10.0**-lexical.SCORE_DIGITS
        at, step = 0, FIRST_WINDOWS
        while at < len(order):
            least = max(floor, found[-1] if len(found) == k else -np.inf)
            opened = order[at : at + step]
            opened = opened[bounds[opened] + slack >= least]
            if not len(opened):
                break
            at, step = at + step, step * 2
            number = np.full(len(bounds), -1)
            number[opened] = np.arange(len(opened))
            mine = number[window] >= 0
            chosen = blocks[mine]
            counts = self.counts[chosen]
            posting = _spread(self.begin[chosen], counts)
            local = np.repeat(number[window[mine]], counts) * self.window + self.places[posting]
            chunk = np.repeat(window[mine], counts) * self.window + self.places[posting]
            weight = np.repeat(factor[mine], counts) * tf_part(self.tf[posting].astype(float), self.lengths[chunk].astype(float))
            scores = np.bincount(local, weight, len(opened) * self.window)
            hit = np.flatnonzero(np.bincount(local, minlength=len(opened) * self.window))
            read += len(posting)
            if len(hit) > k:  # those that rounding can't bring among the k best go first
                kth = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
                hit = hit[scores[hit] >= kth - 2 * slack]
            place = opened[hit // self.window] * self.window + hit % self.window
            found_ids, found = np.append(found_ids, self.ids[place]), np.append(found, _rounded(scores[hit]))
            top = np.lexsort((-found_ids, -found))[:k]
            found_ids, found = found_ids[top], found[top]
        kept = found >= floor
        return found_ids[kept], found[kept], read, total


_FOUND = pa.schema([("query", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64()), ("postings_read", pa.int64()), ("postings", pa.int64())])


def _search(queries: list[list[tuple[str, float]]], k: int, floors: np.ndarray, avg_dl: float, k1: float, b: float, delta: float, window: int) -> Callable:
    def tf_part(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl)) + delta

    def run(key: tuple[pa.Scalar, ...], own: pa.Table, blocks: pa.Table) -> pa.Table:
        if not own.num_rows or not blocks.num_rows:
            return _FOUND.empty_table()
        shard = _Shard.of(own, blocks, window, tf_part)
        rows: list[pa.Table] = []
        for q, terms in enumerate(queries):
            ids, scores, read, total = shard.best(terms, k, floors[q], tf_part)
            n = len(ids)
            # a row without a chunk has the counts
            columns = [np.full(n + 1, q), pa.array([*ids.tolist(), None], pa.int64()), pa.array([*scores.tolist(), None], pa.float64()), [0] * n + [read], [0] * n + [total]]
            rows.append(pa.table([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND))
        return pa.concat_tables(rows).combine_chunks() if rows else _FOUND.empty_table()

    return run


@dataclass(frozen=True)
class BlockIndex:
    blocks: DataFrame
    shards: DataFrame

    @classmethod
    def build(cls, chunks: DataFrame, terms: list[str] | None = None, window: int = WINDOW, shard_chunks: int = SHARD_CHUNKS, shard_tokens: int = SHARD_TOKENS) -> BlockIndex:
        """An index of chunks (chunk_index, text), written once to the shared folder; with ``terms`` of these alone."""
        tokens = lexical.tokenized(chunks.where(F.col("chunk_index").isNotNull()).select(F.col("chunk_index").cast("long").alias("chunk_index"), "text"))
        if terms is not None and len(terms) <= lexical.FILTER_TERMS:
            # a few terms are kept by the scan, so that no others are sent to Python; what can't be a token isn't found
            known = ", ".join(f"'{t}'" for t in terms if t.isascii() and t.isalnum())
            kept, terms = F.expr(f"filter(tokens, t -> t IN ({known}))" if known else "slice(tokens, 1, 0)"), None
        else:
            kept = F.col("tokens")
        tokens = tokens.select("chunk_index", F.size("tokens").alias("dl"), kept.alias("tokens"))
        made = materialized(tokens.mapInArrow(_built(uuid.uuid4().hex, terms, window, shard_chunks, shard_tokens), _BUILT), "blocks")
        names = lambda schema: [f.split()[0] for f in schema.split(", ")]
        return cls(made.where("term IS NOT NULL").select(*names(BLOCKS)), made.where("term IS NULL").select(*names(SHARDS)))

    def tables(self) -> dict[str, DataFrame]:
        """For ``sources.index_store``: blocks in folders by their terms' hash, so that a search reads those of its terms."""
        return {"blocks": self.blocks.withColumn("bucket", bucket_of(F.col("term"))).hint("rebalance", "bucket"), "shards": self.shards}

    def _statistics(self, held: DataFrame) -> tuple[dict[str, int], int, int, int]:
        """(frequencies of the terms held, number of chunks, of tokens and of shards)"""
        none = F.lit(0).cast("long")
        own = self.shards.select(F.lit(None).cast("string").alias("term"), "n", "tokens", F.lit(1).cast("long").alias("shards"))
        rows = held.select("term", "n", none.alias("tokens"), none.alias("shards")).unionByName(own)
        found = {r["term"]: r for r in rows.groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("shards").alias("shards")).collect()}
        whole = found.pop(None, None)
        return {t: r["n"] for t, r in found.items()}, *((whole["n"], whole["tokens"], whole["shards"]) if whole else (0, 0, 0))

    def _of(self, wanted: list[str]) -> DataFrame:
        """The blocks of a group's terms."""
        blocks, spark = self.blocks, self.blocks.sparkSession
        terms = spark.createDataFrame([(t,) for t in wanted], "term string")
        if "bucket" in blocks.columns:
            buckets = [r[0] for r in terms.select(bucket_of(F.col("term"))).distinct().collect()]  # at most BUCKETS
            blocks = blocks.where(F.col("bucket").isin(buckets)).drop("bucket")
        if len(wanted) <= lexical.FILTER_TERMS:
            return blocks.where(F.col("term").isin(wanted))
        return blocks.join(F.broadcast(terms), "term", "left_semi")  # at most QUERY_TERMS

    def found(self, queries: DataFrame, k: int = 10, k1: float = lexical.K1, b: float = lexical.B, delta: float = lexical.DELTA, window: int = WINDOW) -> DataFrame:
        """(query_id, chunk_index, score, postings_read, postings): the hits before the last cut, and rows without a chunk that count postings."""
        groups = max(1, -(-lexical.query_terms(queries).count() // QUERY_TERMS))
        parts = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) for g in range(groups)] if groups > 1 else [queries]
        return reduce(DataFrame.unionByName, [self._found(part, asked_by(part), k, k1, b, delta, window) for part in parts])

    def _found(self, queries: DataFrame, asked: Asked, k: int, k1: float, b: float, delta: float, window: int) -> DataFrame:
        spark, ids = queries.sparkSession, list(asked)
        held = self._of(sorted({t for ts in asked.values() for t, _ in ts}))
        df, n, tokens, n_shards = self._statistics(held)
        avg_dl = tokens / n if tokens else 1.0
        idf = {t: float(np.log(1.0 + (n - x + 0.5) / (x + 0.5))) for t, x in df.items()}
        weighted = [[(t, qtf * idf[t]) for t, qtf in asked[q] if t in idf] for q in ids]

        def search(shards: DataFrame, blocks: DataFrame, floors: np.ndarray) -> DataFrame:
            kernel = _search(weighted, max(k, 1), floors, avg_dl, k1, b, delta, window)
            shards = shards.select(*(F.col(c).alias(c) for c in shards.columns))  # the two sides must not share columns' identities
            shards, blocks = (side.repartition(n_parts, "shard") for side in (shards, blocks))
            return shards.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(kernel, "query long, chunk_index long, score double, postings_read long, postings long")

        # packed blocks are small for the work there is on them: tasks by the number of shards, not by bytes
        n_parts = max(1, min(4 * n_shards, 4 * spark.sparkContext.defaultParallelism))
        none = np.full(len(ids), -np.inf)
        first = round(n_shards**0.5)
        if n_shards <= 16 or k <= 0:
            rows = search(self.shards, held, none)
        else:  # a few shards by their hash, then the others with floors
            lot = F.pmod(F.xxhash64("shard"), F.lit(n_shards)) < first
            start = materialized(search(self.shards.where(lot), held.where(lot), none), "first-hits")
            best = lexical.ranked(start.where("chunk_index IS NOT NULL").withColumnRenamed("query", "query_id"), k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
            floors = none.copy()
            for r in best.where(F.col("n") == k).collect():  # a number for each query of the group
                floors[r["query_id"]] = r["floor"]
            rows = start.unionByName(search(self.shards.where(~lot), held.where(~lot), floors))
        names = spark.createDataFrame(list(enumerate(ids)), queries.select(F.lit(0).cast("long").alias("query"), "query_id").schema)
        return rows.join(F.broadcast(names), "query").drop("query")  # a group of queries

    def search(self, queries: DataFrame, k: int = 10, k1: float = lexical.K1, b: float = lexical.B, delta: float = lexical.DELTA, window: int = WINDOW) -> DataFrame:
        """(query_id, chunk_index, score, rank); chunks that share no term with a query aren't hits."""
        hits = self.found(queries, k, k1, b, delta, window).where("chunk_index IS NOT NULL")
        return lexical.ranked(hits.select("query_id", "chunk_index", "score"), k)

    def opened(self, queries: DataFrame, k: int = 10, window: int = WINDOW) -> DataFrame:
        """(query_id, postings_read, postings): how many postings of its terms a query unpacked, and how many there are."""
        counts = self.found(queries, k, window=window).where("chunk_index IS NULL")
        return counts.groupBy("query_id").agg(F.sum("postings_read").alias("postings_read"), F.sum("postings").alias("postings"))


def load(spark: SparkSession, folder: str) -> BlockIndex:
    """The stored index of ``sources.index_store``; an error that says so if there is none."""
    from lodestar.sources.index_store import read_tables

    tables = read_tables(spark, folder)
    if tables is None:
        raise lexical.NotIndexedError(f"not indexed: no manifest in {folder}")
    return BlockIndex(tables["blocks"], tables["shards"])


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


Asked = dict[object, list[tuple[str, int]]]


def asked_by(queries: DataFrame) -> Asked:
    """The terms of a group of queries, with how often each is asked for."""
    out: Asked = {}
    for r in lexical.query_terms(queries).collect():  # a group has at most QUERY_TERMS
        out.setdefault(r["query_id"], []).append((r["term"], r["qtf"]))
    return out


def search_texts(chunks: DataFrame, queries: DataFrame, k: int = 10, k1: float = lexical.K1, b: float = lexical.B, delta: float = lexical.DELTA) -> DataFrame:
    """The hits of an index that is made for the queries' terms alone; of all terms where the queries have more than a group's.

    Without any term there are no hits, and no index is made.
    """
    terms = lexical.query_terms(queries).limit(QUERY_TERMS + 1)
    n_terms = terms.count()
    if not n_terms:
        none = queries.sparkSession.createDataFrame([], "chunk_index long, score double, rank long")
        return none.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "*")
    if n_terms > QUERY_TERMS:
        return BlockIndex.build(chunks).search(queries, k, k1, b, delta)
    asked = asked_by(queries)
    index = BlockIndex.build(chunks, sorted({t for ts in asked.values() for t, _ in ts}))
    hits = index._found(queries, asked, k, k1, b, delta, WINDOW).where("chunk_index IS NOT NULL")
    return lexical.ranked(hits.select("query_id", "chunk_index", "score"), k)
