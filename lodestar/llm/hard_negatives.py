"""Hard-negative mining by a vector-approximation file.

Every dimension is cut into ``2 ** bits`` cells, at quantiles of a sample of about ``SAMPLE_ROWS`` vectors; the outer
cells end at the least and greatest value of all rows. A row's approximation is the cell of each component, one byte
each, and these bytes are the file that is searched. For an anchor each cell has a lower and an upper bound of
``anchor component x value``; a table of them is made for each anchor, and a row's bounds are sums of entries looked up
by its bytes. A row is a candidate of a window of scores if its bounds reach into it and its upper bound isn't below
the k-th best score that is sure to lie there. Only candidates are joined with their vectors and scored exactly.

Two searches run this way: the positives (the best rows of the anchor's label; a window without ends), then the
negatives (the best rows of other labels whose score lies in the window that a positive's score opens; all windows of
an anchor in one pass). Anchors and rows are dealt into groups, and each pair of groups is a task. The first group of
rows is searched before the others, and the exact scores found there are floors for the rest. Of rows that agree in
label and vector only as many as can be returned, those of the smallest ids, are candidates; no other of them could.

Components are integers after ``floor(256 * x)``. Vectors with components beyond 16 bits, and those of other lengths
than the ``GRID_LENGTHS`` most frequent ones, have no approximation: all their pairs are scored exactly, with integers of
any size. A score beyond 64 bits is given as the nearest 64-bit integer after it has been ranked exactly.

Rows without id, label or vector, or with a null or non-finite component, take no part. Rows whose vectors differ in
length don't meet. A row that shares the anchor's id is not one of its positives. Anchors that share an id are anchors
of their own, whose rows stand side by side. An anchor without positives, or a positive without rows in its window, has
no rows. Equal scores rank by the smaller id. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stored

SCALE = 256.0
BITS = 6
SAMPLE_ROWS = 20_000
GRID_LENGTHS = 64
GROUP_ROWS, GROUP_ANCHORS = 50_000, 1_000
#: Anchors whose tables are looked up together, and rows of one lookup.
_ANCHORS, _ROWS = 32, 4096

_LONG = 2**63
_WINDOW = pa.list_(
    pa.struct([("w", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("positive_exact", pa.string()), ("floor", pa.float64())])
)
_PAIR = pa.schema([("anchor", pa.int64()), ("row", pa.int64())])
_SCORED = pa.schema(
    [("anchor", pa.int64()), ("w", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("positive_exact", pa.string())]
    + [("id", pa.int64()), ("score", pa.int64()), ("exact", pa.string())]
)


# The grid and the approximations


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of this partition's vectors the least and greatest value of every dimension."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        dims_of = rows.column("dims").to_numpy()
        for dims in np.unique(dims_of).tolist():
            values = _matrix(rows.filter(pa.array(dims_of == dims)).column("small"), dims)
            low, high = found.get(dims, (values[0], values[0]))
            found[dims] = np.minimum(low, values.min(axis=0)), np.maximum(high, values.max(axis=0))
    if found:
        lows, highs = zip(*found.values(), strict=True)
        yield pa.RecordBatch.from_pydict({"dims": pa.array(found, pa.int32()), "low": pa.array(lows, pa.list_(pa.int16())), "high": pa.array(highs, pa.list_(pa.int16()))})


def _grid(cells: int) -> Callable:
    """(dims, edges): the cells' first values and last values, as 32-bit integers, dimension by dimension."""

    def run(key: tuple[pa.Scalar, ...], ranges: pa.Table, sample: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        low, high = _matrix(ranges.column("low"), dims).min(axis=0).astype(np.int32), _matrix(ranges.column("high"), dims).max(axis=0).astype(np.int32)
        values = np.sort(_matrix(sample.column("small"), dims).astype(np.int32), axis=0) if sample.num_rows else np.stack([low, high])
        cuts = values[np.arange(1, cells) * len(values) // cells]
        first, after = np.vstack([low[None], cuts]), np.vstack([cuts, high[None] + 1])
        edges = np.stack([first, after - 1], axis=0).astype(np.int32)
        return pa.table({"dims": pa.array([dims], pa.int32()), "edges": pa.array([edges.tobytes()], pa.binary())})

    return run


def _approximate(grids: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            dims_of, narrow = rows.column("dims").to_numpy(), ~rows.column("wide").to_numpy(zero_copy_only=False)
            codes = np.full(len(dims_of), None, object)
            for dims in np.unique(dims_of[narrow]).tolist():
                if dims in grids:
                    chosen = np.flatnonzero(narrow & (dims_of == dims))
                    values, cuts = _matrix(rows.take(pa.array(chosen)).column("small"), dims), grids[dims][0, 1:]
                    cells = np.stack([np.searchsorted(cuts[:, d], values[:, d], side="right") for d in range(dims)], axis=1).astype(np.uint8)
                    codes[chosen] = [c.tobytes() for c in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("row", "id", "label", "dims", "wide")), pa.array(codes, pa.binary())], ["row", "id", "label", "dims", "wide", "codes"])

    return run


def bounds(anchors: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products, rows x anchors, by lookup in each anchor's table.

    ``codes`` are rows x dimensions, ``edges`` (first value, last value) x cells x dimensions.
    """
    n, m = len(codes), len(anchors)
    first, last = edges.astype(np.float64)
    most = (np.abs(anchors).max(initial=0) * np.maximum(np.abs(first), np.abs(last)).max(initial=0)) * max(1, codes.shape[1])
    kind = np.float32 if most < 2**24 else np.float64  # sums of integers below the limit are exact
    tables = []
    for d in range(codes.shape[1]):
        a, b = np.outer(first[:, d], anchors[:, d]), np.outer(last[:, d], anchors[:, d])
        tables.append(np.hstack([np.minimum(a, b), np.maximum(a, b)]).astype(kind))
    out = np.zeros((n, 2 * m), kind)
    upright = np.ascontiguousarray(codes.T)
    for low in range(0, n, _ROWS):
        part = out[low : low + _ROWS]
        for table, code in zip(tables, upright, strict=True):
            part += table.take(code[low : low + _ROWS], axis=0)
    return out[:, :m], out[:, m:]


# Candidates


def _slack(x: float) -> float:
    """What covers the rounding of a window's ends, which are fractions of a score."""
    return 1.0 + abs(x) * 1e-9


def window_candidates(lower: np.ndarray, upper: np.ndarray, low: float, high: float, floor: float, k: int) -> np.ndarray:
    """Which rows may be among the k best with a score from ``low`` to ``high``."""
    under, over = (_slack(x) if math.isfinite(x) else 0.0 for x in (low, high))
    may = (upper >= max(low - under, floor)) & (lower <= high + over)
    sure = lower[(lower >= low + under) & (upper <= high - over)]
    if len(sure) >= k:
        may &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
    return may


def _candidates(grids: dict[int, np.ndarray], k: int, same: bool, ends: tuple[float, float]) -> Callable:
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _PAIR.empty_table()
        dims = key[0].as_py()
        edges, coded = grids.get(dims), right.column("codes").null_count == 0
        row_ids, rows = right.column("id").to_numpy(), right.column("row").to_numpy()
        anchor_ids, anchors = left.column("id").to_numpy(), left.column("row").to_numpy()
        names = pa.chunked_array([*left.column("label").chunks, *right.column("label").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        anchor_labels, row_labels = names[: len(anchors)], names[len(anchors) :]
        windows = left.column("windows").to_pylist()
        narrow = left.column("small").is_valid().to_numpy() if edges is not None and coded else np.zeros(len(anchors), bool)
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(-1, dims) if narrow.any() else None
        out_a, out_r = [], []

        def keep(a: int, chosen: np.ndarray) -> None:
            chosen &= (row_ids != anchor_ids[a]) if same else (row_labels != anchor_labels[a])
            found = np.flatnonzero(chosen)
            out_a.append(np.full(len(found), anchors[a]))
            out_r.append(rows[found])

        for a in np.flatnonzero(~narrow):
            keep(a, np.ones(len(rows), bool))
        known = np.flatnonzero(narrow)
        for at in range(0, len(known), _ANCHORS):
            block = known[at : at + _ANCHORS]
            vectors = _matrix(left.take(pa.array(block)).column("small"), dims).astype(np.float64)
            lower, upper = bounds(vectors, codes, edges)
            for j, a in enumerate(block):
                allowed = np.flatnonzero((row_ids != anchor_ids[a]) if same else (row_labels != anchor_labels[a]))
                lo, up = lower[allowed, j], upper[allowed, j]
                chosen = np.zeros(len(allowed), bool)
                for w in windows[a]:
                    score = w["positive_score"]
                    low, high = (-math.inf, math.inf) if score is None else (score * ends[0], score * ends[1])
                    chosen |= window_candidates(lo, up, low, high, -math.inf if w["floor"] is None else w["floor"], k)
                found = allowed[chosen]
                out_a.append(np.full(len(found), anchors[a]))
                out_r.append(rows[found])
        return pa.Table.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_r), pa.int64())], schema=_PAIR)

    return run


# Exact scores


def _dots(batch: pa.RecordBatch) -> list[int] | np.ndarray:
    """The inner products of the two vectors of each row."""
    columns = {n: batch.column(n) for n in ("small", "large", "row_small", "row_large")}
    if columns["small"].null_count == 0 and columns["row_small"].null_count == 0:
        left, right = columns["small"], columns["row_small"]
        ends = np.diff(left.offsets.to_numpy()).cumsum()
        # sums wrap around, their differences don't as long as a product fits 64 bits: 2 ** 33 dimensions
        sums = np.append(0, np.cumsum(left.flatten().to_numpy().astype(np.int64) * right.flatten().to_numpy()))
        return sums[ends] - sums[np.append(0, ends[:-1])] if len(ends) else np.zeros(0, np.int64)
    vectors = [[s if s is not None else x for s, x in zip(columns[p + "small"].to_pylist(), columns[p + "large"].to_pylist(), strict=True)] for p in ("", "row_")]
    return [sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(*vectors, strict=True)]


def _scored(low: int, high: int) -> Callable:
    """A row for each pair and window that the pair's score lies in: ``low * p <= 100 * score <= high * p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _dots(batch)
            lists = batch.column("windows")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            windows = pa.Table.from_struct_array(lists.flatten())
            positive, beyond = windows.column("positive_score").to_pylist(), windows.column("positive_exact").to_pylist()
            if isinstance(scores, np.ndarray) and windows.column("positive_exact").null_count == len(owner) and np.abs(scores).max(initial=0) < 2**50:
                limits = np.array([0 if p is None else p for p in positive], np.int64)
                ends = np.array([p is None for p in positive], bool)
                inside = 100 * scores[owner]
                # a narrow anchor's positive may be a narrow row or a wide one, whose score needn't fit the products
                keep = ends | ((np.abs(limits) < 2**50) & (low * np.clip(limits, -(2**50), 2**50) <= inside) & (inside <= high * np.clip(limits, -(2**50), 2**50)))
                large = np.flatnonzero(~ends & (np.abs(limits) >= 2**50))
            else:
                keep, large = np.zeros(len(owner), bool), np.arange(len(owner))
            for i in large.tolist():
                p = int(beyond[i]) if beyond[i] is not None else positive[i]
                keep[i] = p is None or low * p <= 100 * int(scores[owner[i]]) <= high * p
            chosen = np.flatnonzero(keep)
            exact = [int(scores[i]) for i in owner[chosen]]
            whole = [max(-_LONG, min(_LONG - 1, x)) for x in exact]
            of_row, of_window = batch.take(pa.array(owner[chosen])), windows.take(pa.array(chosen))
            values = {
                "anchor": of_row.column("anchor"),
                "w": of_window.column("w"),
                "anchor_id": of_row.column("anchor_id"),
                "positive_id": of_window.column("positive_id"),
                "positive_score": of_window.column("positive_score"),
                "positive_exact": of_window.column("positive_exact"),
                "id": of_row.column("id"),
                "score": pa.array(whole, pa.int64()),
                "exact": pa.array([None if x == y else str(x) for x, y in zip(exact, whole, strict=True)], pa.string()),
            }
            yield from pa.table([values[f.name] for f in _SCORED], schema=_SCORED).to_batches()

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _best(k: int, *keys: str) -> Callable[[DataFrame], DataFrame]:
    """The k best of each key; scores of one clipped value by their digits, more being more for positive ones and less for negative ones."""
    digits = F.when(F.col("score") > 0, F.length("exact")).otherwise(-F.length("exact"))
    text = lambda positive: F.when((F.col("score") > 0) == positive, F.col("exact"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc(digits), F.desc(text(True)), F.asc(text(False)), F.asc("id"))
    return lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _whole_numbers(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, dims, small or large, wide, is_anchor) of the rows that take part."""
    x_nan, x_inf = F.lit(float("nan")), F.lit(float("inf"))
    bad = lambda x: x.isNull() | (x.cast("double") == x_nan) | (F.abs(x.cast("double")) == x_inf)
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(vector_col, bad)
    # a double holds 256 * x exactly but for the very largest, whose product is brought back to the largest double
    product = lambda x: F.least(F.greatest(x.cast("double") * SCALE, F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))
    whole = F.transform(vector_col, lambda x: F.when(F.abs(x) < 2.0**44, F.floor(product(x)).cast("double")).otherwise(product(x)))
    rows = vectors.where(ok).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.size(vector_col).alias("dims"), whole.alias("large"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    )
    rows = rows.withColumn("wide", F.exists("large", lambda x: F.abs(x) > 32767.0))
    rows = rows.withColumn("small", F.when(~F.col("wide"), F.transform("large", lambda x: x.cast("short"))))
    return rows.withColumn("large", F.when(F.col("wide"), F.col("large")))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    bits: int = BITS,
    group_rows: int = GROUP_ROWS,
    group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A negative's score lies from ``low`` to ``high`` per cent of its positive's.
    """
    rows = _whole_numbers(vectors, is_anchor, id_col, vector_col, label_col)
    kept = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    by_length = kept.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anchor").alias("anchors"), F.count_if("wide").alias("wide"))
    n, n_anchors, n_wide = by_length.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("anchors"), F.lit(0)), F.coalesce(F.sum("wide"), F.lit(0))).first()
    across, down = max(1, -(-n // group_rows)), max(1, -(-n_anchors // group_anchors))

    # the grid: at most GRID_LENGTHS rows of cells x dimensions
    lengths = [r["dims"] for r in by_length.where("dims > 0 AND n > wide").orderBy(F.desc("n"), "dims").limit(GRID_LENGTHS).collect()]
    narrow = kept.where(~F.col("wide") & F.col("dims").isin(lengths)).select("dims", "small")
    ranges = narrow.mapInArrow(_ranges, "dims int, low array<short>, high array<short>")
    sample = narrow.sample(min(1.0, SAMPLE_ROWS / n), seed=5) if n else narrow
    made = ranges.groupBy("dims").cogroup(sample.groupBy("dims")).applyInArrow(_grid(2**bits), "dims int, edges binary").collect() if lengths else []
    grids = {r["dims"]: np.frombuffer(bytes(r["edges"]), np.int32).reshape(2, 2**bits, r["dims"]) for r in made}

    # the file of approximations, without rows that could never be returned for their copies
    copies = Window.partitionBy("label", "dims", "small", "large").orderBy("id")
    apart = kept.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= max(positives + 1, negatives)).select("row", "id", "label", "dims", "wide", "small")
    file = stored(apart.mapInArrow(_approximate(grids), "row long, id long, label string, dims int, wide boolean, codes binary"), "approximations")

    deal = lambda seed, parts: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")
    numbers = lambda first, after: F.explode(F.sequence(F.lit(first), F.lit(after - 1)))
    kinds = F.explode(F.array(*map(F.lit, [False, True] if n_wide else [False])))
    vectors_of = kept.select("row", F.col("small").alias("row_small"), F.col("large").alias("row_large"), "id")

    def found(anchors: DataFrame, k: int, same: bool, first: int, after: int) -> DataFrame:
        """The exactly scored rows of the groups ``first`` to ``after - 1`` that lie in the anchors' windows."""
        keys = ["dims", "part", "down", "wide", *(["label"] if same else [])]
        asked = anchors.select("row", "id", "label", "dims", "small", "windows", deal(2, down).alias("down")).withColumn("part", numbers(first, after)).withColumn("wide", kinds)
        rows = file.withColumn("part", deal(1, across)).where(F.col("part").between(first, after - 1)).withColumn("down", numbers(0, down))
        pairs = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(_candidates(grids, k, same, (low / 100, high / 100)), "anchor long, row long")
        pairs = stored(pairs, "candidates")
        own = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "small", "large", "windows")
        return pairs.join(own, "anchor").join(vectors_of, "row").mapInArrow(_scored(low, high), _ddl(_SCORED))

    def search(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows of each window."""
        best = _best(k, "anchor", "w")
        if across == 1:
            return best(found(anchors, k, same, 0, 1))
        start = stored(best(found(anchors, k, same, 0, 1)).drop("rank"), "best")
        full = start.groupBy("anchor", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")).where(F.col("n") == k)
        floors = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("floor") - 1.0 - F.abs("floor") * 1e-9))).alias("floors"))
        raised = anchors.join(floors, F.col("row") == F.col("anchor"), "left").drop("anchor")
        windows = F.transform("windows", lambda x: x.withField("floor", F.try_element_at("floors", x["w"])))
        return best(start.unionByName(found(raised.withColumn("windows", windows), k, same, 1, across)))

    anchors = kept.where("is_anchor")
    # one window without ends
    nothing = [F.lit(None).cast("long").alias("positive_id"), F.lit(None).cast("long").alias("positive_score"), F.lit(None).cast("string").alias("positive_exact"), F.lit(None).cast("double").alias("floor")]
    open_ended = F.array(F.struct(F.lit(0).alias("w"), *nothing))
    near = stored(search(anchors.withColumn("windows", open_ended), positives, True).select("anchor", "rank", "id", "score", "exact"), "positives")
    opened = near.groupBy("anchor").agg(
        F.collect_list(F.struct(F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("exact").alias("positive_exact"), nothing[-1])).alias("windows")
    )
    mined = search(anchors.join(opened, F.col("row") == F.col("anchor")).drop("anchor"), negatives, False)
    return mined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Anchors are the rows whose vec_id is divisible by 100; every seventh id has the next label.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""
