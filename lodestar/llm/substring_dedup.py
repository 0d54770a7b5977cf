"""Substring dedup: repeated paragraphs and passages are cut out of all documents but the first.

Paragraphs are lines and, where lines of fewer than ``MIN_PARAGRAPH_WORDS`` words follow each other without a blank
or longer line between (a hard-wrapped text), all of these as one, too. Paragraphs of ``MIN_BANDED_WORDS`` words or more
have MinHash signatures over their 5-word shingles, in ``BANDS`` bands of ``ROWS`` rows: at similarity 0.75 a pair
collides with probability 0.996, at 0.5 with 0.74, at 0.3 with 0.24. Colliding paragraphs are joined and verified by
exact Jaccard similarity (0.75 or more) on the whole shingle sets, by the signature trees of ``links``; verified
links give components. Of a component the first occurrence, by (doc_id, place), stays. Shorter paragraphs have one or
two shingles, so only equal ones are alike.

An edit of one word in fewer than 39 leaves less than 0.75, so equal text is found by equal words, wherever it
lies: a document's words are cut where the hash of three words is least among its neighbours, which depends on the
words around only, and pieces are joined with their first occurrence. Before anything is cut, the words themselves
are compared with those of the first occurrence, and the match is extended on both sides to the first difference.
That needs no more of the first document than the pieces beside the match: had all words of such a piece been equal,
and ``REACH`` + 3 more, it would have been cut and found in the same way.

Repeated paragraphs and passages are united, and a run of at least ``MIN_RUN_WORDS`` words is removed.

Words are maximal runs of bytes other than white space, A-Z lower-cased for comparison. Null texts stay null,
a text that goes entirely is an empty string. Rows that share an id count as one document, but are looked at and cut
by their own texts; rows with a null id are returned as they are.

A key that ``HOT`` units or more of one block have is settled there: its part gets one row for the block, and the
units go on directly, so no task sees all uses of a widespread passage.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import drop_stored, small_side, stored, unused
from lodestar.llm.kernels import mix, slices, string_buffer, windows, words
from lodestar.llm.links import verified_components
from lodestar.llm.ngram_join import PERCENT, WIDTH, _cut

MIN_PARAGRAPH_WORDS = 25
MIN_RUN_WORDS = 25
MIN_PIECE_WORDS = 3
#: Paragraphs of fewer words have too few shingles for one of them to differ.
MIN_BANDED_WORDS = WIDTH + 2
BANDS, ROWS = 10, 3
#: A cut is the least of so many neighbours on either side.
REACH = 5
#: Units of one block of the search for equal keys, of one part of it, and of one block that make a key widespread.
BLOCK_UNITS, PART_UNITS, HOT = 300_000, 400_000, 64

_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_NAME = np.dtype([("name", "<i8"), ("size", "<u4")])
_PIECE = np.dtype([("doc", "<i8"), ("sub", "<i4"), ("start", "<u4"), ("n", "<u4"), ("left", "<u4"), ("right", "<u4")])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _sequence_hash(hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A hash of the sequence of words of each unit; units are consecutive, ``owner`` is the unit of each word."""
    place = (np.arange(len(hashes)) - starts[owner]).astype(_U)
    return mix(np.add.reduceat(mix(hashes + place * _U(0xC2B2AE3D27D4EB4F)), starts))


def paragraphs(raw: np.ndarray, word_starts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each paragraph, and the paragraph of each word: words of one row with no newline between."""
    if not len(word_starts):
        empty = np.zeros(0, np.int64)
        return empty, empty
    newlines = np.cumsum(raw == 0x0A)
    line = newlines[word_starts]
    new = np.ones(len(row), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def wrapped(raw: np.ndarray, word_starts: np.ndarray, row: np.ndarray, line: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line of each passage, and its number of lines: short lines of one row that follow each other, or one line."""
    number = np.cumsum(raw == 0x0A)[word_starts[line]]
    short = length < MIN_PARAGRAPH_WORDS
    new = np.ones(len(line), bool)
    new[1:] = ~(short[1:] & short[:-1] & (row[line[1:]] == row[line[:-1]]) & (number[1:] - number[:-1] == 1))
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(line)))


def band_keys(hashes: np.ndarray, owner: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each unit, the least of differently mixed shingle hashes, ROWS to a key; and its distinct shingles.

    Every unit has at least ``width`` words; ``owner`` is the unit of each word.
    """
    shingles, at, _ = windows(hashes, owner, width)
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    keys = np.zeros((len(begin), BANDS), _U)
    if not len(at):
        return keys, np.zeros(0, np.int64)
    for band in range(BANDS):
        for i in range(band * ROWS, (band + 1) * ROWS):
            x = shingles * _SEEDS[i]
            x ^= x >> _U(32)
            keys[:, band] = mix(keys[:, band] * _U(0x9FB21C651E98DF25) + np.minimum.reduceat(x * _SEEDS[i - 1], begin))
        keys[:, band] += _U(band)
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
        shingles[a:b].sort()
    fresh = np.append(True, (shingles[1:] != shingles[:-1]) | (at[1:] != at[:-1]))
    return keys, np.add.reduceat(fresh.astype(np.int64), begin)


def piece_starts(hashes: np.ndarray, row: np.ndarray, reach: int = REACH) -> np.ndarray:
    """First word of each piece: the first of a row, and where a hash of three words is least around."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    if n > 2:
        t = mix(hashes[:-2] * _U(0xD6E8FEB86659FD93) + hashes[1:-1] * _U(0xA24BAED4963EE407) + hashes[2:])
        least = t.copy()
        for s in range(1, min(reach, len(t) - 1) + 1):
            np.minimum(least[s:], t[:-s], out=least[s:])
            np.minimum(least[:-s], t[s:], out=least[:-s])
        first[:-2] |= t == least
    return np.flatnonzero(first)


def _paragraphs(column: pa.Array) -> Iterator[tuple]:
    """(rows, first words in their row, words, names, hashes of words, unit of each word) of lines and of wrapped lines."""
    raw, rows = string_buffer(column)
    starts, _, row, hashes = words(raw, rows, lower=True)
    if not len(starts):
        return
    base = np.searchsorted(row, np.arange(len(column)))  # a row's first word
    line, _ = paragraphs(raw, starts, row)
    begin, lines = wrapped(raw, starts, row, line, np.diff(np.append(line, len(row))))
    for first, some in ((line, np.ones(len(line), bool)), (line[begin], lines > 1)):
        n = np.diff(np.append(first, len(row)))
        some &= n >= MIN_BANDED_WORDS
        if some.any():
            kept = np.repeat(some, n)
            first, n = first[some], n[some]
            owner = np.repeat(np.arange(len(n)), n)
            own = hashes[kept]
            names = _sequence_hash(own, np.cumsum(n) - n, owner).view(np.int64)
            yield row[first], first - base[row[first]], n, names, own, owner


_PLACES = "name long, doc_id long, sub int, start int, n int"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each paragraph lies."""
    for batch in batches:
        for a, b in slices(batch.column(2)):
            ids, subs = (batch.column(i).slice(a, b - a).to_numpy() for i in (0, 1))
            for row, start, n, names, _, _ in _paragraphs(batch.column(2).slice(a, b - a)):
                arrays = [names, ids[row], subs[row].astype(np.int32), start.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [x.split()[0] for x in _PLACES.split(", ")])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)


#: kind 0: units that meet in a part; 1: for a key that is settled in the block, its first unit; 2: all units of such keys.
_BLOCK = "kind int, part int, keys binary, units binary"


def _flush(keys: np.ndarray, units: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block; ``units`` are ordered so that the first of equal keys is their first."""
    order = np.argsort(keys, kind="stable")
    keys, units = keys[order], units[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    held = np.diff(np.append(first, len(keys)))
    hot = np.repeat(held >= HOT, held)
    marks = first[held >= HOT]
    rows = [(0, *r) for r in _cut(_part(keys[~hot], parts), keys[~hot], units[~hot])]
    rows += [(1, *r) for r in _cut(_part(keys[marks], parts), keys[marks], units[marks])]
    # on their way, units of settled keys are dealt out by themselves
    rows += [(2, parts + p, k, u) for p, k, u in _cut(np.arange(hot.sum()) // 50_000, keys[hot], units[hot])]
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "part", "keys", "units"])


def _band_blocks(parts: int):
    """Blocks of paragraphs' band keys."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        named, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at = np.unique(named["name"], return_index=True)  # equal paragraphs have equal keys
        yield from _flush(keys[at].reshape(-1), np.repeat(named[at], BANDS), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b in slices(batch.column(2)):
                for _, _, _, names, hashes, owner in _paragraphs(batch.column(2).slice(a, b - a)):
                    named = np.zeros(len(names), _NAME)
                    named["name"] = names
                    keys, named["size"] = band_keys(hashes, owner)
                    held.append((named, keys))
                    size += len(names) * BANDS
                if size > BLOCK_UNITS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _collisions(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries (token, owner, n) of the paragraphs that share a band with another."""
    plain, marked = [], []
    for pdf in batches:
        for kind, k, u in zip(pdf["kind"], pdf["keys"], pdf["units"], strict=True):
            k, u = np.frombuffer(k, "<i8"), np.frombuffer(u, _NAME)
            if kind == 2:
                yield pd.DataFrame({"token": k, "owner": u["name"], "n": u["size"].astype(np.int64)})
            else:
                (plain if kind == 0 else marked).append((k, u))
    if not plain:
        return
    k, u = (np.concatenate(x) for x in zip(*plain, strict=True))
    order = np.lexsort((u["name"], k))
    k, u = k[order], u[order]
    new = np.append(True, (k[1:] != k[:-1]) | (u["name"][1:] != u["name"][:-1]))
    k, u = k[new], u[new]
    _, at, count = np.unique(k, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    if marked:
        shared |= np.isin(k, np.concatenate([m[0] for m in marked]))
    yield pd.DataFrame({"token": k[shared], "owner": u["name"][shared], "n": u["size"][shared].astype(np.int64)})


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the paragraphs asked for."""
    for batch in batches:
        for a, b in slices(batch.column(0)):
            raw, rows = string_buffer(batch.column(0).slice(a, b - a))
            _, _, row, hashes = words(raw, rows, lower=True)
            base = np.searchsorted(row, np.arange(b - a))
            names, out = [], []
            for i, asked in enumerate(batch.column(1).slice(a, b - a).to_pylist()):
                for x in asked:
                    low = int(base[i]) + x["start"]
                    part = hashes[low : low + x["n"]]
                    shingles, _, _ = windows(part, np.zeros(len(part), np.int64), WIDTH)
                    names.append(x["name"])
                    out.append(np.unique(shingles).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["owner", "members"])


def near_paragraphs(texts: DataFrame, places: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """(name, component) of the paragraphs that are linked with others; a name stands for one sequence of words."""
    blocks = texts.mapInArrow(_band_blocks(parts), _BLOCK)
    entries = stored(blocks.groupBy("part").applyInPandas(_collisions, "token long, owner long, n long"), "entries")
    wanted = entries.select(F.col("owner").alias("name")).distinct()
    one = places.join(small_side(wanted), "name").groupBy("name").agg(F.min(F.struct("doc_id", "sub", "start", "n")).alias("at"))
    asked = one.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.sub").alias("sub"))
    asked = asked.agg(F.collect_list(F.struct("name", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("asked"))
    members = _one_row(texts).join(asked.hint("shuffle_hash"), ["doc_id", "sub"]).select("text", "asked").mapInArrow(_members, "owner long, members binary")
    found = verified_components(entries, members, percent).withColumnRenamed("owner", "name")
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("names")).where("names > 1")
    return stored(found.join(several.select("component").repartition("component"), "component").select("name", "component"), "linked")


def _one_row(texts: DataFrame) -> DataFrame:
    """Rows that agree in id and text once; ``sub`` is 0 everywhere where ids don't repeat."""
    return texts if texts.where("sub <> 0").isEmpty() else texts.dropDuplicates(["doc_id", "sub"])


def _piece_blocks(parts: int):
    """Blocks of pieces' keys and places."""

    def block(column: pa.Array, ids: np.ndarray, subs: np.ndarray) -> tuple | None:
        raw, rows = string_buffer(column)
        starts, _, row, hashes = words(raw, rows, lower=True)
        if not len(starts):
            return None
        base = np.searchsorted(row, np.arange(len(ids) + 1))
        cut = piece_starts(hashes, row)
        end = np.append(cut[1:], len(row))
        keys = _sequence_hash(hashes, cut, np.repeat(np.arange(len(cut)), end - cut)) + (end - cut).astype(_U)
        some = end - cut >= MIN_PIECE_WORDS
        keys, cut, end = keys[some], cut[some], end[some]
        at = row[cut]
        low, high = base[at], base[at + 1]
        same = np.append(at[1:] == at[:-1], False)
        before, after = low.copy(), high.copy()
        before[1:] = np.where(same[:-1], np.maximum(low[1:], cut[:-1] - REACH - 3), low[1:])
        after[:-1] = np.where(same[:-1], np.minimum(high[:-1], end[1:] + REACH + 3), high[:-1])
        units = np.zeros(len(cut), _PIECE)
        units["doc"], units["sub"], units["start"], units["n"] = ids[at], subs[at], cut - low, end - cut
        units["left"], units["right"] = cut - before, after - end
        return keys, units

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, units = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((units["start"], units["sub"], units["doc"]))
        yield from _flush(keys[order], units[order], parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(batch.column(2)):
                if (found := block(batch.column(2).slice(a, b - a), ids[a:b], subs[a:b])) is not None:
                    held.append(found)
                    size += len(found[0])
                if size > BLOCK_UNITS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


_FOUND = "kind int, name long, doc_id long, sub int, start int, n int, f_doc long, f_sub int, f_start int, f_left int, f_right int"


def _found(kind: int, name: np.ndarray, unit: np.ndarray | None, first: np.ndarray | None) -> pd.DataFrame:
    out = pd.DataFrame({"kind": np.full(len(name), kind, np.int32), "name": name.view(np.int64)})
    for source, fields in ((unit, (("doc_id", "doc"), ("sub", "sub"), ("start", "start"), ("n", "n"))), (first, (("f_doc", "doc"), ("f_sub", "sub"), ("f_start", "start"), ("f_left", "left"), ("f_right", "right")))):
        for c, f in fields:
            out[c] = pd.array([pd.NA] * len(name), "Int64") if source is None else source[f].astype(np.int64)
    return out


def _repeated_pieces(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kind 0: the pieces that occurred before, each with its first occurrence; 1: firsts of keys that blocks settled; 2: their pieces."""
    gathered: list[list[tuple]] = [[], []]
    for pdf in batches:
        for kind, k, u in zip(pdf["kind"], pdf["keys"], pdf["units"], strict=True):
            k, u = np.frombuffer(k, "<u8"), np.frombuffer(u, _PIECE)
            if kind == 2:
                yield _found(2, k, u, None)
            else:
                gathered[kind].append((k, u))
    both = gathered[0] + gathered[1]
    if not both:
        return
    k, u = (np.concatenate(x) for x in zip(*both, strict=True))
    mark = np.zeros(len(k), bool)
    mark[len(k) - sum(len(x[0]) for x in gathered[1]) :] = True
    order = np.argsort(k, kind="stable")
    k, u, mark = k[order], u[order], mark[order]
    near = np.zeros(len(k) + 1, bool)
    near[1:-1] = k[1:] == k[:-1]
    several = near[1:] | near[:-1] | mark
    k, u, mark = k[several], u[several], mark[several]
    order = np.lexsort((u["start"], u["sub"], u["doc"], k))
    k, u, mark = k[order], u[order], mark[order]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    first = np.repeat(u[begin], np.diff(np.append(begin, len(k))))
    if mark.any():
        settled = begin[np.logical_or.reduceat(mark, begin)]
        yield _found(1, k[settled], None, u[settled])
    later = ~mark & ((u["doc"] != first["doc"]) | (u["sub"] != first["sub"]) | (u["start"] != first["start"]))
    for low in range(0, len(k), 500_000):
        part = np.flatnonzero(later[low : low + 500_000]) + low
        if len(part):
            yield _found(0, k[part], u[part], first[part])


_RUNS = "doc_id long, sub int, start int, n int, f_doc long, f_sub int, f_start int, f_left int, f_right int"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that follow each other both here and in the first document as one; they come in order."""
    names = [x.split()[0] for x in _RUNS.split(", ")]
    last: np.ndarray | None = None  # a run that the next batch may go on with

    def table(rows: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64() if x.endswith("long") else pa.int32() for x in _RUNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(rows[i], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(len(names))])
        rows = rows if last is None else np.concatenate((last, rows), axis=1)
        if not rows.shape[1]:
            continue
        doc, sub, start, n, f_doc, f_sub, f_start = rows[:7]
        on = (doc[1:] == doc[:-1]) & (sub[1:] == sub[:-1]) & (f_doc[1:] == f_doc[:-1]) & (f_sub[1:] == f_sub[:-1])
        on &= (start[1:] == start[:-1] + n[:-1]) & (f_start[1:] == f_start[:-1] + n[:-1])
        begin = np.flatnonzero(np.append(True, ~on))
        end = np.append(begin[1:], rows.shape[1]) - 1
        out = rows[:, begin]
        out[3], out[8] = np.add.reduceat(n, begin), rows[8, end]
        if out.shape[1] > 1:
            yield table(out[:, :-1])
        last = out[:, -1:]
    if last is not None:
        yield table(last)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the places asked for, lower-cased, a blank between."""
    for batch in batches:
        rows = []
        for doc, sub, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            own = _WORD.findall(text.encode().lower())
            rows += [(doc, sub, x["low"], x["high"], b" ".join(own[x["low"] : x["high"]])) for x in asked]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 5, kinds, strict=True)], ["f_doc", "f_sub", "low", "high", "words"])


def repeated_runs(texts: DataFrame, parts: int) -> DataFrame:
    """(doc_id, sub, start, n, first_id, words, at) of equal text: ``words`` are the first document's around it, ``at`` is where it starts there."""
    found = stored(texts.mapInArrow(_piece_blocks(parts), _BLOCK).groupBy("part").applyInPandas(_repeated_pieces, _FOUND), "pieces", "kind")
    of = [x.split()[0] for x in _RUNS.split(", ")]
    firsts = found.where("kind = 1").select("name", *of[4:])
    direct = found.where("kind = 2").select("name", *of[:4]).join(small_side(firsts), "name")
    direct = direct.where("doc_id <> f_doc OR sub <> f_sub OR start <> f_start").select(*of)
    hits = found.where("kind = 0").select(*of).unionByName(direct)
    hits = hits if texts.where("sub <> 0").isEmpty() else hits.dropDuplicates(["doc_id", "sub", "start"])
    runs = hits.repartition(F.col("doc_id"), F.col("sub")).sortWithinPartitions("doc_id", "sub", "start").mapInArrow(_merged, _RUNS)
    runs = runs.withColumns({"low": F.col("f_start") - F.col("f_left"), "high": F.col("f_start") + F.col("n") + F.col("f_right")})
    runs = stored(runs, "runs")
    drop_stored(found)
    place = ["f_doc", "f_sub", "low", "high"]
    asked = runs.select(*place).distinct().groupBy(F.col("f_doc").alias("doc_id"), F.col("f_sub").alias("sub"))
    asked = asked.agg(F.collect_list(F.struct("low", "high")).alias("asked"))
    held = _one_row(texts).join(asked.hint("shuffle_hash"), ["doc_id", "sub"]).select("doc_id", "sub", "text", "asked")
    held = held.mapInArrow(_regions, "f_doc long, f_sub int, low int, high int, words binary")
    return runs.join(held, place).select("doc_id", "sub", "start", "n", F.col("f_doc").alias("first_id"), "words", F.col("f_left").alias("at"), F.when((F.col("doc_id") == F.col("f_doc")) & (F.col("sub") == F.col("f_sub")), F.col("f_start") + F.col("n")).alias("own_end"))


def merged_runs(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """(first word, end) of the unions of overlapping or adjacent spans that have at least so many words."""
    out: list[list[int]] = []
    for start, n in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [(a, b) for a, b in out if b - a >= least]


def compared(own: list[bytes], start: int, n: int, words: bytes, at: int, least: int) -> tuple[int, int] | None:
    """(start, number of words) of the match, extended to the first difference on either side; None if the words differ.

    ``words`` are those around the first occurrence, which begins at number ``at``. The match doesn't grow below ``least``.
    """
    first = words.split(b" ")
    if own[start : start + n] != first[at : at + n]:
        return None
    left = 0
    while left < at and start - left > least and own[start - left - 1] == first[at - left - 1]:
        left += 1
    right, most = n, min(len(first) - at, len(own) - start)
    while right < most and own[start + right] == first[at + right]:
        right += 1
    return start - left, left + right


def _removed(id_at: int, text_at: int, spans_at: int, n_columns: int, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(text_at)):
                part = batch.slice(a, b - a)
                raw, rows = string_buffer(part.column(text_at))
                texts: list = part.column(text_at).to_pylist()
                found = part.column(spans_at).to_pylist()
                removed, total, first = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), part.column(id_at).to_pylist()
                starts, _, row, _ = words(raw, rows, lower=False)
                base = np.searchsorted(row, np.arange(b - a + 1))
                total[:] = np.diff(base)
                runs_out: list = [[] for _ in range(b - a)]
                for i, spans in enumerate(found):
                    if not spans or texts[i] is None:
                        continue
                    whole = raw[rows[i] : rows[i + 1]].tobytes()
                    own = _WORD.findall(whole.lower())
                    sure = []
                    for x in spans:
                        if x["words"] is None:
                            sure.append((x["start"], x["n"], x["first_id"]))
                        elif (match := compared(own, x["start"], x["n"], x["words"], x["at"], x["own_end"] or 0)) is not None:
                            sure.append((*match, x["first_id"]))
                    runs = merged_runs([x[:2] for x in sure], min_run)
                    if not runs:
                        continue
                    begin = starts[base[i] : base[i + 1]] - rows[i]
                    kept, at = [], 0
                    for low, high in runs:
                        kept.append(whole[at : begin[low]])
                        at = int(begin[high]) if high < len(begin) else len(whole)
                        removed[i] += high - low
                    texts[i] = b"".join([*kept, whole[at:]]).decode()
                    runs_out[i] = [{"start": low, "n_words": high - low} for low, high in runs]
                    begins = [r[0] for r in runs]
                    for start, _, first_id in sure:
                        at = bisect.bisect_right(begins, start) - 1
                        if at >= 0 and start < runs[at][1]:
                            first[i] = min(first[i], first_id)
                columns = [part.column(c) for c in range(n_columns)]
                columns[text_at] = pa.array(texts, pa.string())
                spans_type = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(total), pa.array(removed), pa.array(first, pa.int64()), pa.array(runs_out, spans_type)],
                    [*batch.schema.names[:n_columns], "n_words", "n_removed_words", "class_id", "removed"],
                )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """The rows of ``docs`` with repeated passages cut out of ``text_col``.

    Added columns: n_words, n_removed_words, class_id (the smallest id that holds, first, a passage removed here;
    else the row's own id) and removed (array of first word and number of words in the text before removal). Columns
    of ``docs`` with these names are replaced.
    """
    docs = docs.drop("n_words", "n_removed_words", "class_id", "removed")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    repeated = not texts.groupBy("doc_id").count().where("count > 1").isEmpty()
    sub = lambda text: F.hash(text) if repeated else F.lit(0)
    texts = texts.select("doc_id", sub(F.col("text")).alias("sub"), "text")
    parts = max(1, -(-texts.count() * 60 // PART_UNITS))

    places = stored(texts.mapInArrow(_places, _PLACES), "places")
    linked = near_paragraphs(texts, places, parts)
    near = places.join(small_side(linked), "name")
    longest = F.struct("doc_id", "sub", "start", (-F.col("n")).alias("minus_n"))
    firsts = near.groupBy("component").agg(F.min(longest).alias("first"))
    # a line and the passage that it is part of may be alike: neither is a copy of the other
    near = near.join(firsts.repartition("first"), "component").where("doc_id <> first.doc_id OR sub <> first.sub OR start >= first.start - first.minus_n")
    null = lambda kind: F.lit(None).cast(kind)
    near = near.select("doc_id", "sub", "start", "n", F.col("first.doc_id").alias("first_id"), null("binary").alias("words"), null("int").alias("at"), null("int").alias("own_end"))
    equal = repeated_runs(texts, parts)
    spans = near.unionByName(equal).groupBy("doc_id", "sub")
    spans = spans.agg(F.collect_list(F.struct("start", "n", "first_id", "words", "at", "own_end")).alias("_spans"))

    id_, sub_, spans_ = unused(docs, "_id", "_sub", "_spans")
    spans = spans.withColumnsRenamed({"doc_id": id_, "sub": sub_, "_spans": spans_})
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), sub_: sub(F.col(text_col)).cast("int")})
    columns = [*docs.columns, id_, spans_]
    joined = keyed.where(F.col(id_).isNotNull()).join(spans.hint("shuffle_hash"), [id_, sub_], "left").select(*columns)
    unnamed = keyed.where(F.col(id_).isNull()).withColumn(spans_, F.lit(None).cast(spans.schema[spans_].dataType)).select(*columns)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    schema += ", n_words long, n_removed_words long, class_id long, removed array<struct<start: long, n_words: long>>"
    return joined.unionByName(unnamed).mapInArrow(_removed(len(names), names.index(text_col), len(names) + 1, len(names), min_run_words), schema)
