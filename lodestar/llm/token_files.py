"""Token ids in binary files: patched frame-of-reference blocks.

A file holds blocks of ``BLOCK`` ids. A block stores its minimum, then the differences packed at a width
chosen among percentiles of their bit lengths so that the block is smallest; differences that need more bits
are exceptions, kept in a list of (place, value). The footer indexes the byte at which each block starts and,
for each document in ascending id order, its id and number of ids. A reader finds any document by the index.

    block:  min u4 | count u4 | width u1 | exceptions u4 | packed bits | places u4... | values u4...
    footer: starts u8... | doc ids i8... | counts u8... | first doc ids' place
    tail:   n blocks u8 | n docs u8 | n ids u8 | footer's byte u8 | magic

Documents are dealt out by ranges of (id, hash of the text) and sorted there; a task encodes its range in order and
begins a new file after ``FILE_IDS`` ids. So files in order hold ids in ascending document order, an id with very many
rows is spread over ranges, and a task holds the ids of one file. Files get names of their own in each attempt, and
only those of the attempts that succeeded are in the manifest, so a lost executor or a second attempt does no harm.

Null and empty texts have the end id only. Rows that share an id lie beside each other, ordered by their texts. Rows
whose id is null have no place in the order and are left out. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.common import shared_dir, stored
from lodestar.llm.kernels import slices
from lodestar.llm.tokens import library_tokenizer

BLOCK = 4096
PERCENTILES = (75, 90, 95, 98, 100)
#: Documents of one range, and ids after which a file ends.
RANGE_DOCS, FILE_IDS = 5000, 8_000_000
MAGIC = b"PFORIDS1"
_HEAD, _TAIL = struct.Struct("<IIBI"), struct.Struct("<QQQQ8s")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 0:
        return b""
    if width == 16:
        return values.astype("<u2").tobytes()
    planes = (values[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, count: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(count, np.uint32)
    if width == 16:
        return np.frombuffer(data, "<u2", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    out = np.zeros(count, np.uint32)
    for i in range(width):
        out |= bits[:, i].astype(np.uint32) << np.uint32(i)
    return out


def encode_block(ids: np.ndarray) -> bytes:
    """One block of at most BLOCK ids, unsigned 32-bit."""
    low = int(ids.min())
    deltas = (ids - np.uint32(low)).astype(np.uint32)
    lengths = np.zeros(len(ids), np.int64)
    some = deltas > 0
    lengths[some] = np.floor(np.log2(deltas[some].astype(np.float64))).astype(np.int64) + 1
    within = np.cumsum(np.bincount(lengths, minlength=33))  # how many need at most w bits
    above = len(ids) - within
    # the width at a percentile is the least that so many differences fit in
    widths = {int(w) for w in np.searchsorted(within, [-(-p * len(ids) // 100) for p in PERCENTILES])}
    width = min(sorted(widths), key=lambda w: -(-len(ids) * w // 8) + 8 * int(above[w]))
    out = np.flatnonzero(lengths > width)
    packed = deltas.copy()
    packed[out] = 0
    return _HEAD.pack(low, len(ids), width, len(out)) + pack_bits(packed, width) + out.astype("<u4").tobytes() + deltas[out].astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low, count, width, n = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = -(-count * width // 8)
    values = unpack_bits(data[at : at + size], count, width)
    places = np.frombuffer(data, "<u4", n, at + size)
    values[places] = np.frombuffer(data, "<u4", n, at + size + 4 * n)
    return values + np.uint32(low)


def write_file(stream, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
    """Writes the ids of documents that lie one after the other in ``ids``."""
    starts, at = [], 0
    for low in range(0, len(ids), BLOCK):
        block = encode_block(ids[low : low + BLOCK].astype(np.uint32))
        starts.append(at)
        stream.write(block)
        at += len(block)
    starts.append(at)
    stream.write(np.array(starts, "<u8").tobytes() + doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes())
    stream.write(_TAIL.pack(len(starts) - 1, len(doc_ids), len(ids), at, MAGIC))


class TokenFile:
    """Reads a file: its documents in order, or any one of them by the index."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(size - _TAIL.size)
        blocks, docs, self.n_ids, footer, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(footer)
        raw = source.read(8 * (blocks + 1 + 2 * docs))
        self.starts = np.frombuffer(raw, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * (blocks + 1))
        self.counts = np.frombuffer(raw, "<u8", docs, 8 * (blocks + 1 + docs)).astype(np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))

    def block(self, i: int) -> np.ndarray:
        self._source.seek(int(self.starts[i]))
        return decode_block(self._source.read(int(self.starts[i + 1] - self.starts[i])))

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at that place in the file."""
        low, high = int(self.offsets[place]), int(self.offsets[place + 1])
        parts = [self.block(i) for i in range(low // BLOCK, -(-high // BLOCK))]
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        first = low // BLOCK * BLOCK
        return whole[low - first : high - first]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(id, ids before it in the file, its ids), each block being read once."""
        held, first, nxt = np.zeros(0, np.uint32), 0, 0
        for place in range(len(self.doc_ids)):
            low, high = int(self.offsets[place]), int(self.offsets[place + 1])
            parts = [held[low - first :]]
            have = first + len(held)
            while have < high:
                parts.append(self.block(nxt))
                have += len(parts[-1])
                nxt += 1
            held, first = np.concatenate(parts), low
            yield int(self.doc_ids[place]), low, held[: high - low]


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


_MANIFEST = "range int, file int, path string, n_docs long, n_ids long"


def _written(path: str, end_id: int, folder: str, file_ids: int):
    """Encodes a range's texts, which come in order, and writes them; a manifest row for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, number = library_tokenizer(path), 0
        end = np.array([end_id], tokenizer.dtype)
        system, where = _open(folder)
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, size, number
            name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.ids"
            system.create_dir(where, recursive=True)
            with system.open_output_stream(f"{where}/{name}") as stream:
                write_file(stream, np.array(names, np.int64), np.array([len(x) for x in held], np.int64), np.concatenate(held))
            row = {"range": TaskContext.get().partitionId(), "file": number, "path": f"{folder}/{name}", "n_docs": len(names), "n_ids": size}
            names, held, size, number = [], [], 0, number + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            own = batch.column(0).to_pylist()
            for a, b in slices(batch.column(1)):
                for i, ids in enumerate(tokenizer.encode_rows(batch.column(1).slice(a, b - a)), a):
                    names.append(own[i])
                    held.append(np.append(ids, end))
                    size += len(ids) + 1
                    if size >= file_ids:
                        yield flush()
        if names:
            yield flush()
        tokenizer.forget()  # the worker may serve other operators next

    return run


def write_token_files(
    docs: DataFrame, path: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", range_docs: int = RANGE_DOCS, file_ids: int = FILE_IDS
) -> DataFrame:
    """Encodes every text, appends ``end_id``, writes the files; the manifest (range, file, path, n_docs, n_ids)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    ranges = max(1, -(-rows.select("doc_id").count() // range_docs))
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text")
    return stored(dealt.mapInArrow(_written(path, end_id, folder, file_ids), _MANIFEST), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files; start counts all ids before it.

    The sum over earlier files is the one step in a single task: it sees a row for each file.
    """
    n_fields = 5 if with_ids else 4
    earlier = Window.orderBy("range", "file").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select("path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    listed = listed.repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = _open(path)
                with system.open_input_file(where) as source:
                    held: list = []
                    size = 0
                    for name, start, ids in TokenFile(source).documents():
                        held.append((name, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids))
                        size += len(ids)
                        if size > 500_000:
                            yield _batch(held, n_fields)
                            held, size = [], 0
                    if held:
                        yield _batch(held, n_fields)

    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _batch(held: list, n_fields: int) -> pa.RecordBatch:
    columns = list(zip(*held, strict=True))
    if n_fields == 4:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]], ["doc_id", "start", "n_tokens", "ids_crc32"])
    flat = pa.array(np.concatenate(columns[4]).astype(np.int64))
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in columns[4]]))), pa.int32())
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.ListArray.from_arrays(offsets, flat)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def token_output(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Writes the files and reads them back; below the shared folder where no folder is given."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, path, end_id, folder or shared_dir(spark, "ids")), with_ids)
