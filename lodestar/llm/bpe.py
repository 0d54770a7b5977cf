"""Byte-level BPE by recursive DuckDB queries in each task.

A word is rows (word, position, token id, next position). Each step of the recursion joins neighbouring rows with
the merge table, finds each word's pair of minimum rank, the leftmost of equals, and contracts it; a word without a pair
that merges takes no further part, and its last rows are its ids. Words are encoded once for each worker, as long as
it remembers them. Decoding is a query of its own: the ids that were given out, as rows (text, position, id), are
joined with the vocabulary, and their bytes concatenated by position.

The recursion keeps all steps of a word, so a word over ``LONG_WORD`` bytes (one unbroken run, such as a line of
dashes) is contracted in slices of steps, of which only the last is kept. In those, a step contracts all occurrences of
the word's minimum pair that don't overlap, from the left, which is what single steps would do one after the other:
that holds where no merge that takes part in a new token has a lower rank than the token itself, else the step takes
the leftmost only.

Null and empty texts have no ids. Other columns are ignored. Rows that share an id are encoded each by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.kernels import slices
from lodestar.llm.tokens import PATTERN, WordEncoder

LONG_WORD = 300
#: Words of one recursive query; bounded also by the rows that their steps may take.
BLOCK_WORDS, BLOCK_ROWS = 20_000, 4_000_000

_ENCODE = """
WITH RECURSIVE s(step, word, pos, id, next) AS (
  SELECT 0, word, pos, id, next FROM pieces
  UNION ALL
  SELECT s.step + 1, s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.merged ELSE s.id END, CASE WHEN s.pos = b.pos THEN b.after ELSE s.next END
  FROM s JOIN (
    SELECT word, (min(c) % 4294967296)::INTEGER AS pos, (min(c) // 4294967296)::INTEGER AS merged, arg_min(gone, c) AS gone, arg_min(after, c) AS after
    FROM (
      SELECT x.word, m.merged::BIGINT * 4294967296 + x.pos AS c, y.pos AS gone, y.next AS after
      FROM s x JOIN s y ON x.word = y.word AND x.next = y.pos JOIN merges m ON x.id = m.first AND y.id = m.second
    )
    GROUP BY word
  ) b ON s.word = b.word
  WHERE s.pos <> b.gone
), last AS (SELECT word, max(step) AS step FROM s GROUP BY word)
SELECT s.word, list(s.id ORDER BY s.pos) AS ids FROM s JOIN last USING (word, step) GROUP BY s.word
"""

#: Of one long word: the rows after at most so many steps, and whether it is done.
_SLICE = """
WITH RECURSIVE s(step, pos, id, next) AS (
  SELECT 0, pos, id, next FROM pieces
  UNION ALL
  (WITH p AS (
    SELECT x.pos, y.pos AS gone, y.next AS after, m.merged, m.safe FROM s x JOIN s y ON x.next = y.pos JOIN merges m ON x.id = m.first AND y.id = m.second
  ), o AS (SELECT *, coalesce(lag(gone) OVER (ORDER BY pos) <> pos, true) AS opens FROM p WHERE merged = (SELECT min(merged) FROM p)
  ), r AS (SELECT *, sum(opens::INT) OVER (ORDER BY pos) AS run FROM o
  ), b AS (SELECT pos, gone, after, merged FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos) AS n, min(pos) OVER () AS leftmost FROM r) WHERE n % 2 = 1 AND (safe OR pos = leftmost)
  )
  SELECT s.step + 1, s.pos, coalesce(b.merged, s.id), CASE WHEN b.pos IS NULL THEN s.next ELSE b.after END
  FROM s LEFT JOIN b ON s.pos = b.pos WHERE s.pos NOT IN (SELECT gone FROM b) AND s.step < @STEPS AND EXISTS (SELECT 1 FROM b))
)
SELECT step, pos, id, next FROM s WHERE step = (SELECT max(step) FROM s) ORDER BY pos
"""

_DECODE = """
SELECT text, string_agg(vocabulary.hex, '' ORDER BY pos) AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY text
"""


class DuckBpe(WordEncoder):
    """Encodes and decodes by the ranks of a tiktoken file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        super().__init__("<i4")
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._pattern, self._plain = regex.compile(pattern), pattern == PATTERN
        self._bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        ]
        least: dict[int, int] = {}  # of the merges that a token takes part in, the lowest rank
        for left, right, rank in triples:
            least[left], least[right] = min(least.get(left, rank), rank), min(least.get(right, rank), rank)
        self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        first, second, merged = (pa.array(x, pa.int32()) for x in zip(*triples, strict=True))
        safe = pa.array([least.get(x[2], x[2] + 1) > x[2] for x in triples])
        merges = pa.table({"first": first, "second": second, "merged": merged, "safe": safe})
        token = {r: t for t, r in self.ranks.items()}
        vocabulary = pa.table({"id": pa.array(list(token), pa.int32()), "hex": [t.hex() for t in token.values()]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self._db.register("rows_in", rows)
            self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
            self._db.unregister("rows_in")

    def _splits(self) -> bool:
        return self._plain

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(words)
        block: list[int] = []
        rows = 0
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            if len(words[i]) > LONG_WORD:
                out[i] = self._in_slices(words[i])
                continue
            block.append(i)
            rows += len(words[i]) ** 2
            if len(block) >= BLOCK_WORDS or rows >= BLOCK_ROWS:
                self._block(words, block, out)
                block, rows = [], 0
        if block:
            self._block(words, block, out)
        return out

    def _encode_others(self, texts: list[str]) -> list[np.ndarray]:
        split = [[w.encode() for w in self._pattern.findall(t)] for t in texts]
        numbers = iter(self.numbers_of([w for words in split for w in words]))
        return [self.ids_of(np.array([next(numbers) for _ in words], np.int64))[0] for words in split]

    def _block(self, words: list[bytes], block: list[int], out: list) -> None:
        lengths = np.array([len(words[i]) for i in block])
        flat = np.frombuffer(b"".join(words[i] for i in block), np.uint8)
        word = np.repeat(np.arange(len(block), dtype=np.int32), lengths)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        after = pos + np.int32(1)
        after[np.cumsum(lengths) - 1] = -1
        found = self._ask(_ENCODE, "pieces", pa.table({"word": word, "pos": pos, "id": self._bytes[flat], "next": after}))
        for w, ids in zip(found.column("word").to_pylist(), found.column("ids").to_pylist(), strict=True):
            out[block[w]] = ids

    def _in_slices(self, word: bytes) -> list[int]:
        pos = np.arange(len(word), dtype=np.int32)
        rows = pa.table({"pos": pos, "id": self._bytes[np.frombuffer(word, np.uint8)], "next": np.append(pos[1:], np.int32(-1))})
        while True:
            steps = max(1, BLOCK_ROWS // rows.num_rows)
            rows = self._ask(_SLICE.replace("@STEPS", str(steps)), "pieces", rows.select(["pos", "id", "next"]))
            if rows.column("step")[0].as_py() < steps:
                return rows.column("id").to_pylist()

    def _ask(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self._db.register(name, rows)
        try:
            return self._db.sql(query).to_arrow_table()
        finally:
            self._db.unregister(name)

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each text from its ids."""
        size = np.array([len(t) for t in texts], np.int64)
        out = [b""] * len(texts)
        if size.sum():
            number = np.repeat(np.arange(len(texts), dtype=np.int32), size)
            pos = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            found = self._ask(_DECODE, "tokens", pa.table({"text": number, "pos": pos, "id": np.concatenate(texts).astype(np.int32)}))
            for i, text in zip(found.column("text").to_pylist(), found.column("hex").to_pylist(), strict=True):
                out[i] = bytes.fromhex(text)
        return out


_loaded: dict = {}


def _bpe(path: str, pattern: str) -> DuckBpe:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = DuckBpe(path, pattern)
    return _loaded[path, pattern]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded binary) of every row; with ``digests`` the two values' sha256 instead.

    ids_sha256 is of the decimal ids joined by commas; what is decoded are these ids. Rows with null ids are encoded
    like others. The vocabulary file is read by each worker from ``path``.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
    schema = pa.schema(fields)
    spark_schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path, pattern)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = bpe.encode_rows(batch.column(1).slice(a, b - a))
                decoded = bpe.decode(ids)
                if digests:
                    joined = (",".join(map(str, x.tolist())) for x in ids)
                    columns = [[hashlib.sha256(x.encode()).hexdigest() for x in joined], [hashlib.sha256(x).hexdigest() for x in decoded]]
                else:
                    columns = [[x.tolist() for x in ids], decoded]
                arrays = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64())]
                arrays += [pa.array(c, t.type) for c, t in zip(columns, list(schema)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        bpe.forget()  # the worker may serve other operators next

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, spark_schema)
