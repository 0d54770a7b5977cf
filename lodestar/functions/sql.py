"""The library's functions for SQL text: ``register(spark)``, then ``spark.sql`` calls them by name.

| name | kind |
|-|-|
| ``tokens(text)``, ``split_sentences(text)``, ``words(text)`` | arrays of strings |
| ``word_count(text)``, ``set_cosine(a, b)`` | numbers |
| ``semantic_chunks(text, threshold, max_tokens)`` | array of the chunks of a text, in order |
| ``chunk_groups(sentences, threshold)``, ``split_groups(groups, max_tokens)`` | its two steps |
| ``pack_budget(TABLE(...) PARTITION BY ... ORDER BY ...)`` | table (query_id, chunk_index, place, used) |

All but the last are SQL functions, which Spark puts into the plan that calls them, so nothing leaves the JVM. The packer
carries a state from row to row of a partition and is a Python table function; it holds one number for each partition.
Names live in the session and replace those of an earlier registration. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import SENTENCE_PATTERN, SLICE_WORDS, TOKEN_PATTERN

SIMILARITY_DIGITS = 9

_SPACE = r"r'(?U)^\s+|\s+$'"
_SCALAR = {
    "tokens(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(lower(coalesce(t, '')), r'{TOKEN_PATTERN}', 1)",
    "words(t STRING) RETURNS ARRAY<STRING>": r"regexp_extract_all(coalesce(t, ''), r'(?U)(\S+)', 1)",
    "word_count(t STRING) RETURNS BIGINT": r"CAST(size(regexp_extract_all(coalesce(t, ''), r'(?U)(\S+)', 1)) AS BIGINT)",
    "split_sentences(t STRING) RETURNS ARRAY<STRING>": (
        f"filter(transform(split(regexp_replace(coalesce(t, ''), {_SPACE}, ''), r'{SENTENCE_PATTERN}'), s -> regexp_replace(s, {_SPACE}, '')), s -> s <> '')"
    ),
    "set_cosine(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": (
        "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / sqrt(CAST(size(a) AS DOUBLE) * size(b)) ELSE 0D END"
    ),
}

_COUNT = r"CAST(size(regexp_extract_all({}, r'(?U)(\S+)', 1)) AS BIGINT)"
# the words are a lambda's argument, so that they are found once and not for each slice
_SLICES = (
    r"get(transform(array(regexp_extract_all(x.s, r'(?U)(\S+)', 1)), ws -> transform(sequence(0, (size(ws) - 1) DIV {n}), i -> array_join(slice(ws, i * {n} + 1, {n}), ' '))), 0)"
).format(n=SLICE_WORDS)
# A state of finished chunks, the sentences of the open one and their words; a sentence that is too long is cut by itself.
_OVER = "(z.n + x.n > max_tokens AND size(z.open) > 0)"
_CLOSED = "concat(z.done, array(array_join(z.open, ' ')))"
_FOLD = f"""aggregate(transform(g, s -> named_struct('s', s, 'n', {_COUNT.format("s")})),
  named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', CAST(array() AS ARRAY<STRING>), 'n', 0L),
  (z, x) -> named_struct(
    'done', concat(CASE WHEN {_OVER} THEN {_CLOSED} ELSE z.done END, CASE WHEN x.n > max_tokens THEN {_SLICES} ELSE CAST(array() AS ARRAY<STRING>) END),
    'open', concat(CASE WHEN {_OVER} THEN CAST(array() AS ARRAY<STRING>) ELSE z.open END, CASE WHEN x.n > max_tokens THEN CAST(array() AS ARRAY<STRING>) ELSE array(x.s) END),
    'n', CASE WHEN {_OVER} THEN 0L ELSE z.n END + CASE WHEN x.n > max_tokens THEN 0L ELSE x.n END),
  z -> CASE WHEN size(z.open) > 0 THEN {_CLOSED} ELSE z.done END)"""
_STEPS = {
    "token_sets(s ARRAY<STRING>) RETURNS ARRAY<ARRAY<STRING>>": f"transform(s, x -> array_distinct(regexp_extract_all(lower(x), r'{TOKEN_PATTERN}', 1)))",
    # where a sentence is less like the one before than the threshold
    "chunk_starts(v ARRAY<ARRAY<STRING>>, threshold DOUBLE) RETURNS ARRAY<INT>": (
        "filter(CASE WHEN size(v) > 0 THEN sequence(0, size(v) - 1) ELSE CAST(array() AS ARRAY<INT>) END, i -> i = 0 OR round(CASE WHEN size(get(v, i - 1)) > 0 AND size(v[i]) > 0 "
        f"THEN size(array_intersect(get(v, i - 1), v[i])) / sqrt(CAST(size(get(v, i - 1)) AS DOUBLE) * size(v[i])) ELSE 0D END, {SIMILARITY_DIGITS}) < threshold)"
    ),
    "runs_from(s ARRAY<STRING>, b ARRAY<INT>) RETURNS ARRAY<ARRAY<STRING>>": "transform(b, (at, j) -> slice(s, at + 1, coalesce(get(b, j + 1), size(s)) - at))",
    "chunk_groups(s ARRAY<STRING>, threshold DOUBLE) RETURNS ARRAY<ARRAY<STRING>>": "runs_from(s, chunk_starts(token_sets(s), threshold))",
    "split_groups(gs ARRAY<ARRAY<STRING>>, max_tokens INT) RETURNS ARRAY<STRING>": (
        f"flatten(transform(gs, g -> CASE WHEN {_COUNT.format("array_join(g, ' ')")} <= max_tokens THEN array(array_join(g, ' ')) ELSE {_FOLD} END))"
    ),
    "semantic_chunks(t STRING, threshold DOUBLE, max_tokens INT) RETURNS ARRAY<STRING>": "split_groups(chunk_groups(split_sentences(t), threshold), max_tokens)",
}


class PackBudget:
    """Rows (query_id, chunk_index, cost, available) in their order: each is taken if it still fits, else passed over."""

    def __init__(self) -> None:
        self.place, self.used = 0, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        self.place += 1
        if row["available"] > 0 and self.used + row["cost"] <= row["available"]:
            self.used += row["cost"]
            yield row["query_id"], row["chunk_index"], self.place, self.used


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for head, body in (_SCALAR | _STEPS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("pack_budget", F.udtf(PackBudget, returnType="query_id long, chunk_index long, place long, used long"))
