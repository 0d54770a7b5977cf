"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of a line and the line before it decides where a chunk ends, so boundaries
depend on content alone and agree again one line after an insertion. A chunk of several lines that occurred
before, in ids ascending, is removed after its bytes have been compared with the first occurrence's.

What is counted globally is light rows (hash, id, chunk number), written once and combined before they are shuffled,
so a chunk that a third of all documents hold costs one row per task. The two joins with the first occurrences share
one partitioning by the chunk's hash; unless Spark broadcasts the first occurrences, the light rows of one very common
chunk meet in one task there. Texts are cut into chunks once for all documents, and again only where a first occurrence
or a removal lies.

A null text stays null. A text whose chunks all go is an empty string. Rows that share an id count as one
document. Rows with a null id are never removed from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stored, unused

#: A chunk ends on average after so many lines.
DIVISOR = 3
MIN_LINES = 2
_MULTIPLIER = 31


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """array<struct<k: chunk number, n: lines, text>>; the texts joined by newlines are the text."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    # struct(lines, hashes) and struct(lines, ends) are bound once each by a transform over a one-element array
    bound = F.transform(F.array(F.struct(lines.alias("lines"), hashes.alias("h"))), lambda s: F.struct(s["lines"].alias("lines"), _ends(s, divisor).alias("ends")))
    return F.flatten(
        F.transform(
            bound,
            lambda s: F.transform(
                s["ends"],
                lambda end, k: _chunk(s["lines"], F.coalesce(F.get(s["ends"], k - 1) + 1, F.lit(0)), end, k),
            ),
        )
    )


def n_chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """How many chunks the text has."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    bound = F.transform(F.array(F.struct(lines.alias("lines"), hashes.alias("h"))), lambda s: F.size(_ends(s, divisor)).cast("long"))
    return F.get(bound, F.lit(0))


def _ends(s: Column, divisor: int) -> Column:
    last = F.size(s["lines"]) - 1
    rolled = lambda i: (F.coalesce(F.get(s["h"], i - 1), F.lit(0).cast("long")) * _MULTIPLIER + F.get(s["h"], i)) % divisor
    return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolled(i) == 0))


def _chunk(lines: Column, start: Column, end: Column, k: Column) -> Column:
    n = end - start + 1
    return F.struct(k.alias("k"), n.alias("n"), F.array_join(F.slice(lines, start + 1, n), "\n").alias("text"))


def _placed(removed: Column) -> Column:
    """Removed chunks' texts at their chunk numbers, nulls between; ``removed`` is ascending in k."""
    gap = lambda x, i: x["k"] - F.coalesce(F.get(removed, i - 1)["k"], F.lit(-1)) - 1
    return F.flatten(F.transform(removed, lambda x, i: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(x, i)), F.array(x["text"]))))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """The rows of ``docs`` with the text after removal in ``text_col``, and n_lines, n_chunks, n_removed_lines.

    Columns of ``docs`` with the added names are replaced.
    """
    split = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(chunks(F.col(text_col), divisor)).alias("c"))
    keyed = split.where(F.col("c.n") >= min_lines).select("_id", F.col("c.k").alias("k"), F.unhex(F.md5("c.text")).alias("key"))
    keyed = stored(keyed, "chunks")
    repeated = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_id", "k")).alias("first")).where("times > 1")
    repeated = stored(repeated.select("key", "first"), "firsts")
    repeats = keyed.join(repeated, "key").where("_id <> first._id OR k <> first.k")

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    firsts = repeated.groupBy(F.col("first._id").alias("_id")).agg(F.collect_list(F.struct(F.col("first.k").alias("k"), "key")).alias("firsts"))
    held = texts.join(firsts.hint("shuffle_hash"), "_id")
    # the firsts of one document, in the order of its chunks, each beside its text
    wanted = F.array_sort("firsts")
    named = lambda w: F.struct(w["key"].alias("key"), F.get(F.col("_chunks"), w["k"])["text"].alias("text"))
    held = held.withColumn("_chunks", chunks(F.col("_text"), divisor)).select(F.explode(F.transform(wanted, named)).alias("x"))
    held = held.select("x.key", "x.text").where(F.unhex(F.md5("text")) == F.col("key"))
    if not docs.groupBy(id_col).count().where(f"`{id_col}` IS NOT NULL AND count > 1").isEmpty():
        held = held.dropDuplicates(["key"])
    gone = repeats.select("_id", "k", "key").join(held, "key").groupBy("_id").agg(F.array_sort(F.collect_set(F.struct("k", "text"))).alias("_gone"))
    id_, text_, gone_, compared_ = unused(docs, "_id", "_text", "_gone", "_compared")
    gone = gone.withColumnsRenamed({"_id": id_, "_gone": gone_})
    out = docs.withColumns({id_: F.col(id_col), text_: F.col(text_col)}).join(gone.hint("shuffle_hash"), id_, "left")
    compared = F.zip_with(
        chunks(F.col(text_), divisor),
        F.coalesce(_placed(F.col(gone_)), F.array().cast("array<string>")),
        lambda c, r: F.struct(c.alias("c"), (~(r.isNull() | (r != c["text"]))).alias("go")),
    )
    # a document from which nothing may go is only counted
    out = out.withColumn(compared_, F.when(F.col(gone_).isNotNull(), compared))
    kept = F.array_join(F.transform(F.filter(compared_, lambda x: ~x["go"]), lambda x: x["c"]["text"]), "\n")
    lines = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x["c"]["n"])
    cut, some = F.col(gone_).isNotNull(), F.col(text_).isNotNull()
    zero = F.lit(0).cast("long")
    return out.withColumns(
        {
            text_col: F.when(cut, kept).otherwise(F.col(text_)),
            "n_lines": F.when(some, F.size(F.split(F.col(text_), "\n", -1)).cast("long")).otherwise(zero),
            "n_chunks": F.when(cut, F.size(compared_).cast("long")).when(some, n_chunks(F.col(text_), divisor)).otherwise(zero),
            "n_removed_lines": F.when(cut, lines(F.filter(compared_, lambda x: x["go"]))).otherwise(zero),
        }
    ).drop(id_, text_, gone_, compared_)


#: The same in DuckDB SQL: digest of every document's text after removal.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d),
h AS (SELECT doc_id, i, ls[i] AS line, ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, lag(h, 1, 0::BIGINT) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM h),
g AS (SELECT *, coalesce(sum(((p * {_MULTIPLIER} + h) % {DIVISOR} = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, k),
f AS (SELECT doc_id, k, n, t, n >= {MIN_LINES} AND row_number() OVER (PARTITION BY t ORDER BY doc_id, k) > 1 AS go FROM c),
x AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, coalesce(sum(n) FILTER (go), 0)::BIGINT AS n_removed_lines,
    coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT go), '') AS t FROM f GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines, t AS text
FROM documents LEFT JOIN x USING (doc_id)
"""
