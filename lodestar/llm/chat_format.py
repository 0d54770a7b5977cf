"""Chat formatting of transcripts whose speakers are marked unevenly.

A transcript is lines. A hidden Markov model with a beginning and an inner state for each role reads, for each
line, what kind of speaker marker opens it (one of a role's usual names, some other name, none), how many words it
has and what shape it has (a question, a list item, a heading, blank); Viterbi decoding gives each line its state,
and the turns found are rendered in one canonical form.

Transcripts are decoded many at a time, line by line in step. One of more than ``BLOCK_TURNS`` rows is cut into blocks of
so many: each block first gives the best score of every way through it, from any state before it to any state at its
end; of these small tables the best states between blocks follow, and each block is then decoded by itself between
its two states. That is exact, and a transcript that holds a third of all rows is spread over tasks like others.

The model is fitted on whole conversations with known roles, at most ``TRAIN_CONVERSATIONS`` of them, by counts
that Spark aggregates. A null or empty text is one blank line. A row with a null conversation id is a transcript by
itself. Rows that agree in id and turn follow each other in order of their text. Unknown or null roles aren't used for
fitting and have no marker. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import small_side, stored

ROLES = ("system", "user", "assistant")
#: State 2 * role begins a turn, 2 * role + 1 continues it.
STATES = 2 * len(ROLES)
MARKERS = (
    r"(?:system|instructions?|context)",
    r"(?:user|human|customer|question|q)",
    r"(?:assistant|ai|bot|model|answer|a)",
)
_OPEN, _CLOSE = r"^[ \t]*(?:[#*>\[<|-]+[ \t]*)?", r"[ \t]*(?:[*\]>|]*[ \t]*:[*]*|[\]>|]+)[ \t]*"
WORD_BUCKETS = 8
#: A name that isn't listed: up to three words before a colon or a closing sign.
OTHER_MARKER = r"^[ \t]*(?:[#*>\[<|-]+[ \t]*)?\p{L}[\p{L}\p{N}_'.-]*(?: [\p{L}\p{N}_'.-]+){0,2}[ \t]*(?:[*\]>|]*[ \t]*:[*]*|[\]>|]+)(?:[ \t]|$)"
#: Shapes of lines, the first that fits; others are plain.
SHAPES = (r"^[ \t\r]*$", r"\?[\"')\]]*[ \t\r]*$", r"^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]", r":[ \t\r]*$", r"[.!][\"')\]]*[ \t\r]*$")
FEATURES = {"marker": len(MARKERS) + 2, "words": WORD_BUCKETS, "shape": len(SHAPES) + 1}
TRAIN_CONVERSATIONS = 2000
#: Rows of one block, and lines that are decoded at once.
BLOCK_TURNS, BLOCK_LINES = 4096, 50_000

_STRIP = re.compile(_OPEN + "(?:" + "|".join(MARKERS) + ")" + _CLOSE, re.IGNORECASE | re.ASCII)
_STRIP_OTHER = re.compile(OTHER_MARKER.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{L}", r"[^\W\d_]"))


def marker_pattern(role: int) -> str:
    return "(?i)" + _OPEN + MARKERS[role] + _CLOSE


def line_features(line: Column) -> dict[str, Column]:
    marker = F.when(F.rlike(line, F.lit(OTHER_MARKER)), len(MARKERS) + 1).otherwise(0)
    for role in range(len(ROLES)):
        marker = F.when(F.rlike(line, F.lit(marker_pattern(role))), role + 1).otherwise(marker)
    words = F.size(F.regexp_extract_all(line, F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    bucket = F.least(F.lit(WORD_BUCKETS - 1), F.floor(F.log2(words + F.lit(1.0))).cast("int"))
    shape = F.lit(0)
    for i in reversed(range(len(SHAPES))):
        shape = F.when(F.rlike(line, F.lit(SHAPES[i])), i + 1).otherwise(shape)
    return {"marker": marker.cast("int"), "words": bucket.cast("int"), "shape": shape.cast("int")}


def transcript_lines(turns: DataFrame, id_col: str = "conv_id", order_col: str | None = "turn", text_col: str = "text", role_col: str | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(id, solo, block, turn, line_no, line, features and, with ``role_col``, state) for each line of each row.

    Without ``order_col`` a row is a whole transcript. ``solo`` numbers the rows without an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    known = [F.col(role_col).alias("role")] if role_col else []
    id_ = F.col(id_col).cast("long")
    rows = turns.select(id_.alias("id"), F.when(id_.isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).alias("solo"), order.alias("turn"), text.alias("text"), *known)
    block = F.floor(F.coalesce("turn", F.lit(0)) / F.lit(block_turns)).cast("long")
    rows = rows.withColumn("block", block).select("id", "solo", "block", "turn", F.xxhash64("text").alias("tie"), *(c for c in ("role",) if role_col), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    rows = rows.withColumns(line_features(F.col("line")))
    if role_col:
        role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
        state = F.when(role >= 0, 2 * role + F.when(F.col("line_no") > 0, 1).otherwise(0))
        rows = rows.withColumn("state", state.cast("int")).drop("role")
    return rows


@dataclass(frozen=True)
class Model:
    """Logarithms: of the first state, of state to state, and for each feature of state to value."""

    start: np.ndarray
    step: np.ndarray
    emit: tuple[np.ndarray, ...]


def fit(labelled: DataFrame, conversations: int = TRAIN_CONVERSATIONS) -> Model:
    """Counts over at most so many conversations of lines with known states; unseen cases count a half."""
    some = labelled.where("id IS NOT NULL AND state IS NOT NULL").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(conversations)
    # at most ``conversations`` ids
    lines = labelled.where("state IS NOT NULL").join(F.broadcast(some), "id", "left_semi")
    before = F.lag("state").over(Window.partitionBy("id").orderBy("turn", "tie", "line_no"))
    lines = lines.withColumn("before", F.coalesce(before, F.lit(-1)))
    kinds = [F.struct(F.lit("step").alias("kind"), F.col("before").alias("value"))]
    kinds += [F.struct(F.lit(name).alias("kind"), F.col(name).alias("value")) for name in FEATURES]
    counts = lines.select("state", F.explode(F.array(*kinds)).alias("x")).groupBy("state", "x.kind", "x.value").count().collect()
    step = np.full((STATES + 1, STATES), 0.5)
    emit = {name: np.full((STATES, n), 0.5) for name, n in FEATURES.items()}
    for r in counts:
        if r["kind"] == "step":
            step[r["value"], r["state"]] += r["count"]  # the row -1 is the last: the beginning
        else:
            emit[r["kind"]][r["state"], r["value"]] += r["count"]
    for role in range(len(ROLES)):  # an inner line follows its own role only
        inner = 2 * role + 1
        step[[s for s in range(STATES + 1) if s // 2 != role or s == STATES], inner] = 1e-9
    log = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
    step = log(step)
    return Model(step[STATES], step[:STATES], tuple(log(emit[name]) for name in FEATURES))


def _seen(model: Model, values: list[np.ndarray]) -> np.ndarray:
    """The log probability of each line in each state."""
    return np.sum([e.T[v] for e, v in zip(model.emit, values, strict=True)], axis=0).reshape(-1, model.step.shape[0])


def viterbi(model: Model, seen: np.ndarray, starts: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """The best state of each line of many sequences, which are decoded in step.

    ``seen`` are the lines' log probabilities one sequence after the other. ``entry`` is the state before a sequence, -1
    where it is the beginning; ``leave`` its last state, -1 where any may be.
    """
    n_states = model.step.shape[0]
    length = np.diff(np.append(starts, len(seen)))
    order = np.argsort(-length, kind="stable")
    starts, length, entry, leave = starts[order], length[order], entry[order], leave[order]
    first = np.where(entry[:, None] < 0, model.start, model.step[np.maximum(entry, 0)])
    score = first + seen[starts]
    back = []
    for t in range(1, int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -t, side="left"))  # sequences longer than t
        ways = score[:n, :, None] + model.step
        best = ways.argmax(axis=1).astype(np.uint8)
        score[:n] = np.take_along_axis(ways, best[:, None, :].astype(np.int64), axis=1)[:, 0] + seen[starts[:n] + t]
        back.append(best)
    state = np.where(leave < 0, score.argmax(axis=1), leave)
    out = np.zeros(len(seen), np.int64)
    out[starts + length - 1] = state
    for t in range(len(back), 0, -1):
        n = len(back[t - 1])
        state[:n] = back[t - 1][np.arange(n), state[:n]]
        out[starts[:n] + t - 1] = state[:n]
    assert n_states <= 255
    return out


def transfer(model: Model, seen: np.ndarray, beginning: bool) -> np.ndarray:
    """The best score from each state before a block to each state at its end; one row for all if it is the beginning."""
    table = (np.tile(model.start, (len(model.start), 1)) if beginning else model.step.copy()) + seen[0]
    for line in seen[1:]:
        table = (table[:, :, None] + model.step).max(axis=1) + line
    return table


def best_between(tables: list[np.ndarray]) -> list[int]:
    """The last state of each block on the best way through all of them; the first table is the beginning's."""
    score, back = tables[0][0], []
    for table in tables[1:]:
        ways = score[:, None] + table
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    states = [int(score.argmax())]
    for best in reversed(back):
        states.append(int(best[states[-1]]))
    return states[::-1]


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole sequences, rows with equal first ``keys`` columns, and where each starts; rows come in order."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_LINES:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, keys)
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
            held = table.slice(last).combine_chunks().to_batches()
            size = table.num_rows - last
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for i in range(keys):
        column = table.column(i).combine_chunks()
        value, null = column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _values(table: pa.Table) -> list[np.ndarray]:
    return [table.column(name).to_numpy() for name in FEATURES]


_TABLES = "id long, block long, cells array<double>"


def _tables(model: Model):
    """The table of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_runs(batches, 3):
            seen = _seen(model, _values(table))
            ends = np.append(starts[1:], table.num_rows)
            opens = table.column("opens").to_numpy(zero_copy_only=False)
            cells = [transfer(model, seen[a:b], bool(opens[a])).reshape(-1).tolist() for a, b in zip(starts, ends, strict=True)]
            arrays = [table.column(c).combine_chunks().take(pa.array(starts)) for c in ("id", "block")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cells, pa.list_(pa.float64()))], ["id", "block", "cells"])

    return run


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and at the end of each block; a row has one block, those of one id follow each other."""
    current, blocks, tables = None, [], []

    def flush() -> pa.RecordBatch:
        leave = best_between(tables)
        arrays = [pa.array([current] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array([-1, *leave[:-1]], pa.int32()), pa.array(leave, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["id", "block", "entry", "leave"])

    for batch in batches:
        for id_, block, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if blocks and id_ != current:
                yield flush()
                blocks, tables = [], []
            current = id_
            blocks.append(block)
            tables.append(np.array(cells).reshape(STATES, STATES))
    if blocks:
        yield flush()


_PIECES = "id long, block long, nth int, role string, first_turn long, first_line int, n_lines int, text string"


def _pieces(model: Model):
    """Runs of lines of one turn; nth counts the turns that begin in the block, 0 goes on with the block before."""
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_runs(batches, 3):
            entry, leave = (table.column(c).fill_null(-1).to_numpy()[starts] for c in ("entry", "leave"))
            state = viterbi(model, _seen(model, _values(table)), starts, entry, leave)
            begins = np.zeros(table.num_rows, bool)
            begins[starts] = True
            cut = begins | (state % 2 == 0)
            opens = (state % 2 == 0) | (begins & np.repeat(entry < 0, np.diff(np.append(starts, table.num_rows))))
            at = np.flatnonzero(cut)
            end = np.append(at[1:], table.num_rows)
            run_of = np.searchsorted(starts, at, side="right") - 1
            opened = np.cumsum(opens)
            nth = opened[at] - (opened[starts] - opens[starts])[run_of]
            lines = table.column("line").to_pylist()
            marker = table.column("marker").to_numpy()
            texts = []
            for a, b in zip(at.tolist(), end.tolist(), strict=True):
                head = lines[a]
                if opens[a] and marker[a]:
                    head = (_STRIP if marker[a] <= len(MARKERS) else _STRIP_OTHER).sub("", head, count=1)
                texts.append("\n".join([head, *lines[a + 1 : b]]))
            take = lambda c: table.column(c).combine_chunks().take(pa.array(at))  # noqa: B023, E731
            columns = [take("id"), take("block"), nth, [ROLES[s // 2] for s in state[at].tolist()], take("turn"), take("line_no"), end - at, texts]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return run


def render(role: Column, text: Column) -> Column:
    """One turn in canonical form; what looks like a control mark in the text is broken up."""
    body = F.replace(F.replace(F.btrim(text, F.lit("\n")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n"))


def parse_transcripts(lines: DataFrame, model: Model) -> DataFrame:
    """(id, turn, role, first_turn, first_line, n_lines, rendered) for every turn found in ``transcript_lines``."""
    order = ["id", "solo", "block", "turn", "tie", "line_no"]
    wanted = lines.select(*order, "line", *FEATURES)
    dealt = lambda df: df.repartition("id", "solo", "block").sortWithinPartitions(*order)
    blocks = wanted.where("id IS NOT NULL").groupBy("id").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first < last").select("id", "first")
    blocks = stored(blocks, "long")
    large = wanted.join(small_side(blocks), "id").withColumn("opens", F.col("block") == F.col("first")).drop("first")
    tables = dealt(large.select(*order, *FEATURES, "opens")).mapInArrow(_tables(model), _TABLES)
    states = tables.repartition("id").sortWithinPartitions("id", "block").mapInArrow(_between, "id long, block long, entry int, leave int")
    states = stored(states, "states")
    known = wanted.join(small_side(states), ["id", "block"], "left").select(*order, "line", *FEATURES, "entry", "leave")
    pieces = dealt(known).mapInArrow(_pieces(model), _PIECES)
    alone = pieces.join(small_side(blocks.select("id")), "id", "left_anti")
    alone = alone.select("id", (F.col("nth") - 1).alias("turn"), "role", "first_turn", "first_line", "n_lines", "text")
    if not blocks.isEmpty():
        spread = stored(pieces.join(small_side(blocks.select("id")), "id", "left_semi"), "pieces")
        before = spread.groupBy("id", "block").agg(F.max("nth").alias("opened"))
        earlier = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
        before = before.select("id", "block", F.coalesce(F.sum("opened").over(earlier), F.lit(0)).cast("int").alias("before"))
        joined = spread.join(before, ["id", "block"]).withColumn("turn", F.col("before") + F.col("nth") - 1)
        parts = F.array_sort(F.collect_list(F.struct("block", "nth", "role", "first_turn", "first_line", "text")))
        joined = joined.groupBy("id", "turn").agg(parts.alias("p"), F.sum("n_lines").cast("int").alias("n_lines"))
        first = F.get("p", F.lit(0))
        text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
        alone = alone.unionByName(joined.select("id", "turn", first["role"].alias("role"), first["first_turn"].alias("first_turn"), first["first_line"].alias("first_line"), "n_lines", text.alias("text")))
    return alone.select("id", "turn", "role", "first_turn", "first_line", "n_lines", render(F.col("role"), F.col("text")).alias("rendered"))


#: Ways in which transcripts mark speakers, by role.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System: ", "### Human: ", "### Assistant: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("Context: ", "Q: ", "A: "),
    ("Setting: ", "Robin: ", "Doctor Lee: "),
)
UNMARKED_ONE_IN = 10


def unevenly_marked(conversations: DataFrame) -> DataFrame:
    """The turns with their text as a transcript would have it: one style for each conversation, one turn in ten unmarked.

    A made input: the given conversations have their roles in a column and none in their texts.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    place = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    marks = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    mark = F.coalesce(F.get(F.get(marks, style), place - 1), F.lit(""))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(UNMARKED_ONE_IN)) == 0
    return conversations.withColumn("text", F.concat(F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit(""))))


def format_conversations(conversations: DataFrame, train: int = TRAIN_CONVERSATIONS) -> DataFrame:
    """Fits on conversations with roles, then recovers the turns of all of them from their lines alone."""
    turns = unevenly_marked(conversations.select("conv_id", "turn", "role", "text"))
    model = fit(transcript_lines(turns, role_col="role"), train)
    return parse_transcripts(transcript_lines(turns), model)
