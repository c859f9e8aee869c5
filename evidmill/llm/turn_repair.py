"""Conversation structure repair by a streamed dynamic programme over turns in order.

Rows are dealt by conversation and sorted by turn inside each partition; nothing else is shuffled, and no conversation is held
in memory. Two passes run over the sorted rows of a partition, batch by batch:

- backwards, carrying for each state of the automaton the least cost to the conversation's end and the rank of its edit
  string. Every row gets a back pointer of 16 bits: for each of four states the empty turns to insert and the edit.
- forwards, after the rows are sorted the other way, following the pointers from the start state.

Between the passes the rows with their pointers lie in Spark's own sorter, which spills to disk when a conversation is
giant. Edit strings are compared from the end: an edit before two tails leaves them in the order of their ranks, so the
vector of (cost, rank) pairs, relative to the least, is all that the pass carries; as there are few such vectors, steps are
remembered by (vector, kind of row).

The automaton accepts the role initials ``(s?(ua)+)?``.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from evidmill.llm.common import prepare

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5

# States by the last role: none yet, system, user, assistant. What each may be followed by, and what an inserted turn is.
_LEGAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FORCED = ("u", "u", "a", "u")
_NAMES = {"u": "user", "a": "assistant"}
_EDITS = "DKR"
_ACCEPTED = (0, 3)

FAULTS = ("blank", "duplicate", "truncated")
_BLANK = " \t\n\x0b\x0c\r"

_Vector = tuple[tuple[int, int], ...]


def _with_inserts(direct: list[tuple[int, tuple]]) -> list[tuple[int, tuple]]:
    """The best ``(cost, edits)`` per state when empty turns may come before ``direct``'s edit; tails are compared by rank."""
    put = lambda best: (INSERT + best[0], ("I", *best[1]))
    user, assistant = min(direct[2], put(direct[3])), min(direct[3], put(direct[2]))
    return [min(direct[0], put(user)), min(direct[1], put(user)), user, assistant]


def _ranked(best: list[tuple[int, tuple]]) -> tuple[int, _Vector]:
    """The least cost, and per state the cost above it and the rank of its edits."""
    base, order = min(c for c, _ in best), sorted({e for _, e in best})
    return base, tuple((c - base, order.index(e)) for c, e in best)


def at_end() -> tuple[int, _Vector]:
    """The vector behind the last row: what must still be inserted."""
    never = (1 << 20, ())
    return _ranked(_with_inserts([(0, ()) if s in _ACCEPTED else never for s in range(4)]))


_STEPS: dict[tuple[_Vector, str, int], tuple[int, _Vector, int]] = {}


def before(after: _Vector, initial: str, fault: int) -> tuple[int, _Vector, int]:
    """What is added to the cost, the vector before a row, and the row's back pointer, from the vector behind it.

    ``fault``: 0 none, else the place in ``FAULTS`` from 1. Four bits of the pointer per state: three times the inserts plus the edit.
    """
    known = _STEPS.get((after, initial, fault))
    if known:
        return known
    stays, extra, direct = fault in (0, 3), UNFINISHED if fault == 3 else 0, []
    for state in range(4):
        options = [(DELETE + after[state][0], ("D", after[state][1]))]
        if stays and initial in _LEGAL[state]:
            cost, rank = after[_LEGAL[state][initial]]
            options.append((KEEP + extra + cost, ("K", rank)))
        if stays:
            cost, rank = after[_LEGAL[state][_FORCED[state]]]
            options.append((REROLE + extra + cost, ("R", rank)))
        direct.append(min(options))
    best = _with_inserts(direct)
    pointer = 0
    for state, (_, edits) in enumerate(best):
        pointer |= (3 * edits.count("I") + _EDITS.index(edits[-2])) << 4 * state
    _STEPS[after, initial, fault] = known = (*_ranked(best), pointer)
    return known


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_pointer`` and, on a conversation's first row, ``_cost``. Rows come last turn first."""
    key, total, vector = object(), 0, None
    for batch in batches:
        pointers, costs = [], []
        for name, initial, fault, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "_initial", "_fault", "_first"))):
            if name != key:
                key, (total, vector) = name, at_end()
            pointer = 0
            if fault is not None:
                added, vector, pointer = before(vector, initial, fault)
                total += added
            pointers.append(pointer)
            costs.append(total + vector[0][0] if first else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pointers, pa.int32()), pa.array(costs, pa.int64())], names=[*batch.schema.names, "_pointer", "_cost"])


def _edits(state: int, pointer: int | None, role: str, text: str | None, initial: str) -> Iterator[tuple[int, str, str | None, str | None]]:
    """``(state, edit, role, text)`` of the edits that one row brings about; at the end of all (no pointer), the last inserts."""
    if pointer is None:
        inserts, edit = (0 if state in _ACCEPTED else 1 if state == 2 else 2), None
    else:
        inserts, edit = divmod(pointer >> 4 * state & 15, 3)
    for _ in range(inserts):
        made = _FORCED[state]
        state = _LEGAL[state][made]
        yield state, "I", _NAMES[made], ""
    if edit == 0:
        yield state, "D", None, None
    elif edit is not None:
        initial, role = (initial, role) if edit == 1 else (_FORCED[state], _NAMES[_FORCED[state]])
        yield _LEGAL[state][initial], _EDITS[edit], role, text


class _Summary:
    """What one pass over a conversation in order gathers."""

    def __init__(self, key, cost: int) -> None:
        self.key, self.cost, self.state = key, cost, 0
        self.low = self.high = self.previous = None
        self.distinct = self.illegal = 0
        self.faults, self.audit, self.digest, self.lines, self.initial = [0, 0, 0], [], hashlib.sha256(), 0, None

    def take(self, turn, role, text, initial, fault, pointer) -> None:
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            self.faults[fault - 1] += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self._follow(pointer, role, text, initial)

    def _follow(self, pointer, role, text, initial) -> None:
        for self.state, edit, name, body in _edits(self.state, pointer, role, text, initial):
            self.audit.append(edit)
            if name is not None:
                self.digest.update(f"{chr(10) if self.lines else ''}{name}:{body}".encode())
                self.lines += 1

    def row(self) -> tuple:
        if self.initial is not None:
            self._follow(None, "", None, "")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.key, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_ROW = ("conv_id", "turn", "role", "text", "_initial", "_fault", "_pointer", "_cost", "_first")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in _ROW))


def _ordered(turns: DataFrame, absent: Column) -> DataFrame:
    """The rows with faults, dealt by conversation, each with its back pointer, in order. One shuffle in all."""
    rows = turns.withColumn("_gone", absent).select(
        "conv_id", F.when(~F.col("_gone"), F.col("turn")).cast("long").alias("turn"), F.when(~F.col("_gone"), F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(~F.col("_gone"), F.coalesce("text", F.lit(" "))).alias("text"), "_gone")
    dealt = rows.repartition("conv_id")
    # The partitioning by conversation serves both windows too: their sorts are local.
    seen = F.row_number().over(Window.partitionBy("conv_id", "_gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    bare = F.rtrim(F.col("text"), F.lit(_BLANK))
    fault = F.when(bare == "", 1).when(F.col("_seen") > 1, 2).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    place = [F.col("_gone").desc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("_seen").asc()]
    marked = dealt.withColumn("_seen", seen).withColumn("_fault", F.when(~F.col("_gone"), fault)).withColumn("_initial", F.substring("role", 1, 1))
    marked = marked.withColumn("_first", F.row_number().over(Window.partitionBy("conv_id").orderBy(*place)) == 1)
    last_first = [F.col("_gone").asc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("_seen").desc()]
    backwards = marked.sortWithinPartitions("conv_id", *last_first)
    columns = [T.StructField(f.name, f.dataType) for f in backwards.schema.fields]
    pointed = backwards.mapInArrow(_backwards, T.StructType([*columns, T.StructField("_pointer", T.IntegerType()), T.StructField("_cost", T.LongType())]))
    return pointed.sortWithinPartitions("conv_id", *place)


def summaries(turns: DataFrame, absent: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: one row per conversation.

    ``turns``: ``conv_id, turn, role, text``; other columns are ignored. Rows for which ``absent`` holds only name their
    conversation. Turns follow one another by ``turn``, null first; ties by role, then text. Null roles and texts are one space;
    rows without ``conv_id`` are one conversation; an empty role can't be kept. Of equal (role, text) all but the first are duplicates, repeated rows too.
    A conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives no rows.
    """
    prepare(turns.sparkSession)
    kind = turns.select("conv_id").schema["conv_id"].dataType.simpleString()
    arrow = pa.schema([pa.field("conv_id", to_arrow_type(turns.schema["conv_id"].dataType)), *[pa.field(c, pa.int64()) for c in _COLUMNS[1:7]], *[pa.field(c, pa.string()) for c in _COLUMNS[7:]]])

    def forwards(batches):
        ready, now = [], None
        for key, turn, role, text, initial, fault, pointer, cost, first in _rows(batches):
            if first:
                if now:
                    ready.append(now.row())
                now = _Summary(key, cost)
            if fault is not None:
                now.take(turn, role, text, initial, fault, pointer)
            if len(ready) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)
                ready = []
        if now:
            ready.append(now.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)

    counts = ", ".join(f"{c} long" for c in _COLUMNS[1:7])
    return _ordered(turns, F.lit(False) if absent is None else absent).mapInArrow(forwards, f"conv_id {kind}, {counts}, audit string, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text``: one row per edit (D, I, K, R) in order, the repaired turn beside it.

    Deleted rows have null role and text, inserted ones a null turn. Inputs and their special cases as in ``summaries``.
    """
    prepare(turns.sparkSession)
    kind = turns.select("conv_id").schema["conv_id"].dataType.simpleString()
    arrow = pa.schema([pa.field("conv_id", to_arrow_type(turns.schema["conv_id"].dataType)), pa.field("place", pa.int64()), pa.field("edit", pa.string()),
                       pa.field("turn", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string())])

    def forwards(batches):
        ready, key, state, place = [], None, 0, 0

        def edits(pointer, turn, role, text, initial):
            nonlocal state, place
            for state, edit, name, body in _edits(state, pointer, role, text, initial):
                yield key, place, edit, None if edit == "I" else turn, name, body
                place += 1

        begun = False
        for name, turn, role, text, initial, _, pointer, _, first in _rows(batches):
            if first:
                if begun:
                    ready.extend(edits(None, None, "", None, ""))
                key, state, place, begun = name, 0, 0, True
            ready.extend(edits(pointer, turn, role, text, initial))
            if len(ready) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)
                ready = []
        if begun:
            ready.extend(edits(None, None, "", None, ""))
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), arrow)], schema=arrow)

    return _ordered(turns, F.lit(False)).mapInArrow(forwards, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """Test damage by crc32 of ``conv_id:turn`` (null: one space) modulo 20; a row that 0 drops stays with ``_dropped``."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    hurt = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), code.alias("_code"))
    hurt = hurt.withColumn("text", F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    hurt = hurt.withColumn("role", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")))
    copies = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "turn", "role", "text", (F.col("_code") == 0).alias("_dropped"), copies.alias("_copy")).drop("_copy")
