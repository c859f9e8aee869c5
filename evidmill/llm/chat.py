"""Chat formatting with minimum-cost role repair.

Legal conversations are the words of an automaton: at most one system turn, first, then user and assistant in turn, user
first. A conversation that isn't legal is repaired at the least cost by merging a turn into the one before it, giving it
another role, or inserting an empty turn. Dynamic programming finds the repair: the state is the role that was spoken last.

A stretch of turns acts on the states as a matrix of least costs, and matrices of neighbouring stretches combine by
(minimum, plus) products. Long conversations are therefore cut into segments that are worked on side by side: matrices are
combined upwards, the states at the cuts are chosen downwards, and every segment is then repaired between its two states.
"""

from __future__ import annotations

from itertools import groupby
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidmill.llm.common import BROADCAST_ROWS, prepare, written
from evidmill.operators.grouping import global_index

STATES = ("start", "system", "user", "assistant")
ROLES = STATES[1:]

# Costs of the repairs. Relabelling a turn whose role is unknown is cheaper than contradicting a stated role.
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 1.0, 2.0, 3.0, 0.5

# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant"}

# Turns of a segment, and segments that are combined at a time.
SEGMENT = 512

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"
_START = 0
_COLUMNS = ["conv_id", "turn", "role", "repaired_role", "action", "inserted", "cost", "chunk"]


def legal_next(state: int) -> dict[int, tuple[float, list[int]]]:
    """States that can follow, with cost and the empty turns to insert; a turn of the same role merges."""
    user, assistant, system = STATES.index("user"), STATES.index("assistant"), STATES.index("system")
    if state == _START:
        return {system: (0.0, []), user: (0.0, []), assistant: (INSERT, [user])}
    if state == system:
        return {system: (MERGE, []), user: (0.0, []), assistant: (INSERT, [user])}
    return {state: (MERGE, []), (assistant if state == user else user): (0.0, [])}


_NEXT = [legal_next(s) for s in range(len(STATES))]


def role_of(role: str | None) -> str | None:
    """The role a name stands for; None where it is none of the known ones."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def step(role: str | None) -> np.ndarray:
    """Cost of each move from state to state by a turn of ``role``; infinite where the automaton has none."""
    known, out = role_of(role), np.full((len(STATES), len(STATES)), np.inf)
    for s in range(len(STATES)):
        for q, (cost, _) in _NEXT[s].items():
            relabel = 0.0 if known == STATES[q] else RELABEL if known else NAME_UNKNOWN
            out[s, q] = cost + relabel
    return out


_STEPS: dict[str | None, np.ndarray] = {}


def steps(roles: Iterable[str | None]) -> list[np.ndarray]:
    out = []
    for role in roles:
        known = role_of(role)
        if known not in _STEPS:
            _STEPS[known] = step(known)
        out.append(_STEPS[known])
    return out


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The (minimum, plus) product in order."""
    total = matrices[0]
    for m in matrices[1:]:
        total = (total[:, :, None] + m[None, :, :]).min(axis=1)
    return total


def path(matrices: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """The cheapest states after each matrix, from ``entry`` to ``leave`` (any, if None). Ties: the first state of ``STATES``."""
    cost, back = np.full(len(STATES), np.inf), []
    cost[entry] = 0.0
    for m in matrices:
        choice = cost[:, None] + m
        back.append(choice.argmin(axis=0))
        cost = choice.min(axis=0)
    state = int(cost.argmin()) if leave is None else leave
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def repair(roles: list[str | None], texts: list[str | None], entry: int = _START, leave: int | None = None, ends: bool = True):
    """``role, action, inserted, cost, chunk`` per turn. The chunks of a conversation, joined, are its rendered form.

    A chunk closes the turn before it and opens its own, unless it merges; the last chunk of all also closes itself. Marks
    of the format inside a text are kept apart from real ones by a blank.
    """
    state, moves = entry, steps(roles)
    for k, q in enumerate(path(moves, entry, leave)):
        _, between = _NEXT[state][q]
        merged = q == state
        text = (texts[k] or "").replace(_OPEN, "< |im_start|>").replace(_CLOSE, "< |im_end|>")
        if merged:
            chunk = "\n\n" + text
        else:
            chunk = (_CLOSE + "\n" if state != _START else "") + "".join(f"{_OPEN}{STATES[b]}\n{_CLOSE}\n" for b in between) + f"{_OPEN}{STATES[q]}\n" + text
        if ends and k == len(roles) - 1:
            chunk += _CLOSE + "\n"
        kept = role_of(roles[k]) == STATES[q]
        action = "+".join([*["insert"] * bool(between), *["merge"] * merged, *["relabel"] * (not kept)]) or "keep"
        yield STATES[q], action, len(between), float(moves[k][state, q]), chunk
        state = q


def _stretches(batches: Iterator[pd.DataFrame], keys: list[str]):
    """Runs of rows with equal keys, across the borders of batches."""
    rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
    return groupby(rows, key=lambda row: row[: len(keys)])


def _sorted(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def cuts(multi: DataFrame) -> DataFrame:
    """``_key, _segment, entry, leave`` for the segments of conversations that have several.

    ``multi``: ``_key, _segment, _place, role``. Each level combines up to ``SEGMENT`` neighbours, so a conversation of any
    length takes a few levels and no task holds more than that.
    """
    def matrix(batches):
        rows = [(key, segment, product(steps(r[3] for r in run)).ravel().tolist()) for (key, segment), run in _stretches(batches, ["_key", "_segment"])]
        yield pd.DataFrame(rows, columns=["_key", "_node", "m"])

    level = written(_sorted(multi.select("_key", "_segment", "_place", "role"), ["_key", "_segment"], "_place").mapInPandas(matrix, "_key string, _node long, m array<double>"), "chat-level")

    def combine(batches):
        rows = [(key, up, product([np.reshape(r[3], (len(STATES),) * 2) for r in run]).ravel().tolist()) for (key, up), run in _stretches(batches, ["_key", "_up"])]
        yield pd.DataFrame(rows, columns=["_key", "_node", "m"])

    def above(df):
        return df.select("_key", F.floor(F.col("_node") / SEGMENT).cast("long").alias("_up"), "_node", "m")

    levels = [level]
    while not levels[-1].groupBy("_key").count().where("count > 1").isEmpty():
        levels.append(written(_sorted(above(levels[-1]), ["_key", "_up"], "_node").mapInPandas(combine, "_key string, _node long, m array<double>"), "chat-level"))

    def choose(batches):
        rows = []
        for (key, up), run in _stretches(batches, ["_key", "_up"]):
            run = list(run)
            entry, leave = int(run[0][4]), int(run[0][5])
            after = path([np.reshape(r[3], (len(STATES),) * 2) for r in run], entry, leave if leave >= 0 else None)
            rows.extend((key, r[2], a, b) for r, a, b in zip(run, [entry, *after[:-1]], after))
        yield pd.DataFrame(rows, columns=["_key", "_node", "entry", "leave"])

    states = levels[-1].select("_key", "_node", F.lit(_START).alias("entry"), F.lit(-1).alias("leave"))
    for below in reversed(levels[:-1]):
        given = above(below).join(states.withColumnRenamed("_node", "_up"), ["_key", "_up"]).select("_key", "_up", "_node", "m", "entry", "leave")
        states = written(_sorted(given, ["_key", "_up"], "_node").mapInPandas(choose, "_key string, _node long, entry int, leave int"), "chat-states")
    return states.withColumnRenamed("_node", "_segment")


def by_position(rows: DataFrame, crowded: DataFrame, segment: int) -> DataFrame:
    """``rows`` with segments of the conversations in ``crowded`` cut by place in the conversation, at most ``segment`` rows each.

    Turn numbers don't bound the rows of a segment where many rows share one or have none. Places come from a distributed
    index in the order of the repair; rows that are the same in all are told apart, so they are spread too.
    """
    flagged = crowded.withColumn("_crowded", F.lit(True))
    marked = rows.join(F.broadcast(flagged) if flagged.count() <= BROADCAST_ROWS else flagged, "_key", "left")
    order = [F.col("_key"), F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text"), F.col("_copy")]
    placed = global_index(marked.where("_crowded").withColumn("_copy", F.monotonically_increasing_id()), order, "_row")
    first = placed.groupBy("_key").agg(F.min("_row").alias("_first_row"))
    first = F.broadcast(first) if flagged.count() <= BROADCAST_ROWS else first
    cut = placed.join(first, "_key").withColumn("_segment", F.floor((F.col("_row") - F.col("_first_row")) / segment).cast("long"))
    return marked.where("_crowded IS NULL").select(rows.columns).unionByName(cut.select(rows.columns))


def format_turns(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, turn, role, repaired_role, action, inserted, cost, chunk``: one row per row of ``turns``.

    Turns of a conversation follow one another by ``turn``, absent turns last, and ties by role and text. Rows without a
    ``conv_id`` form one conversation, which is spread over tasks like any other. Null texts are empty; null and unknown roles are relabelled. Other columns are
    ignored; an empty table gives no rows.
    """
    prepare(turns.sparkSession)
    key = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("_key", key)
    rows = rows.withColumn("_segment", F.coalesce(F.floor(F.col("turn") / segment).cast("long"), F.lit(1 << 60)))
    crowded = rows.groupBy("_key", "_segment").agg(F.count("*").alias("_n")).where(F.col("_n") > segment).select("_key").distinct()
    if not crowded.isEmpty():
        rows = written(by_position(rows, written(crowded, "chat-crowded"), segment), "chat-placed")
    ends = rows.groupBy("_key").agg(F.min("_segment").alias("_first"), F.max("_segment").alias("_last"))
    several = ends.where("_first < _last").select("_key")
    many = not several.isEmpty()
    if many:
        # The same order as below.
        multi = rows.join(several, "_key", "left_semi").select("_key", "_segment", F.struct(F.col("turn").isNull().alias("x"), "turn", "role", "text").alias("_place"), "role")
        states = cuts(multi)
        rows = rows.join(ends.select("_key", "_last"), "_key").join(states, ["_key", "_segment"], "left")
    else:
        rows = rows.withColumn("_last", F.col("_segment")).withColumn("entry", F.lit(None).cast("int")).withColumn("leave", F.lit(None).cast("int"))
    flat = rows.select("_key", "_segment", F.coalesce("entry", F.lit(_START)).alias("entry"), F.coalesce("leave", F.lit(-1)).alias("leave"),
                       (F.col("_segment") == F.col("_last")).alias("_ends"), F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "role", "text",
                       F.col("turn").isNull().alias("_late"), F.col("turn").alias("_turn"))

    def work(batches):
        def out():
            for _, run in _stretches(batches, ["_key", "_segment"]):
                run = list(run)
                first = run[0]
                fixed = repair([r[7] for r in run], [r[8] for r in run], int(first[2]), int(first[3]) if first[3] >= 0 else None, bool(first[4]))
                for r, f in zip(run, fixed):
                    yield (r[5], r[6], r[7], *f)

        pending = []
        for row in out():
            pending.append(row)
            if len(pending) >= 2_000:
                yield pd.DataFrame(pending, columns=_COLUMNS, dtype=object)
                pending = []
        if pending:
            yield pd.DataFrame(pending, columns=_COLUMNS, dtype=object)

    done = _sorted(flat, ["_key", "_segment"], "_late", "_turn", "role", "text").mapInPandas(
        work, "conv_id string, turn string, role string, repaired_role string, action string, inserted int, cost double, chunk string")
    types = dict(turns.dtypes)
    return done.withColumn("conv_id", F.col("conv_id").cast(types["conv_id"])).withColumn("turn", F.col("turn").cast(types["turn"]))
