"""JSON text as rows that know their place, so that it can be edited without being written anew.

A tokenizer walks a document once, with its own stack, at any depth. Every string value and every object key becomes a row
with the characters it stands at; edits replace those characters and leave all others, so numbers, escapes, repeated keys
and white space stay as they were.
"""

from __future__ import annotations

import json
import re
from typing import Iterator, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidmill.session import ship_package

STATE_KEY = "redaction_state"

_TOKEN = re.compile(
    r"""[ \t\n\r]*(?:(?P<string>"[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")"""
    r"""|(?P<mark>[{}\[\],:])|(?P<other>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))""")
_PIECE = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)
_LONE = re.compile("[\ud800-\udfff]")

FIELDS = ("location", "path", "pointer", "name", "text", "start", "stop", "owner", "state", "state_start", "state_stop")
_TYPES = "location string, path string, pointer string, name string, text string, start int, stop int, owner string, state string, state_start int, state_stop int"


class _Holder:
    """An object or a list that is being read."""

    __slots__ = ("above", "is_object", "path", "pointer", "slot", "states", "has_state")

    def __init__(self, above: _Holder | None, is_object: bool, path: str, pointer: str) -> None:
        self.above, self.is_object, self.path, self.pointer = above, is_object, path, pointer
        self.slot: str | int = 0
        self.states: list[tuple[int, int, str]] = []
        self.has_state = False

    def inside(self) -> tuple[str, str]:
        """Path and pointer of the value that comes next. A pointer tells keys with dots and slashes apart."""
        if self.is_object:
            return f"{self.path}.{self.slot}", f"{self.pointer}/{str(self.slot).replace('~', '~0').replace('/', '~1')}"
        return f"{self.path}[{self.slot}]", f"{self.pointer}/{self.slot}"


class Item(NamedTuple):
    """A string value or an object key, with the holder around it."""

    location: str
    path: str
    pointer: str
    name: str | None
    text: str
    start: int
    stop: int
    holder: _Holder | None


def _decoded(literal: str) -> str:
    """The text of a string literal; half a surrogate pair, which UTF-8 can't hold, becomes U+FFFD."""
    return _LONE.sub("�", json.loads(literal)) if "\\" in literal else literal[1:-1]


def items(text: str) -> list[Item] | None:
    """String values and keys in the order of the text; None where it is no JSON."""
    out: list[Item] = []
    holder: _Holder | None = None
    wanted, at = "value", 0
    while True:
        if wanted == "end":
            return out if not text[at:].strip(" \t\n\r") else None
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at, mark, string = m.end(), m["mark"], m["string"]
        if wanted in ("value", "value or ]") and (string or m["other"]):
            if string:
                path, pointer = holder.inside() if holder else ("$", "")
                name = holder.slot if holder and holder.is_object else None
                item = Item("value", path, pointer, name, _decoded(string), m.start("string"), at, holder)
                out.append(item)
                if name == STATE_KEY:
                    holder.states.append((item.start, item.stop, item.text))
            wanted = ", or close" if holder else "end"
        elif wanted in ("value", "value or ]") and mark and mark in "{[":
            path, pointer = holder.inside() if holder else ("$", "")
            holder = _Holder(holder, mark == "{", path, pointer)
            wanted = "key or }" if mark == "{" else "value or ]"
        elif wanted in ("key", "key or }") and string:
            holder.slot = _decoded(string)
            holder.has_state |= holder.slot == STATE_KEY
            path, pointer = holder.inside()
            out.append(Item("key", path + "<key>", pointer, None, holder.slot, m.start("string"), at, holder))
            wanted = ":"
        elif wanted == ":" and mark == ":":
            wanted = "value"
        elif wanted == ", or close" and mark == ",":
            if not holder.is_object:
                holder.slot += 1
            wanted = "key" if holder.is_object else "value"
        elif mark and (mark == "}" and holder and holder.is_object and wanted in (", or close", "key or }")
                       or mark == "]" and holder and not holder.is_object and wanted in (", or close", "value or ]")):
            holder = holder.above
            wanted = ", or close" if holder else "end"
        else:
            return None


def _owner(holder: _Holder | None) -> _Holder | None:
    """The nearest object that carries a state."""
    while holder and not holder.has_state:
        holder = holder.above
    return holder


def rows(text: str) -> Iterator[tuple]:
    """``FIELDS`` of each item, with the nearest object that carries a state; text that is no JSON is one row of its own."""
    found = items(text)
    if found is None:
        yield "text", "$", "", None, text, 0, len(text), None, None, None, None
        return
    for item in found:
        # Keys are only reported, so they have no owner. Of repeated states the last counts.
        owner = _owner(item.holder) if item.location == "value" else None
        state = owner.states[-1] if owner and owner.states else (None, None, None)
        yield (*item[:7], owner.path if owner else None, state[2], state[0], state[1])


def tokens(docs: DataFrame, key: str, json_text: str) -> DataFrame:
    """One row per string value, object key or text without JSON: ``key`` and ``FIELDS``.

    ``location`` is ``value``, ``key`` or ``text``; ``path`` is for reading, ``pointer`` tells all values apart but those under
    repeated keys, which ``start`` does; ``start`` and ``stop`` are code points of the text, quotes included. Null texts give no rows.
    """
    ship_package(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ready = []
            for name, text in batch.itertuples(index=False, name=None):
                for row in rows(text):
                    ready.append((name, *row))
                    if len(ready) >= 5_000:
                        yield _frame(ready, key)
                        ready = []
            if ready:
                yield _frame(ready, key)

    return docs.where(F.col(json_text).isNotNull()).select(key, json_text).mapInPandas(work, f"`{key}` {kind}, {_TYPES}")


def _frame(ready: list[tuple], key: str) -> pd.DataFrame:
    frame = pd.DataFrame(ready, columns=[key, *FIELDS], dtype=object)
    return frame.astype({c: "Int64" for c in ("start", "stop", "state_start", "state_stop")})


class Edit(NamedTuple):
    """New text for a string value; ``parts`` are ``(start, end, at)``: what changed in its text, and where it is in the new one."""

    start: int
    stop: int
    new: str
    parts: list[tuple[int, int, int]]


def _literal(old: str, edit: Edit) -> str:
    """The literal with only the changed parts replaced; characters around them keep the escapes they had."""
    pieces = _PIECE.findall(old[1:-1]) if "\\" in old else old[1:-1]
    out, cursor = [], 0
    for k, (start, end, at) in enumerate(edit.parts):
        gap = edit.parts[k + 1][0] - end if k + 1 < len(edit.parts) else len(pieces) - end
        upto = edit.parts[k + 1][2] - gap if k + 1 < len(edit.parts) else len(edit.new) - gap
        out += ["".join(pieces[cursor:start]), json.dumps(edit.new[at:upto], ensure_ascii=False)[1:-1]]
        cursor = end
    return '"' + "".join(out) + "".join(pieces[cursor:]) + '"'


def spliced(text: str, edits: list[Edit]) -> str:
    """``text`` with edits, which don't overlap, put in; an edit without parts replaces the whole value."""
    out, cursor = [], 0
    for edit in sorted(edits):
        old = text[edit.start : edit.stop]
        out += [text[cursor : edit.start], _literal(old, edit) if edit.parts else json.dumps(edit.new, ensure_ascii=False)]
        cursor = edit.stop
    return "".join(out) + text[cursor:]


EDITS = "array<struct<start:int,stop:int,new:string,parts:array<struct<start:int,end:int,at:int>>>>"


def splice(text: Column, edits: Column) -> Column:
    """``spliced`` over columns; ``edits`` of type ``EDITS``. The caller ships the package."""

    @F.pandas_udf("string")
    def put(texts: pd.Series, changes: pd.Series) -> pd.Series:
        def one(value, rows):
            return spliced(value, [Edit(r["start"], r["stop"], r["new"], [(p["start"], p["end"], p["at"]) for p in r["parts"]]) for r in rows])

        return pd.Series([one(t, r) for t, r in zip(texts, changes)], dtype=object)

    return put(text, edits)


def tolerant(text: Column) -> Column:
    """a text as VARIANT: its JSON value, or the text itself, as a string, where it is no JSON or too large for one."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


# Columns of the stored tables that hold JSON.
JSON_COLUMNS = ("command", "evidence_refs", "payload", "producer_command", "span")


def decoded_rows(df: DataFrame) -> DataFrame:
    """a stored table with its JSON columns as VARIANT; text that is no JSON stays a string."""
    return df.withColumns({c: tolerant(F.col(c)) for c in JSON_COLUMNS if c in df.columns and dict(df.dtypes)[c] == "string"})
