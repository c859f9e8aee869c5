"""Periodic runs of words: repeated stretches are found and collapsed to their first period.

A run is a stretch of words that is longest possible with its smallest period ``q`` (words ``q`` apart are identical). The
suffix automaton of the text is grown word by word. Its suffix links form a tree, in which every node carries the end of its
latest occurrence; a link-cut tree keeps the paths to the root as segments of one such end each. Appending a word accesses
the path of the new prefix and recolours it. Each segment met on the way says: the longest factor of this segment ended at
``e`` before and ends at ``i`` now. Where ``i - e`` is at most its length, both occurrences meet and form a square, and the
factor's length plus ``i - e`` is the repetition's reach to the left. The last ``i`` at which a (start, period) shows up is
the end of the run.

Only stretches that can hold a run are given to the automaton. In a run of period ``q`` and length ``L`` every four-word
shingle that starts in the last ``L - q - 3`` places of it also starts ``q`` words earlier, so a run is a stretch of at least
``3 * q - 3`` (two, for ``q`` of one) shingles in a row whose previous occurrence is at most ``q`` away. Shingles are compared by hash,
so a collision can only add a stretch. The memory of a task grows with the longest such stretch.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidmill.llm.common import prepare, word_hashes

# A run is at least this long, and at least so many periods long. The stretches above rest on these two numbers.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUNS = "array<struct<start:long,length:long,period:long>>"

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Occurrences:
    """The suffix automaton of a growing word sequence, with the latest ends of its states on a link-cut tree.

    States are numbered from 1, the root; 0 is none. A segment of the link-cut tree is a splay tree whose keys are depths;
    all its states have one latest end, which stands at the splay tree's root.
    """

    def __init__(self, room: int) -> None:
        size = 2 * room + 3
        self.next: list[dict | None] = [None, {}]
        self.length, self.link = [0, 0], [0, 0]
        self.left, self.right, self.up, self.end = [0] * size, [0] * size, [0] * size, [-1] * size
        self.tip, self.at = 1, -1

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its segment's splay tree."""
        left, right, up = self.left, self.right, self.up
        p, top = up[x], 0
        while p:
            if left[p] == x:
                side = True
            elif right[p] == x:
                side = False
            else:
                break
            g = up[p]
            if g and left[g] == p:
                outer = 1
            elif g and right[g] == p:
                outer = 2
            else:
                outer = 0
            top = g if outer else p
            if not outer:  # one rotation
                if side:
                    c = right[x]
                    left[p], right[x] = c, p
                else:
                    c = left[x]
                    right[p], left[x] = c, p
                if c:
                    up[c] = p
                up[p], up[x] = x, g
                p = g
                continue
            above = up[g]
            if (outer == 1) == side:  # the same side twice
                if side:
                    b, c = right[p], right[x]
                    left[g], left[p], right[p], right[x] = b, c, g, p
                else:
                    b, c = left[p], left[x]
                    right[g], right[p], left[p], left[x] = b, c, g, p
                if b:
                    up[b] = g
                if c:
                    up[c] = p
                up[g], up[p] = p, x
            else:
                b, c = left[x], right[x]
                if side:  # p is right of g, x left of p
                    right[g], left[p], left[x], right[x] = b, c, g, p
                    if b:
                        up[b] = g
                    if c:
                        up[c] = p
                else:
                    right[p], left[g], left[x], right[x] = b, c, p, g
                    if b:
                        up[b] = p
                    if c:
                        up[c] = g
                up[g], up[p] = x, x
            up[x] = above
            if above:
                if left[above] == g:
                    left[above] = x
                elif right[above] == g:
                    right[above] = x
            p = above
        if top:
            self.end[x] = self.end[top]

    def append(self, word: int) -> Iterator[tuple[int, int]]:
        """Take the next word; gives ``(length, earlier end)`` of the segments on the new prefix's path, deepest first."""
        step, length, link = self.next, self.length, self.link
        p, new = self.tip, len(length)
        length.append(length[p] + 1)
        step.append({})
        link.append(0)
        while p and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if not p:
            parent = 1
        else:
            parent = step[p][word]
            if length[parent] != length[p] + 1:
                parent = self._split(parent, p, word)
        link[new] = parent
        self.up[new] = parent
        self.tip = new
        self.at += 1
        return self._access(new)

    def _split(self, q: int, p: int, word: int) -> int:
        """Part the shorter strings of ``q`` off as a state of their own, above ``q`` in the same segment."""
        step, length, link, left, up = self.next, self.length, self.link, self.left, self.up
        copy = len(length)
        length.append(length[p] + 1)
        step.append(dict(step[q]))
        link.append(link[q])
        self.splay(q)
        above = left[q]
        left[copy] = above
        if above:
            up[above] = copy
        left[q], up[copy], link[q] = copy, q, copy
        while p and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        return copy

    def _access(self, v: int) -> list[tuple[int, int]]:
        right, up, end, length = self.right, self.up, self.end, self.length
        below, u, before, met = 0, v, -1, []
        while u:
            self.splay(u)
            cut, e = right[u], end[u]
            if cut:
                end[cut] = e
            right[u] = below
            if e >= 0 and e != before and length[u]:
                met.append((length[u], e))
                before = e
            below, u = u, up[u]
        end[below] = self.at
        return met


def runs(words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of ``words`` that are ``least`` words and ``periods`` (two or more) periods long."""
    if periods < 4:
        raise ValueError("below four periods the smallest period isn't certain to show as a latest occurrence")
    names: dict = {}
    text = Occurrences(len(words))
    ends: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words):
        for length, e in text.append(names.setdefault(word, len(names))):
            period = i - e
            if length >= (periods - 1) * period:
                ends[i - length - period + 1, period] = i
    found = ((start, i - start + 1, period) for (start, period), i in ends.items())
    return sorted((s, n, q) for s, n, q in found if n >= least)


def stretches(hashes: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ``(start, stop)`` stretches of a word-hash sequence that hold every run of it (see the module's head)."""
    n = len(hashes)
    if n < LEAST_WORDS:
        return []
    with np.errstate(over="ignore"):
        shingles = sum(hashes[k : n - 3 + k] * _MULTIPLIERS[k] for k in range(4))
    order = np.argsort(shingles, kind="stable")
    same = np.flatnonzero(shingles[order[1:]] == shingles[order[:-1]])
    if not len(same):
        return []
    away = np.full(n - 3, n, dtype=np.int64)
    away[order[same + 1]] = order[same + 1] - order[same]
    marked = away < n
    for _ in range(4):  # further rounds would only narrow the stretches
        edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
        first, stop = edge[0::2], edge[1::2]
        size = stop - first
        # Of a run of period q there are q * 3 - 3 such shingles or more, and two at least.
        most = np.where(size < 2, 0, (size + 3) // 3)
        narrowed = marked.copy()
        narrowed[marked] = away[marked] <= np.repeat(most, size)
        if (narrowed == marked).all():
            break
        marked = narrowed
    else:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], marked.view(np.int8), [0]))))
        first, stop = edge[0::2], edge[1::2]
        most = (stop - first + 3) // 3
    out: list[tuple[int, int]] = []
    for a, b in zip(np.maximum(first - most - 1, 0).tolist(), np.minimum(stop + 4, n).tolist()):
        while out and a <= out[-1][1]:
            earlier = out.pop()
            a, b = min(a, earlier[0]), max(b, earlier[1])
        out.append((a, b))
    return out


def text_runs(data: bytes) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of a text and its words."""
    words = data.split()
    if len(words) < LEAST_WORDS:
        return [], words
    found = []
    for a, b in stretches(word_hashes(data)):
        found.extend((a + start, length, period) for start, length, period in runs(words[a:b]))
    return found, words


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if found:
        keep = np.ones(len(words), dtype=bool)
        for start, length, period in found:
            keep[start + period : start + length] = False
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def collapse(docs: DataFrame, text: str = "text", into: str = "repeats") -> DataFrame:
    """Adds the struct ``runs, collapsed``: every run of each whole text by start, then period, and the text without repeats.

    Words end at white space of ASCII. A null text counts as empty; texts without runs have an empty list, and their words
    joined by one space. Rows are worked on one by one: repeated rows, ids and other columns play no part, and a column named
    as ``into`` is replaced. An empty table gives no rows.
    """
    prepare(docs.sparkSession)

    @F.pandas_udf(f"runs {RUNS}, collapsed string")
    def found(texts: pd.Series) -> pd.DataFrame:
        all_runs, short = [], []
        for value in texts:
            hits, words = text_runs((value or "").encode())
            all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in hits])
            short.append(collapsed(words, hits).decode())
        return pd.DataFrame({"runs": all_runs, "collapsed": short})

    return docs.withColumn(into, found(F.col(text)))


def looped(doc_id: Column, text: Column) -> Column:
    """Test damage: every tenth text by crc32 of its id (none: the empty text) goes round in circles from some word on."""

    @F.pandas_udf("string")
    def damaged(ids: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for name, value in zip(ids, texts):
            h = zlib.crc32((name or "").encode())
            if h % 10 == 0 and value:
                words, g = value.encode().split(), h // 10
                if n := len(words):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    value = b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()
            out.append(value)
        return pd.Series(out, dtype=object)

    return damaged(doc_id.cast("string"), text)


def report(rows: DataFrame, into: str = "repeats") -> DataFrame:
    """``doc_id``, the number of runs, the one of the greatest exponent, and digests of all runs and of the short text."""
    found = F.col(f"{into}.runs")
    # Greatest length/period, compared crosswise; the list is by start and period, so the first of equals stays.
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(better(b, r), r).otherwise(b))
    lines = F.array_join(F.transform(found, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = rows.select("doc_id", F.size(found).cast("long").alias("n_runs"), best.alias("_best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(f"{into}.collapsed", 256).alias("collapsed_sha256"))
    return top.select("doc_id", "n_runs", "_best.*", F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
