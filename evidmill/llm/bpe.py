"""Byte-level BPE with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. For every merge rank a bucket holds the places whose pair has that rank, and a
three-level bitmap of 64-bit words tells which buckets hold something: find-first-set from the top gives the lowest rank in
three steps, however many ranks or places there are. Merges leave stale entries behind, which are skipped when they come up.
A pre-token of n bytes takes about 3n queue operations, so one of a megabyte costs no more per byte than a word.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from heapq import heappop, heappush
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidmill.llm.common import prepare

# Pre-tokens that a worker remembers twice over: when so many new ones have come, those not used since are let go. Memory is
# bounded (about 300 MB), results don't depend on it.
REMEMBERED = 600_000


class RankQueue:
    """Places by rank, lowest rank first and leftmost place first. Empty again when its user has drained it."""

    def __init__(self, ranks: int):
        self.leaves = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        leaf, middle = rank >> 6, rank >> 12
        self.leaves[leaf] |= 1 << (rank & 63)
        self.middle[middle] |= 1 << (leaf & 63)
        self.top |= 1 << middle

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        middle = (self.top & -self.top).bit_length() - 1
        word = self.middle[middle]
        leaf = (middle << 6) | ((word & -word).bit_length() - 1)
        word = self.leaves[leaf]
        rank = (leaf << 6) | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        place = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.leaves[leaf] &= self.leaves[leaf] - 1
            if not self.leaves[leaf]:
                self.middle[middle] &= self.middle[middle] - 1
                if not self.middle[middle]:
                    self.top &= self.top - 1
        return rank, place


class Codec:
    """Encoder and decoder of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.key = (zlib.crc32(ranks), pattern)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        self.longest = max(map(len, self.ranks))
        highest = max(self.ranks.values())
        self.tokens = [b""] * (highest + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.decimal = list(map(str, range(highest + 1)))
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(highest + 1)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, get, longest, queue = len(piece), self.ranks.get, self.longest, self.queue
        after, before = list(range(1, n + 1)), list(range(-1, n))  # places of the next and the last part; n ends the list
        pair = [-1] * (n + 1)  # rank of the pair that begins at a place; -1: none, or no part begins there
        for i in range(n - 1):
            rank = get(piece[i : i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue  # stale
            gone = after[i]
            right = after[i] = after[gone]
            before[right] = i
            pair[gone] = -1
            new = -1
            if right < n and (end := after[right]) - i <= longest:
                new = get(piece[i:end], -1)
                if new >= 0:
                    queue.push(new, i)
            pair[i] = new
            left = before[i]
            if left >= 0:
                new = get(piece[left:right], -1) if right - left <= longest else -1
                if new >= 0 and new != pair[left]:
                    queue.push(new, left)
                pair[left] = new
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(self.ranks[piece[i:end]])
            i = end
        return tuple(ids)

    def __missing(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word) or self.merge(word.encode())
        if len(word) <= 64:  # long ones seldom come again
            if len(self.known) >= REMEMBERED:
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern encoded by itself."""
        missing = self.__missing
        return list(chain.from_iterable([self.known.get(w) or missing(w) for w in self.split(text)]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def joined(self, ids) -> str:
        return ",".join(map(self.decimal.__getitem__, ids))


_CODECS: dict = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """The codec of a rank file, kept by the worker between tasks."""
    key = (zlib.crc32(ranks), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row: ids as decimals joined by commas, and the decoded bytes.

    Null text is empty and has no ids. Rows are independent: repeated rows and absent ids give a row each. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())  # the vocabulary: about 1 MB

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def measure(texts: pd.Series) -> pd.DataFrame:
        own, rows = codec(sent.value, pattern), []
        for text in texts:
            ids = own.encode(text) if text else []
            rows.append((len(ids), hashlib.sha256(own.joined(ids).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", measure("text").alias("_m")).select("doc_id", "_m.*")


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array column of ids."""
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(sent.value, pattern)
        return pd.Series([own.encode(t) if t else [] for t in texts], dtype=object)

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with a binary column of the bytes of ``ids``; null ids are no bytes."""
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("binary")
    def data(rows: pd.Series) -> pd.Series:
        own = codec(sent.value, pattern)
        return pd.Series([b"" if r is None else own.decode(r) for r in rows], dtype=object)

    return docs.withColumn(into, data(F.col(ids)))
