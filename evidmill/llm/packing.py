"""Packing token sequences: each piece goes where the squared counts of open sequences per residual gap become smallest."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from evidmill.llm.common import prepare

CAPACITY = 1024
END_ID = 2

# Documents that are packed together: one task of a second or two. More documents make more shards, not larger ones.
SHARD_DOCS = 65_536

_RUN = 4096  # copies of a piece that are numbered at a time
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict = {}


def byte_encoder(ranks: bytes, pattern: str, added: dict[str, int]):
    """Text to ids by a rank file and ``added`` tokens, which are whole wherever they stand; kept by the worker between tasks."""
    import tiktoken

    key = (zlib.crc32(ranks), pattern, tuple(sorted(added.items())))
    if key not in _ENCODERS:
        merge = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merge, special_tokens=added)
    encoder = _ENCODERS[key]

    def encode(text: str) -> list[int]:
        return encoder.encode(text, allowed_special="all") if any(token in text for token in added) else encoder.encode_ordinary(text)

    return encode


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Added tokens of a vocabulary in JSON form, such as an end of text, with their ids. Those that also take blanks beside them are an error."""
    import json

    with open(vocabulary, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
        raise ValueError(f"added tokens of {vocabulary} do not stand for their own text")
    return {t["content"]: int(t["id"]) for t in added}


def ranks_of(vocabulary: str) -> bytes:
    """The rank file of a byte-level BPE vocabulary in JSON form: byte strings with their ids, which are the ranks."""
    import json

    added = added_tokens(vocabulary)
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # Printable stand-ins of bytes: visible Latin-1 characters stand for themselves, the others follow from U+0100 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(b): b for b in plain}
    stands.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    lines = []
    for token, rank in model["vocab"].items():
        if token not in added and all(c in stands for c in token):
            lines.append((rank, base64.b64encode(bytes(stands[c] for c in token))))
    return b"\n".join(token + b" " + str(rank).encode() for rank, token in sorted(lines))


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document: its ids and then ``end_id``.

    Only longer documents are cut. The first piece takes the remainder and may be shorter, all others are full. Null text
    is empty: one piece, the end id alone. Strings of the vocabulary's added tokens get their ids.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(ranks_of(vocabulary))  # the vocabulary: about 1 MB
    added = added_tokens(vocabulary)

    def cut(batches):
        encode = byte_encoder(ranks.value, pattern, added)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text) if text else []
                ids.append(end_id)
                data, n = memoryview(np.asarray(ids, dtype="<u4")).cast("B"), len(ids)
                at, size, piece = 0, n % capacity or capacity, 0
                while at < n:
                    rows.append((doc_id, piece, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                    at, size, piece = at + size, capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, _PIECE)


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the given order.

    ``open_at[g]`` counts open sequences with gap ``g``. Moving one from gap ``g`` to ``g - s`` changes the sum of squares
    by ``2 (open_at[g-s] - open_at[g]) + 2``; closing one has no first term. A new sequence is opened only where no open one
    has room: on lengths in falling order that gives fewer sequences than letting a new one compete in the sum.
    """
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    open_at, bins = np.zeros(capacity + 1, dtype=np.int64), defaultdict(list)
    made = 0
    for k, s in enumerate(lengths.tolist()):
        if s == capacity:
            sequence[k], offset[k], made = made, 0, made + 1
            continue
        there = open_at[s:capacity]  # by gap, from s on
        usable = np.flatnonzero(there)
        if len(usable):
            gain = 2 * (open_at[usable] - there[usable]) + 2  # open_at[0] is 0: closed sequences aren't counted
            gain[0] -= usable[0] == 0
            gap = int(usable[np.argmin(gain)]) + s  # ties: the smallest gap
            which = bins[gap].pop()
            open_at[gap] -= 1
        else:
            gap, which, made = capacity, made, made + 1
        sequence[k], offset[k] = which, capacity - gap
        if gap > s:
            bins[gap - s].append(which)
            open_at[gap - s] += 1
    return sequence, offset


def pack(cut: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for pieces; ``shards`` independent packings, dealt by a hash of the piece.

    Equal pieces are counted and numbered before they are dealt, so rows that share an id, have none or are the same in all
    still go to all shards.

    Pieces of a shard are placed longest first, ties by document and piece, so a repeated task gives the same places.
    """
    prepare(cut.sparkSession)

    def fill(key, rows):
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        sequence, offset = place(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="_shard").assign(sequence_id=(np.int64(key[0]) << 40) + sequence, offset=offset)

    own = cut.columns
    runs = cut.groupBy(*own).agg(F.count("*").alias("_n")).withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {_RUN})")))
    each = runs.withColumn("_copy", F.explode(F.expr(f"sequence(_run * {_RUN}, least(_n, (_run + 1) * {_RUN}) - 1)")))
    # An absent id is hashed as a value of its own: xxhash64 passes over nulls.
    place_of = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *(c for c in own if c != "doc_id"), "_copy")
    dealt = each.select(*own, F.pmod(place_of, F.lit(shards)).alias("_shard"))
    return dealt.groupBy("_shard").applyInPandas(fill, f"{_PIECE}, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Cut and pack all ``docs``. An empty table gives no rows; columns besides ``doc_id`` and ``text`` are ignored."""
    shards = max(1, -(-docs.count() // shard_docs))
    return pack(pieces(docs, vocabulary, pattern, capacity, end_id), shards, capacity)
