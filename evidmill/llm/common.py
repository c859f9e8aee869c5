"""What the operators of this subpackage share: table access, shipping, bounded broadcasts, components of links."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidmill.session import scratch_path, settle, ship_package

# White space of the contracts: blank and U+0009 to U+000D. ``bytes.split()`` splits at exactly these.
SPACE = r"[\x20\x09-\x0D]"

# Rows of a side that may be broadcast: its rows are a few longs wide, so at most some tens of MB.
BROADCAST_ROWS = 1_000_000

# Rows of an Arrow batch. Texts can be long, so batches are kept shorter than Spark's default.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps start from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matching(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` occurs in ``ids``: broadcast up to ``BROADCAST_ROWS``, a shuffle join beyond."""
    ids = ids.select(key)
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; an absent id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def remainder_column(doc_id: str, modulus: int) -> Column:
    """The same on the JVM."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def word_hashes(data: bytes) -> np.ndarray:
    """One 64-bit hash per word of lower-cased bytes; words end at white space. Vectorised over the bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        # Position-dependent terms of a polynomial hash; a word's sum is made independent of its place by its inverse power.
        terms = _SCRAMBLE[raw] * _powers(len(raw))[: len(raw)]
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return mix((total[ends] - total[starts]) * _inverse_powers(len(raw))[starts] + (ends - starts).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_SCRAMBLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            steps = np.full(max(n, 4096) * 5 // 4, base, dtype=np.uint64)
            steps[0] = 1
            have = np.cumprod(steps, dtype=np.uint64)
        _POWERS[base] = have
    return have


def _powers(n: int) -> np.ndarray:
    return _table(_BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table(pow(_BASE, -1, 2**64), n)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for links ``(a, b)``: the smallest node that each can reach.

    Alternating large-star and small-star steps on the link table. A node with very many links is an aggregate and a
    join, never a list; every round is settled, and the loop ends when a round changes nothing.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).distinct()
        after = settle(small)
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            break
        edges = after
    nodes = after.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
