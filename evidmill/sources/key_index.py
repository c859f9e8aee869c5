"""Which stable keys a stored table holds, told without reading the table.

Beside a table lies an index in ``BUCKETS`` hash buckets of the key: the keys themselves, and per bucket Bloom filters that say
of most new keys that they can't be stored. Only for keys of which a filter says *maybe* are the key files of their buckets
read, pruned by partition; the table itself never is. A filter that is full gets another one of twice its size beside it, so
filters are never built anew from the keys. After ``COMPACT`` batches the key files are merged.

A log of versions makes a batch whole: it begins a version, writes rows, keys and filters, and commits it. Where the last
version begun isn't the last committed, a batch was lost on the way; then, and where there is no index yet, it is built from the table.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidmill.session import scratch_path, ship_package

BUCKETS = 64
# Batches after which the key files of all buckets are merged.
COMPACT = 32
# Keys of the first filter of a bucket; bits for each key, and places set for it: about one in a hundred new keys is looked up.
FIRST_KEYS, BITS, PLACES = 4096, 10, 7

_LOG = "version long, state string, generation long"
_FILTERS = "bucket int, slice int, room long, held long, bits binary"


class Lookup(NamedTuple):
    """New rows, and what it took to tell them: keys that were looked up, and buckets whose key files were read."""

    fresh: DataFrame
    asked: int
    buckets: list[int]


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Bit places of key hashes in a filter of ``size`` bits, by double hashing."""
    first = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        step = ((first ^ (first >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        for k in range(PLACES):
            yield ((first + np.uint64(k) * step) >> np.uint64(1)) % np.uint64(size)


def _holds(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    words = np.frombuffer(bits, dtype=np.uint8)
    found = np.ones(len(hashes), dtype=bool)
    for at in _places(hashes, len(words) * 8):
        found &= (words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _added(bits: bytes, hashes: np.ndarray) -> bytes:
    words = np.frombuffer(bits, dtype=np.uint8).copy()
    for at in _places(hashes, len(words) * 8):
        np.bitwise_or.at(words, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return words.tobytes()


def _probe(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Keys of a bucket that one of its filters may hold."""
    hashes = keys["h"].to_numpy(dtype=np.int64)
    maybe = np.zeros(len(keys), dtype=bool)
    for bits in filters["bits"]:
        maybe |= _holds(bits, hashes)
    return keys[maybe]


def _grow(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """A bucket's filters with further keys: the last one is filled, then one of at least twice its size is added."""
    hashes = keys["h"].to_numpy(dtype=np.int64)
    rows = filters.sort_values("slice").to_dict("records")
    while len(hashes):
        if not rows or rows[-1]["held"] >= rows[-1]["room"]:
            room = max(FIRST_KEYS, 2 * rows[-1]["room"] if rows else 0, len(hashes))
            rows.append({"bucket": key[0], "slice": len(rows), "room": room, "held": 0, "bits": bytes(-(-room * BITS // 8))})
        now = rows[-1]
        part, hashes = hashes[: now["room"] - now["held"]], hashes[now["room"] - now["held"] :]
        now["bits"], now["held"] = _added(now["bits"], part), now["held"] + len(part)
    return pd.DataFrame(rows, columns=["bucket", "slice", "room", "held", "bits"])


class KeyIndex:
    """The index of one table below ``root``."""

    def __init__(self, spark: SparkSession, root: str, table: str) -> None:
        ship_package(spark)
        self.spark, self.table = spark, f"{root}/{table}"
        self.folder = f"{root}/_index/{table}"

    def _last(self) -> tuple[int, int, int]:
        """The version begun last, the one committed last and its generation of key files; zeros where there is no log."""
        try:
            rows = self.spark.read.schema(_LOG).json(f"{self.folder}/log")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, 0, 0
        done = F.col("state") == "commit"
        last = rows.agg(F.max("version").alias("begun"), F.max(F.when(done, F.col("version"))).alias("kept"), F.max_by("generation", F.when(done, F.col("version"))).alias("generation")).first()
        return last.begun or 0, last.kept or 0, last.generation or 0

    def _note(self, version: int, state: str, generation: int) -> None:
        self.spark.createDataFrame([(version, state, generation)], _LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")

    @staticmethod
    def _bucketed(df: DataFrame) -> DataFrame:
        hashed = F.xxhash64("stable_key")
        return df.select("stable_key", hashed.alias("h"), F.pmod(hashed, F.lit(BUCKETS)).cast("int").alias("bucket"))

    def _keys(self, generation: int) -> DataFrame:
        return self.spark.read.schema("stable_key string, h long, bucket int").parquet(f"{self.folder}/keys-{generation}")

    def _filters(self, version: int) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(f"{self.folder}/filters-{version}")

    def _extend(self, keys: DataFrame, old: DataFrame, version: int) -> None:
        grown = keys.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInPandas(_grow, _FILTERS)
        grown.write.parquet(f"{self.folder}/filters-{version}")

    def ready(self) -> tuple[int, int]:
        """Version and generation to work on; the index is built from the table where it is absent or a batch was lost."""
        begun, kept, generation = self._last()
        if kept and begun == kept:
            return kept, generation
        version, generation = begun + 1, max(generation, begun) + 1
        self._note(version, "begin", generation)
        stored = self._bucketed(self.spark.read.schema("stable_key string").parquet(self.table).distinct())
        stored.repartition(BUCKETS, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/keys-{generation}")
        # An empty table leaves no folder of keys to read.
        self._bucketed(self.spark.range(0).select(F.lit("").alias("stable_key"))).write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/keys-{generation}")
        none = self.spark.createDataFrame([], _FILTERS)
        self._extend(self._bucketed(self.spark.read.schema("stable_key string").parquet(self.table).distinct()), none, version)
        self._note(version, "commit", generation)
        return version, generation

    def lookup(self, rows: DataFrame, version: int, generation: int) -> Lookup:
        """Those of ``rows``, one per stable key, whose key isn't stored."""
        asked = self._bucketed(rows).groupBy("bucket").cogroup(self._filters(version).groupBy("bucket")).applyInPandas(_probe, "stable_key string, h long, bucket int")
        path = scratch_path(self.spark, "asked")
        asked.write.parquet(path)
        maybe = self.spark.read.schema("stable_key string, h long, bucket int").parquet(path)
        found = maybe.groupBy("bucket").count().collect()  # at most BUCKETS rows
        buckets = sorted(r["bucket"] for r in found)
        known = self._keys(generation).where(F.col("bucket").isin(buckets)).join(maybe.select("stable_key"), "stable_key", "left_semi")
        return Lookup(rows.join(known.select("stable_key"), "stable_key", "left_anti") if buckets else rows, sum(r["count"] for r in found), buckets)

    def append(self, fresh: DataFrame, version: int, generation: int) -> None:
        """Write new rows to the table and their keys to the index, as one version."""
        self._note(version + 1, "begin", generation)
        path = scratch_path(self.spark, "fresh")
        fresh.write.parquet(path)
        staged = self.spark.read.schema(fresh.schema).parquet(path)
        staged.write.mode("append").parquet(self.table)
        keys = self._bucketed(staged)
        after = generation
        if (version + 1) % COMPACT == 0:
            after = max(version + 1, generation + 1)
            self._keys(generation).repartition(BUCKETS, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/keys-{after}")
        keys.repartition("bucket").write.partitionBy("bucket").mode("append").parquet(f"{self.folder}/keys-{after}")
        self._extend(keys, self._filters(version), version + 1)
        self._note(version + 1, "commit", after)
