"""An n-gram model in a log-frequency Bloom filter.

The filter holds quantised counts: an n-gram of level ``q`` is entered as ``(n-gram, 1) ... (n-gram, q)``, and a count is read
by probing level after level until one is missing. Every n-gram that occurs ``LEAST`` times is entered, at every size of the
corpus, so the filter grows with it. It is therefore split by hash of the n-gram into shards of at most about ``SHARD_GRAMS``
counted n-grams, and a shard is only ever in the memory of the task that builds or reads it: texts are cut into blocks where
they are read and written once as token numbers, the distinct n-grams and tokens of a block are sent to their shards, and the
levels and exact counts read there come back to the block. Shards are asked in ``ROUNDS`` ranges, one after the other, so that
only a part of the asked n-grams is on disk at a time. Arrays of n-grams travel as binary values, not as a row each: their names
are sorted, and the differences are compressed. The shuffle files of each step are given up when its result is written.

The probability of a token after a history ``h`` that the filter holds is
``D q(h w) / C(h) + (1 - D T(h) / C(h)) P'(w)`` with the counts ``q`` read from the filter, ``C`` the history's count, ``T``
the sum of ``q`` over the followers of ``h`` (also in the filter, rounded up, so that probabilities never sum to more than one) and
``P'`` the model with a history shorter by a token; after other histories it is ``P'``. The lowest model adds one to the exact counts. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidmill.llm.common import mix, prepare, word_hashes, written

ORDER = 3
LEAST = 2
BASE = 1.3
SUM_BASE = 1.1
DISCOUNT = 0.9
BITS_PER_ENTRY = 12
PROBES = 8

# Tokens that are looked up in the filter at a time.
CHUNK_TOKENS = 400_000

# Text bytes of the documents that one task scores together with the counts they ask for.
BLOCK_BYTES = 12 << 20

# Occurrences of n-grams that a shard of the filter gets on average, and tokens of which a task collapses repeats before it sends them.
SHARD_GRAMS = 2_000_000
TALLY_TOKENS = 2_000_000

# Bytes of texts whose words are hashed in one go, and of blocks that a worker is handed at once.
RUN_BYTES = 1 << 18
HANDED_BYTES = 8 << 20

# Ranges of shards that are asked one after the other.
ROUNDS = 2

_END = np.uint64(0x51ED270B7A1C3A65)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_FOLLOWERS = np.uint64(0xA24BAED4963EE407)
_LOW = np.uint64(0xFFFFFFFF)

# Sums over followers travel in steps of one part.
_PARTS = 64.0

# Stands between texts whose words are hashed together: a byte that UTF-8 doesn't have.
_MARK = b" \xff "

# Bits of an entry in its shard.
ENTRY_BITS = np.uint64(40)

# Bits of an n-gram's name that tell the followers of one history apart in a shard; the others are the history's.
NAME_BITS = np.uint64(20)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words of a text and of one end."""
    return np.append(word_hashes((text or "").encode().lower()), _END)


def tokens_of_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``tokens`` of lower-cased texts, one after the other, and how many each has."""
    words = word_hashes(b"".join(part for text in texts for part in (text, _MARK)))
    ends = np.flatnonzero(words == word_hashes(_MARK)[0])
    words[ends] = _END
    return words, np.diff(ends, prepend=-1)


def token_runs(texts):
    """``tokens_of_all`` of about ``RUN_BYTES`` at a time."""
    run, size = [], 0
    for text in texts:
        run.append((text or "").encode().lower())
        size += len(run[-1]) + len(_MARK)
        if size >= RUN_BYTES:
            yield tokens_of_all(run)
            run, size = [], 0
    if run:
        yield tokens_of_all(run)


def extended(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their beginnings and their last words."""
    with np.errstate(over="ignore"):
        return mix(grams * _STEP + words)


class LogFrequencyFilter:
    """A Bloom filter of ``(key, level)`` entries for levels from 1 to a key's own."""

    def __init__(self, entries: int):
        self.size = np.uint64(max(64, entries * BITS_PER_ENTRY) | 1)
        self.words = np.zeros(int(self.size) // 8 + 1, dtype=np.uint8)

    @classmethod
    def of(cls, size: int, words: bytes) -> LogFrequencyFilter:
        """A filter from its stored parts."""
        out = cls.__new__(cls)
        out.size, out.words = np.uint64(size), np.frombuffer(words, dtype=np.uint8)
        return out

    def _places(self, keys: np.ndarray, level: int):
        """Places of the probes of one hash, the second half added to the first once a probe, scaled to the size.

        Takes, with each place, which of the keys go on to the next.
        """
        with np.errstate(over="ignore"):
            hashed = mix(keys ^ (np.uint64(level) * _STEP))
            now, step = (hashed >> np.uint64(32)).astype(np.uint32), hashed.astype(np.uint32) | np.uint32(1)
            for _ in range(PROBES):
                stay = yield ((now.astype(np.uint64) * self.size) >> np.uint64(32)).view(np.int64)
                if stay is not None:
                    now, step = now[stay], step[stay]
                now = now + step

    def add(self, keys: np.ndarray, levels: np.ndarray) -> None:
        bits = np.unpackbits(self.words, bitorder="little")
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            for at in self._places(keys, level):
                bits[at] = 1
        self.words = np.packbits(bits, bitorder="little")

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Repeated membership probes: the level before the first that is missing."""
        out, alive, level = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 1
        while len(alive):
            probes, stay = self._places(keys, level), None
            for _ in range(PROBES):
                at = probes.send(stay)
                there = np.flatnonzero((self.words[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1))
                stay = None
                if len(there) < len(alive):
                    stay, alive, keys = there, alive[there], keys[there]
            out[alive] = level
            level += 1
        return out


class Reader:
    """Counts from levels; ``own`` gives those of n-grams with their histories, ``sums`` those of the sums over followers."""

    least: int

    def counts(self, histories: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Counts read from the filter: the middle of the level, 0 where there is none."""
        level = self.own(histories, grams)
        return np.where(level > 0, self.least * BASE ** (level - 0.5), 0.0)

    def followers(self, histories: np.ndarray) -> np.ndarray:
        """Sums over followers: the upper end of the level."""
        level = self.sums(histories)
        return np.where(level > 0, self.least * SUM_BASE ** level.astype(float), 0.0)


@dataclass
class Model:
    """``least`` is the count that level 1 begins at; ``train_tokens`` and ``vocabulary`` are the base's N and V.

    ``table``: ``shard, size, words``, the filter's shards, which scoring joins.
    """

    table: DataFrame
    shards: int
    least: int
    train_tokens: int
    vocabulary: int
    order: int = ORDER


@dataclass
class Answers(Reader):
    """What the shards answered to a block: its asked entries and histories in order, with their levels."""

    entries: np.ndarray
    entry_levels: np.ndarray
    heads: np.ndarray
    head_levels: np.ndarray
    shards: int
    least: int
    train_tokens: int
    vocabulary: int
    order: int

    def own(self, histories: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return found(self.entries, self.entry_levels, located(histories, grams, self.shards))

    def sums(self, histories: np.ndarray) -> np.ndarray:
        return found(self.heads, self.head_levels, histories >> NAME_BITS)


def found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of ``asked``, all of which occur in the sorted ``keys``; looked up in rising order, which stays in the cache."""
    rising = np.argsort(asked)
    out = np.empty(len(asked), dtype=np.int64)
    out[rising] = values[np.searchsorted(keys, asked[rising])]
    return out


def named(histories: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Names of n-grams inside their shard: the history's high bits, then low bits of the n-gram's own key.

    Shards are dealt by the high bits of the key, so the followers of a common history lie in all shards, and 20 bits tell
    those in one shard apart about as well as the filter does.
    """
    return ((histories >> NAME_BITS) << NAME_BITS) | (grams & ((np.uint64(1) << NAME_BITS) - np.uint64(1)))


def entry(names: np.ndarray) -> np.ndarray:
    """What an n-gram is entered and asked by in its shard: 40 bits, which two of a shard's share less often than the filter errs."""
    return mix(names) >> (np.uint64(64) - ENTRY_BITS)


def located(histories: np.ndarray, grams: np.ndarray, shards: int) -> np.ndarray:
    """Entries of n-grams after the numbers of their shards: one order for all."""
    return (shard_of(grams, shards) << ENTRY_BITS) | entry(named(histories, grams))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the keys, which are hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def dealt(keys: np.ndarray, shards: int):
    """Shards that hold some of ``keys``, each with the places of its keys."""
    if not len(keys):
        return
    if shards == 1:
        yield 0, np.arange(len(keys))
        return
    shard = shard_of(keys, shards)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    shard = shard[order]
    starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for at, upto in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(shard[at]), order[at:upto]


def packed(values: np.ndarray, width: int) -> bytes:
    """Numbers below ``256 ** width``, byte by byte of their weight and compressed."""
    import zstandard

    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpacked(data: bytes, width: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def packed_sorted(values: np.ndarray) -> bytes:
    """Rising numbers, as their differences, after the width of these."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + packed(steps, width)


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data[1:], data[0]), dtype=np.uint64)


def level_of(count, least: int, base: float = BASE):
    return np.floor(np.log(np.maximum(count, least) / least) / math.log(base) + 1e-9).astype(np.int64) + 1


def token_counts(train: DataFrame) -> DataFrame:
    """``token, c``: exact counts of all tokens of ``train``; repeated tokens of a batch collapse before the shuffle."""

    def tally(batches):
        for batch in batches:
            keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *(words for words, _ in token_runs(batch["text"]))]), return_counts=True)
            yield pd.DataFrame({"token": keys.view(np.int64), "c": n})

    return train.select("text").mapInPandas(tally, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def text_grams(texts: list[np.ndarray], order: int):
    """Per order from 2 on, keys of the n-grams of token arrays and keys of their histories; none crosses texts."""
    yield from run_grams(np.concatenate(texts) if texts else np.empty(0, np.uint64), np.array([len(t) for t in texts], dtype=np.int64), order)


def run_grams(words: np.ndarray, sizes: np.ndarray, order: int):
    """The same of texts one after the other and how many tokens each has."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))  # tokens from here to the text's end
    grams = words
    for n in range(2, order + 1):
        if len(words) < n:
            return
        histories = grams[:-1]
        grams = extended(histories, words[n - 1 :])
        inside = left[: len(grams)] >= n
        yield grams[inside], histories[inside]


def gram_pieces(train: DataFrame, order: int, shards: int) -> DataFrame:
    """``shard, names, counts``: n-grams of stretches of ``train``, each once a stretch with its count there."""

    def pieces(runs):
        if not runs:
            return
        words, sizes = (np.concatenate(x) for x in zip(*runs))
        both = [(grams, named(histories, grams)) for grams, histories in run_grams(words, sizes, order)]
        if not both:
            return
        grams, names = (np.concatenate(x) for x in zip(*both))
        del both, words
        for shard, at in dealt(grams, shards):
            own, n = np.unique(names[at], return_counts=True)
            yield pd.DataFrame({"shard": [shard], "names": [packed_sorted(own)], "counts": [packed(n, 4)]})

    def tally(batches):
        runs, size = [], 0
        for batch in batches:
            for words, sizes in token_runs(batch["text"]):
                runs.append((words, sizes))
                size += len(words)
                if size >= TALLY_TOKENS:
                    yield from pieces(runs)
                    runs, size = [], 0
        yield from pieces(runs)

    return train.select("text").mapInPandas(tally, "shard long, names binary, counts binary")


def collapsed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights. Runs of rising keys, one after the other, are merged."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def together(parts, read) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(read(x) for x in parts)])


def filter_shards(train: DataFrame, order: int, shards: int, least: int) -> DataFrame:
    """``shard, size, words``: the filter of n-grams with a count of ``least`` and of the sums over the followers of their histories.

    The first grouping counts. A history's followers lie in many shards, so their sums go to the history's own shard; they
    travel in steps of a ``_PARTS``-th, rounded up.
    """

    def count(key, rows):
        names, c = collapsed(together(rows["names"], unpacked_sorted), together(rows["counts"], lambda x: unpacked(x, 4)).astype(np.int64))
        kept = c >= least
        names, levels = names[kept], level_of(c[kept], least)
        histories, q = collapsed(names >> NAME_BITS, least * BASE ** (levels - 0.5))
        entries = entry(names)
        rising = np.argsort(entries)
        yield pd.DataFrame({"shard": [key[0]], "sums": [False], "keys": [packed_sorted(entries[rising])], "weights": [packed(levels[rising], 1)]})
        for shard, at in dealt(histories << NAME_BITS, shards):
            yield pd.DataFrame({"shard": [shard], "sums": [True], "keys": [packed_sorted(histories[at])], "weights": [packed(np.ceil(q[at] * _PARTS), 6)]})

    def build(key, rows):
        own, sums = rows[~rows["sums"]], rows[rows["sums"]]
        histories, q = collapsed(together(sums["keys"], unpacked_sorted), together(sums["weights"], lambda x: unpacked(x, 6)) / _PARTS)
        entered = [(together(own["keys"], unpacked_sorted), together(own["weights"], lambda x: unpacked(x, 1)).astype(np.int64)),
                   (histories ^ _FOLLOWERS, level_of(q, least, SUM_BASE))]
        made = LogFrequencyFilter(int(sum(levels.sum() for _, levels in entered)))
        for keys, levels in entered:
            made.add(keys, levels)
        return pd.DataFrame({"shard": [key[0]], "size": [int(made.size)], "words": [made.words.tobytes()]})

    def counted(key, rows):
        return pd.concat(count(key, rows))

    kept = gram_pieces(train, order, shards).groupBy("shard").applyInPandas(counted, "shard long, sums boolean, keys binary, weights binary")
    return kept.groupBy("shard").applyInPandas(build, "shard long, size long, words binary")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting that holds inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def freed(df: DataFrame, name: str) -> DataFrame:
    """``written``, after which Spark removes the shuffle files of the step: the result doesn't need them any more."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return written(df, name)


def fit(train: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """The model, and the exact token counts as a table. Null texts are empty: an end alone."""
    prepare(train.sparkSession)
    exact = freed(token_counts(train), "lm-tokens")
    total = exact.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    shards = max(1, -(-int(total.n) * (order - 1) // SHARD_GRAMS))
    table = freed(filter_shards(train, order, shards, LEAST), "lm-filter")
    return Model(table, shards, LEAST, int(total.n), int(total.v), order), exact


def log_probabilities(words: np.ndarray, c: np.ndarray, ends: np.ndarray, model: Answers) -> np.ndarray:
    """Per token, log10 of its probability after the tokens before it in its text.

    ``c``: exact counts of the tokens; ``ends``: the places after each text's last token.
    """
    p = (c + 1) / (model.train_tokens + model.vocabulary + 1)
    grams, history_count = words, c.astype(float)
    place = np.arange(len(words)) - np.repeat(np.concatenate(([0], ends[:-1])), np.diff(np.concatenate(([0], ends))))
    for n in range(2, model.order + 1):
        if len(words) < n:
            break
        # Places n-1 and on; histories are the grams of the order below that end one token earlier, in the same text.
        past, past_count = grams[:-1], history_count[:-1]
        grams = extended(past, words[n - 1 :])
        held_back = np.zeros(len(past))
        likely = (past_count >= model.least) & (place[n - 1 :] >= n - 1)
        held_back[likely] = model.followers(past[likely])
        seen = held_back > 0
        counts = np.zeros(len(grams))
        counts[seen] = model.counts(past[seen], grams[seen])
        whole = np.maximum(past_count[seen], held_back[seen])  # read counts are rounded: a part is never more than the whole
        tail = p[n - 1 :]
        tail[seen] = DISCOUNT * np.minimum(counts[seen], held_back[seen]) / whole + (1 - DISCOUNT * held_back[seen] / whole) * tail[seen]
        history_count = counts
    return np.log10(p)


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The values of ``parts`` in order, each once."""
    keys = np.concatenate([np.empty(0, np.uint64), *parts])
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """``_block, ids, sizes, vocabulary, places``: the texts of ``docs`` in the order they are read, cut into blocks.

    A block has the distinct tokens of its texts in order, the number there of every token, and how many each text has.
    Blocks end where the rows do: rows that share an id or have none, and copies, are like any others.
    """

    def cut(batches):
        first, n = TaskContext.get().partitionId() << 33, 0
        ids, runs, size = [], [], 0

        def block():
            words, sizes = (np.concatenate(x) for x in zip(*runs))
            own, places = np.unique(words, return_inverse=True)
            return pd.DataFrame({"_block": [first + n], "ids": [ids], "sizes": [packed(sizes, 5)], "vocabulary": [packed_sorted(own)], "places": [packed(places, 5)]})

        for batch in batches:
            at = 0
            keys = batch["doc_id"].tolist()
            for words, sizes in token_runs(batch["text"]):
                ids += keys[at : at + len(sizes)]
                size += sum(batch["_bytes"].iloc[at : at + len(sizes)].tolist())
                at += len(sizes)
                runs.append((words, sizes))
                if size >= block_bytes:
                    yield block()
                    ids, runs, size, n = [], [], 0, n + 1
        if runs:
            yield block()

    # Ids as text: longs with nulls would reach the workers as floats.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("_bytes"))
    return rows.mapInPandas(cut, "_block long, ids array<string>, sizes binary, vocabulary binary, places binary")


def block_asks(words: np.ndarray, sizes: np.ndarray, order: int, shards: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block asks the shards from ``low`` to below ``high``: n-grams as ``located``, and histories, distinct and in order."""
    entries, heads = [], []
    for grams, histories in run_grams(words, sizes, order):
        shard = shard_of(grams, shards)
        asked = (shard >= low) & (shard < high)
        entries.append(located(histories[asked], grams[asked], shards))
        own = distinct([histories >> NAME_BITS])
        shard = shard_of(own << NAME_BITS, shards)
        heads.append(own[(shard >= low) & (shard < high)])
    return distinct(entries), distinct(heads)


def score(docs: DataFrame, model: Model, exact: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    Texts are cut into blocks of about ``BLOCK_BYTES``; the distinct tokens of a block fetch their exact counts, its distinct
    n-grams their levels, and both meet its texts. Null and empty texts have the end as their only token. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    shards, order, least, train_tokens, vocabulary = model.shards, model.order, model.least, model.train_tokens, model.vocabulary
    blocks = freed(text_blocks(docs, BLOCK_BYTES), "lm-blocks")
    # A shard is asked by all blocks; it is laid beside parts of them where there is more to score than was learned from.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = min(max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // max(1, train_tokens * 8))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("_slice")
    token_shard = F.shiftright(F.shiftrightunsigned("token", 32) * F.lit(shards).cast("long"), 32)
    singles = exact.groupBy(token_shard.alias("shard")).agg(F.collect_list("token").alias("tokens"), F.collect_list("c").alias("c"))
    none, zero = F.lit(None), F.lit(0).cast("long")
    sides = model.table.select("shard", "size", "words", none.cast("array<bigint>").alias("tokens"), none.cast("array<bigint>").alias("c")).unionByName(
        singles.select("shard", zero.alias("size"), none.cast("binary").alias("words"), "tokens", "c")).select("*", every)

    def asking(low, high):
        def ask(batches):
            for batch in batches:
                for block, sizes, own, places in zip(batch["_block"], batch["sizes"], batch["vocabulary"], batch["places"]):
                    own = unpacked_sorted(own)
                    entries, heads = block_asks(own[unpacked(places, 5).astype(np.int64)], unpacked(sizes, 5).astype(np.int64), order, shards, low, high)
                    bounds = np.arange(low, high + 1, dtype=np.uint64)
                    cuts = [np.searchsorted(x, bounds).tolist() for x in (entries >> ENTRY_BITS, shard_of(heads << NAME_BITS, shards), shard_of(own, shards))]
                    entries &= (np.uint64(1) << ENTRY_BITS) - np.uint64(1)
                    rows = []
                    for k in range(high - low):
                        parts = [x[at[k] : at[k + 1]] for x, at in zip((entries, heads, own), cuts)]
                        if any(map(len, parts)):
                            rows.append((low + k, block % slices, block, *map(packed_sorted, parts)))
                    if rows:
                        yield pd.DataFrame(rows, columns=["shard", "_slice", "_block", "names", "heads", "tokens"])

        return ask

    def answer(key, rows, sides):
        filters, single = sides[sides["words"].notna()], sides[sides["tokens"].notna()]
        read = LogFrequencyFilter.of(filters["size"].iloc[0], filters["words"].iloc[0]) if len(filters) else None
        keys, c = np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(single):
            keys, c = np.asarray(single["tokens"].iloc[0], dtype=np.int64).view(np.uint64), np.asarray(single["c"].iloc[0], dtype=np.int64)
            rising = np.argsort(keys)
            keys, c = keys[rising], c[rising]
        # What several blocks ask is read once.
        names, heads = distinct(list(map(unpacked_sorted, rows["names"]))), distinct(list(map(unpacked_sorted, rows["heads"])))
        own, sums = (read.levels(x).astype(np.uint16) if read else np.zeros(len(x), dtype=np.uint16) for x in (names, heads ^ _FOLLOWERS))
        out = []
        for block, *asked in zip(rows["_block"], rows["names"], rows["heads"], rows["tokens"]):
            own_asked, heads_asked, words = map(unpacked_sorted, asked)
            counts = np.zeros(len(words), dtype=np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                counts = np.where(keys[at] == words, c[at], 0)
            out.append((block, key[0], packed(own[np.searchsorted(names, own_asked)], 1), packed(sums[np.searchsorted(heads, heads_asked)], 2), packed(counts, 8)))
        return pd.DataFrame(out, columns=["_block", "shard", "own", "sums", "counts"])

    known = None
    rounds = min(ROUNDS, shards)
    for k in range(rounds):
        low, high = shards * k // rounds, shards * (k + 1) // rounds
        asks = blocks.select("_block", "sizes", "vocabulary", "places").mapInPandas(
            asking(low, high), "shard long, _slice long, _block long, names binary, heads binary, tokens binary")
        beside = sides.where((F.col("shard") >= low) & (F.col("shard") < high)).groupBy("shard", "_slice")
        part = asks.groupBy("shard", "_slice").cogroup(beside).applyInPandas(answer, "_block long, shard long, own binary, sums binary, counts binary")
        with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(HANDED_BYTES)):
            part = freed(part, "lm-levels")
        known = part if known is None else known.unionByName(part)

    def measure(key, blocks, known):
        known = known.sort_values("shard")
        rows, at = [], 0
        for ids, sizes, own, places in zip(blocks["ids"], blocks["sizes"], blocks["vocabulary"], blocks["places"]):
            sizes, places = unpacked(sizes, 5).astype(np.int64), unpacked(places, 5).astype(np.int64)
            words = unpacked_sorted(own)[places]
            # Shards are equal ranges of the keys: what they answered, one after the other, is in the order of what they were asked.
            c = together(known["counts"], lambda x: unpacked(x, 8)).astype(np.int64)[places]
            del places
            levels = [np.concatenate([unpacked(x, width).astype(kind) for x in known[name]]) for name, width, kind in (("own", 1, np.uint8), ("sums", 2, np.uint16))]
            entries, heads = block_asks(words, sizes, order, shards, 0, shards)
            lm = Answers(entries, levels[0], heads, levels[1], shards, least, train_tokens, vocabulary, order)
            ends = np.cumsum(sizes)
            cut = 0
            while cut < len(ids):
                upto = max(cut + 1, int(np.searchsorted(ends, at + CHUNK_TOKENS, side="right")))
                some, some_c, stops = words[at : ends[upto - 1]], c[at : ends[upto - 1]], ends[cut:upto] - at
                base = np.log10((some_c + 1) / (train_tokens + vocabulary + 1))
                own_scores = log_probabilities(some, some_c, stops, lm)
                starts = np.concatenate(([0], stops[:-1]))
                rows.append(pd.DataFrame({"doc_id": list(ids[cut:upto]), "n_tokens": stops - starts, "n_known": np.add.reduceat((some_c > 0).astype(np.int64), starts),
                                          "train_tokens": train_tokens, "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(own_scores, starts)}))
                cut, at = upto, int(ends[upto - 1])
        return pd.concat(rows)

    out = blocks.groupBy("_block").cogroup(known.groupBy("_block")).applyInPandas(
        measure, "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def score_corpus(spark: SparkSession, docs: DataFrame, train: DataFrame, order: int = ORDER) -> DataFrame:
    """Learn from ``train`` and score ``docs``."""
    model, exact = fit(train, order)
    return score(docs, model, exact)
