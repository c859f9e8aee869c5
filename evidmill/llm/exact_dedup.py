"""Exact duplicates by block naming: every text gets a collision-free integer identity.

A text without white space is cut into blocks of a fixed size. Blocks are sorted and numbered, so that equal blocks and no
others share a number; adjacent numbers are paired and the pairs numbered again, until one number stands for the document.
The sort key of a block is its 64-bit hash and then its content. Content is carried only for hashes that occur twice or
more: a hash that occurs once already proves that its block equals no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.llm.common import SPACE, matching
from evidmill.operators.grouping import global_index
from evidmill.session import settle

BLOCK_CHARS = 8192
_KEY = ["doc_id", "text_sha256"]


def _normal(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.regexp_replace(text, SPACE, "").alias("_norm"))


def _blocks(block_chars: int):
    """The blocks of ``_norm``; the empty text is one empty block."""
    last = F.greatest(F.ceil(F.char_length("_norm") / block_chars) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("_norm"), i * block_chars + 1, F.lit(block_chars)))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` rows as ``doc_id, n_chars, text_sha256, level, name``: equal ``(level, name)`` if and only if equal texts.

    Null text counts as empty, and empty texts equal one another. A null ``doc_id`` is kept as a row of its own. Other
    columns of ``docs`` are ignored. An empty table gives no rows.
    """
    # The digest and the block hashes are computed once and settled: about a hundred bytes a document.
    base = settle(_normal(docs).select("doc_id", "n_chars", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
                                       F.transform(_blocks(block_chars), lambda b: F.xxhash64(b)).alias("_hashes")))
    rows = base.dropDuplicates(_KEY).select(*_KEY, F.size("_hashes").alias("_n"), F.posexplode("_hashes").alias("_i", "_h"))

    count = settle(base.select(F.explode("_hashes").alias("_h")).groupBy("_h").agg(F.count("*").alias("_c")))
    cut = _normal(docs).select(F.explode(_blocks(block_chars)).alias("_block")).select(F.xxhash64("_block").alias("_h"), "_block")
    # Copies of a block collapse within each task before they are shuffled.
    shared = matching(cut, count.where("_c > 1"), "_h").groupBy("_h", "_block").agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_h").orderBy("_block")  # blocks of one hash: one, unless hashes collide
    ranked = settle(shared.select("_h", F.row_number().over(order).alias("_r"),
                                  F.when(F.count("*").over(Window.partitionBy("_h")) > 1, F.col("_block")).alias("_block")))
    single = count.where("_c = 1").select("_h", F.lit(1).alias("_r"), F.lit(None).cast("string").alias("_block"))
    names = global_index(single.union(ranked), [F.col("_h"), F.col("_r")], "_name").select("_h", "_block", "_name")

    clear, clash = names.where("_block IS NULL").drop("_block"), names.where("_block IS NOT NULL")
    level = rows.join(clear, "_h").select(*_KEY, "_n", "_i", "_name")
    if not clash.isEmpty():  # a hash with several blocks: these few rows are told apart by their content
        texts = _normal(docs).select("doc_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
                                     F.posexplode(_blocks(block_chars)).alias("_i", "_block")).withColumn("_h", F.xxhash64("_block"))
        told = matching(texts, clash.select("_h").distinct(), "_h").join(clash, ["_h", "_block"]).dropDuplicates([*_KEY, "_i"])
        sizes = base.dropDuplicates(_KEY).select(*_KEY, F.size("_hashes").alias("_n"))
        level = level.union(_with(told, sizes).select(*_KEY, "_n", "_i", "_name"))
    done, depth = None, 0
    level = settle(level)
    while True:
        finished = level.where("_n = 1").select(*_KEY, F.lit(depth).alias("level"), F.col("_name").alias("name"))
        done = finished if done is None else done.union(finished)
        open_rows = level.where("_n > 1")
        if open_rows.isEmpty():
            break
        even = F.col("_i") % 2 == 0
        pairs = settle(open_rows.groupBy(*_KEY, F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.floor(F.col("_i") / 2).cast("int").alias("_i"))
                       .agg(F.max(F.when(even, F.col("_name"))).alias("_l"), F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(-1)).alias("_r")))
        named = global_index(pairs.select("_l", "_r").distinct(), [F.col("_l"), F.col("_r")], "_name")
        level, depth = settle(pairs.join(named, ["_l", "_r"]).select(*_KEY, "_n", "_i", "_name")), depth + 1
    return _with(base.drop("_hashes"), done)


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on the row key; absent ids match one another."""
    r = right.withColumnsRenamed({k: f"_k_{k}" for k in _KEY})
    on = F.col("text_sha256").eqNullSafe(F.col("_k_text_sha256")) & F.col("doc_id").eqNullSafe(F.col("_k_doc_id"))
    return left.join(r, on).drop(*[f"_k_{k}" for k in _KEY])


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Of equal texts (white space apart) the row with most code points stays, then the smallest ``doc_id``; absent ids come
    last. Rows that repeat the id that stays are the same document and count as kept.
    """
    rows = settle(identities(docs, block_chars))
    first = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    groups = rows.groupBy("level", "name").agg(first["id"].alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
