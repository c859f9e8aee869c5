"""Near duplicates by bottom-k sketches: one hash function, inverted lists, union-sketch estimates, exact Jaccard.

Texts with the same shingle set form a class that one node stands for, so copies cost nothing further. A node's sketch is
the ``SKETCH`` smallest hashes of its set (the whole set where it is smaller). Two sets of the asked similarity share at
least ``shared_least`` sketch values, so it suffices to look at each sketch's rarest values, all but ``shared_least - 1``
of them: the pair meets in an inverted list of both. Lists are read in two rounds without forming all pairs of a list:

1. every member is compared with the list's head, the node with most values in common lists (in a group of near copies the
   least edited one), and the confirmed links are joined to components;
2. nodes of lists whose members still lie in different components are looked at with their full sets: values are ranked
   again by how many of these nodes have them, each node offers the exact prefix of the similarity, and those pairs of
   different components that meet are compared whose sizes and common values leave room for the similarity.

After the second round every pair that shares a list lies in one component or has been compared or ruled out, so no link
between components can be missing. Candidates whose estimate from the union's sketch is far below the threshold are
dropped; the rest are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.llm.common import components, matching, mix, prepare, word_hashes, written

SKETCH = 64

# Of 64 sketch values two sets of similarity 0.8 share 51 on average; fewer than 30 in about one of 10^7 such pairs.
SHARED = 30

# The same for the pairs of the second round: 256 smallest values, of which 205 are shared on average and, with the floor at
# 73 % of that, at least 149 in all but one of 10^15 pairs. Smaller sets are compared whole.
PROBE = 256
PROBE_FLOOR = 73

# Longs of a parity, which bounds the difference of two sets from below, and of its folded form, which is looked at first.
PARITY = 64
FOLDED = 8

# A union-sketch estimate under this part of the threshold is seven standard deviations away from it.
ESTIMATE_FLOOR = 0.56


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; fewer words than ``width`` make one shingle, none make none."""
    words = word_hashes((text or "").encode().lower())  # bytes: only A-Z change
    if not len(words):
        return words
    n = max(len(words) - width + 1, 1)
    out = words[:n]
    with np.errstate(over="ignore"):
        for j in range(1, min(width, len(words))):
            out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n])
    return np.unique(out)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs of the same order."""
    return (values ^ np.uint64(1 << 63)).view(np.int64)


def sketches(docs: DataFrame, width: int, sketch: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, set_key, sketch`` per row; the key is a 128-bit digest of the whole set."""
    prepare(docs.sparkSession)

    def build(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
                "set_key": pd.Series([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], dtype=object),
                "sketch": pd.Series([signed(s[:sketch]) for s in sets], dtype=object)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        build, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def parity(values: np.ndarray) -> np.ndarray:
    """``PARITY`` longs: bit ``h`` tells whether an odd number of values fall to ``h``.

    Two sets differ in at least as many values as their parities differ in bits.
    """
    odd = np.bincount((values >> np.uint64(20)) % np.uint64(64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node, set, parity``: the whole sets of the documents that ``nodes`` names, as sorted 64-bit hashes."""

    def build(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "set": pd.Series([signed(s) for s in sets], dtype=object),
                                "parity": pd.Series([parity(s) for s in sets], dtype=object)})

    rows = matching(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), nodes, "node")
    return rows.mapInPandas(build, "node long, set array<long>, parity array<long>")


def shared_least(n: Column, percent: int, sketch: int) -> Column:
    """Sketch values that a set of size ``n`` shares with every set of the asked similarity.

    Where both sets are whole in their sketches this is exact. Beyond, it is ``SHARED`` of ``SKETCH`` in proportion.
    """
    whole = n * 100 < sketch * percent
    return F.when(whole, F.ceil(n * percent / 100)).otherwise(F.lit(max(1, sketch * SHARED // SKETCH)))


def near_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, percent: int, sketch: int) -> DataFrame:
    """The pairs ``(a, b)`` with ``100 * intersection >= percent * union`` on their full sets."""
    side = nodes.select("node", "sketch")
    met = pairs.join(side.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a").join(side.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    close = written(met.where(shared * 100 >= ESTIMATE_FLOOR * percent * F.size(union)).select("a", "b"), "near-pairs")

    def exact(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch["sa"], batch["sb"]):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[good, ["a", "b"]]

    wanted = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    sets = full_sets(docs, wanted, width).drop("parity")
    both = close.join(sets.withColumnsRenamed({"node": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "set": "sb"}), "b")
    return both.mapInPandas(exact, "a long, b long")


def inverted_lists(nodes: DataFrame, percent: int, sketch: int) -> DataFrame:
    """``value, node, n, weight``: for each sketch its rarest values that another sketch has too.

    ``weight``: how often all of its values occur. The least edited of many near copies weighs most.
    """
    entries = nodes.select("node", "n", F.explode("sketch").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("_df")).where("_df > 1")
    own = Window.partitionBy("node", "n")  # at most one sketch
    size = F.least(F.col("n"), F.lit(sketch))
    ranked = entries.join(often, "value").select(
        "value", "node", "n", F.row_number().over(own.orderBy("_df", "value")).alias("_rank"), F.count("*").over(own).alias("_often"), F.sum("_df").over(own).alias("weight"))
    # Values that no other sketch has are the rarest of all and come first.
    return ranked.where(F.col("_rank") + (size - F.col("_often")) <= size - shared_least(F.col("n"), percent, sketch) + 1).select(
        "value", "node", "n", "weight")


def _folded(k: int) -> Column:
    """Long ``k`` of the folded parity, which is a parity of fewer bits."""
    out = F.col("parity")[k]
    for j in range(k + FOLDED, PARITY, FOLDED):
        out = out.bitwiseXOR(F.col("parity")[j])
    return out


def across(docs: DataFrame, placed: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes of different components that may be similar; ``placed``: ``node, component``.

    The prefix filter on full sets. A pair is formed only if its sizes, its ``room`` (the values of a set that another
    node has, too), the difference of its parities and the overlap of its ``PROBE`` smallest values leave the similarity possible. In each list the
    members of the most frequent component meet the others only, never one another.
    """
    sets = written(full_sets(docs, placed.select("node"), width), "near-full").withColumn("n", F.size("set").cast("long"))
    entries = sets.select("node", "n", F.explode("set").alias("value"))
    often = entries.groupBy("value").agg(F.count("*").alias("_df")).where("_df > 1")
    own = Window.partitionBy("node", "n")  # the values of one document
    ranked = entries.join(often, "value").select("value", "node", "n", F.row_number().over(own.orderBy("_df", "value")).alias("_rank"), F.count("*").over(own).alias("room"))
    prefix = ranked.where(F.col("_rank") + F.col("n") - F.col("room") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    lists = written(prefix.join(placed, "node").select("value", "node", "room", "component"), "near-open")
    counts = lists.groupBy("value", "component").agg(F.count("*").alias("_c"))
    main = counts.groupBy("value").agg(F.max(F.struct("_c", "component")).alias("_m"), F.count("*").alias("_parts")).where("_parts > 1")
    bits = [f"bits{k}_" for k in range(FOLDED)]
    known = sets.select("node", "n", F.slice("set", 1, PROBE).alias("probe"), "parity",
                        *[_folded(k).alias(b) for k, b in enumerate(bits)])
    rows = lists.join(main.select("value", F.col("_m.component").alias("_main")), "value").join(known, "node")
    columns = ("node", "room", "component", "n", "probe", "parity", *bits)
    left = rows.where("component <> _main").select("value", *[F.col(c).alias(c + "1") for c in columns])
    right = rows.select("value", (F.col("component") == F.col("_main")).alias("_in_main"), *[F.col(c).alias(c + "2") for c in columns])
    shared = F.size(F.array_intersect("probe1", "probe2"))
    sizes = F.col("n1") + F.col("n2")
    apart = sum((F.bit_count(F.col(b + "1").bitwiseXOR(F.col(b + "2"))) for b in bits), F.lit(0))
    wholly = F.aggregate(F.zip_with("parity1", "parity2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, b: total + b)
    fits = (
        (F.col("component1") != F.col("component2")) & (F.col("_in_main") | (F.col("node1") < F.col("node2")))
        & near_sizes("n1", "n2", percent) & (F.least("room1", "room2") * (100 + percent) >= sizes * percent)
        & (apart * (100 + percent) <= sizes * (100 - percent)) & (wholly * (100 + percent) <= sizes * (100 - percent))
        & F.when(F.greatest("n1", "n2") <= PROBE, shared * (100 + percent) >= sizes * percent).otherwise(shared >= PROBE * percent * PROBE_FLOOR // 10_000))
    pairs = left.join(right, (left["value"] == right["value"]) & fits)
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, sketch: int) -> DataFrame:
    """Confirmed links that give the same components as all links."""
    lists = written(inverted_lists(nodes, percent, sketch), "near-lists")
    heads = lists.groupBy("value").agg(F.max(F.struct("weight", F.col("node").alias("_head"), F.col("n").alias("_nh"))).alias("_h")).select("value", "_h._head", "_h._nh")
    first = lists.join(heads, "value").where(F.col("_head") != F.col("node")).where(near_sizes("_nh", "n", percent))
    first = written(first.select(F.least("_head", "node").alias("a"), F.greatest("_head", "node").alias("b")).distinct(), "near-first")
    found = written(confirmed(docs, first, nodes, width, percent, sketch), "near-links")

    placed = lists.join(components(found), "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("value").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("value")
    open_nodes = written(placed.join(mixed, "value").select("node", "component").distinct(), "near-open-nodes")
    rest = across(docs, open_nodes, width, percent).join(first, ["a", "b"], "left_anti")
    return found.union(confirmed(docs, rest, nodes, width, percent, sketch))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``.

    Null and empty texts and texts of white space have no shingles and are linked with nothing. Rows that repeat a
    ``doc_id`` are one document; a row without id is linked with nothing, has no component and is kept. An empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    rows = written(sketches(docs, width, sketch), "near-sketches")
    # Rows of a class have one and the same sketch.
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(classes, "near-nodes")
    found = written(links(docs, nodes, width, percent, sketch), "near-all-links")
    same_id = rows.where("doc_id IS NOT NULL AND n_shingles > 0").select("doc_id", "set_key").join(nodes.select("set_key", "node"), "set_key")
    repeated = same_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    label = components(found.union(repeated)).withColumnRenamed("component", "_label")
    of_class = nodes.select("set_key", "node").join(label, "node", "left").select("set_key", F.coalesce("_label", "node").alias("_component"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
