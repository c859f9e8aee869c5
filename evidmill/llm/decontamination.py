"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions only.

The index holds one posting ``(row, pos, term)`` for every word of every document that occurs in the benchmark too; other
words can't be part of a match. Position 0 of each row is a mark that no word equals, so every document has a posting and
carries its id and number of words. Benchmark windows (terms in order) are looked up from their rarest terms: the postings
of the rarest term give the places where a window could start, the list of the second rarest, shifted by its offset in the window,
is intersected with them, then those of all other terms. What is left are the exact phrases. For proximity the
lists are intersected by stretches instead: all terms of a window within so many words, in any order.

Postings lie in a written table, so every later step starts from files. Joins are on (row, position), which is unique in the
index: a term, a passage or a group of copies that holds a third of all rows spreads over all tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.llm.common import BROADCAST_ROWS, written

# Words of a window. An item of fewer words is one window.
WINDOW = 10

# Between words stands what is neither a letter nor a digit of ASCII; all other characters belong to words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The term of position 0: a character that never is in a word.
_MARK = "|"


class Windows(NamedTuple):
    """``terms``: ``term, name``; ``windows``: ``window, size, offset, name``; ``items``: ``window, item_id``."""

    terms: DataFrame
    windows: DataFrame
    items: DataFrame


def split_words(text: Column) -> Column:
    """Words with A-Z lower-cased, as an array whose first and last element may be empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() would change other letters too; on pure ASCII it's the same and faster.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.split(low, BREAK)


def _small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its rows, a few numbers or words wide, are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> Windows:
    """The windows of ``benchmark`` (``item_id, text``): runs of ``width`` words, told apart by their words.

    Items without words, null texts too, have none. Items are told apart by ``item_id``; those without one count as one.
    """
    words = benchmark.select("item_id", F.filter(split_words(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    spans = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("words"))
    named = written(spans.groupBy("words").agg(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("ids")).withColumn("window", F.monotonically_increasing_id()), "windows")
    vocabulary = named.select(F.explode("words").alias("term")).distinct()
    # Numbers from 1; 0 is the mark's.
    terms = written(vocabulary.withColumn("name", F.monotonically_increasing_id() + 1), "terms")
    places = named.select("window", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    return Windows(terms, written(places.join(terms, "term").select("window", "size", "offset", "name"), "window-terms"), named.select("window", F.explode("ids").alias("item_id")))


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written positional index: ``row, doc_id, n_words, pos, name``, words counted from 1, and ``name`` 0 at position 0.

    ``row`` tells rows apart whatever their ids. A null text has no words.
    """
    parts = split_words(F.col("text"))
    # A break at either end leaves an empty element there; it keeps its position and matches nothing.
    count = F.size("_w") - (F.col("_w")[0] == "").cast("int") - ((F.size("_w") > 1) & (F.element_at("_w", -1) == "")).cast("int")
    rows = docs.select("doc_id", parts.alias("_w")).select(F.monotonically_increasing_id().alias("row"), "doc_id", count.cast("long").alias("n_words"), F.concat(F.array(F.lit(_MARK)), "_w").alias("_w"))
    postings = rows.select("row", "doc_id", "n_words", F.posexplode("_w").alias("pos", "term"))
    known = terms.union(docs.sparkSession.range(1).select(F.lit(_MARK).alias("term"), F.col("id").alias("name")))
    return written(postings.join(_small(known), "term").select("row", "doc_id", "n_words", "pos", "name"), "postings")


def rarest_first(windows: DataFrame, postings: DataFrame) -> DataFrame:
    """``window, size, lists``: the window's ``(offset, name)``, rarest term first; only windows whose terms all occur."""
    counts = postings.where("name > 0").groupBy("name").count()
    ranked = windows.join(_small(written(counts, "term-counts")), "name")
    lists = F.sort_array(F.collect_list(F.struct("count", "offset", "name")))
    whole = ranked.groupBy("window", "size").agg(lists.alias("lists")).where(F.size("lists") == F.col("size"))
    return written(whole, "window-lists")


def _listed(postings: DataFrame, names: DataFrame) -> DataFrame:
    """The postings of the terms ``names``."""
    return postings.select("row", "pos", "name").join(_small(names.select("name").distinct()), "name", "left_semi")


def _starts(lists: DataFrame, postings: DataFrame) -> DataFrame:
    """``row, window, start`` where a window's rarest term stands at its place."""
    rarest = lists.select("window", F.col("lists")[0]["name"].alias("name"), F.col("lists")[0]["offset"].alias("offset"))
    side = F.broadcast(rarest) if rarest.count() <= BROADCAST_ROWS else rarest
    return postings.select("row", "pos", "name").join(side, "name").select("row", "window", (F.col("pos") - F.col("offset")).alias("start"))


def _intersected(starts: DataFrame, lists: DataFrame, postings: DataFrame, first: int, last: int | None) -> DataFrame:
    """Those of ``starts`` at which the lists from ``first`` to before ``last`` (places in order of rarity) stand too."""
    some = lists.select("window", F.slice("lists", first + 1, F.size("lists") if last is None else last - first).alias("some")).withColumn("n", F.size("some"))
    side = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    asked = starts.join(side, "window").select("row", "window", "start", "n", F.explode_outer("some").alias("l"))
    asked = asked.select("row", "window", "start", "n", F.col("l.name").alias("name"), (F.col("start") + F.col("l.offset")).alias("pos"))
    needed = _listed(postings, side.select(F.explode("some.name").alias("name")))
    rows = written(starts.select("row").distinct(), "phrase-rows")
    if rows.count() <= BROADCAST_ROWS:  # only a saving: beyond the bound all postings of the terms go to the join
        needed = needed.join(F.broadcast(rows), "row", "left_semi")
    found = asked.where("n > 0").join(needed, ["row", "pos", "name"]).groupBy("row", "window", "start", "n").count().where("count = n")
    return found.select("row", "window", "start").union(asked.where("n = 0").select("row", "window", "start"))


def phrase_matches(lists: DataFrame, postings: DataFrame) -> DataFrame:
    """``row, window, start`` of every exact occurrence of every window; ``start`` is the position of its first word."""
    starts = _intersected(written(_starts(lists, postings), "phrase-rarest"), lists, postings, 1, 2)
    return _intersected(written(starts, "phrase-starts"), lists, postings, 2, None)


def proximity_matches(lists: DataFrame, postings: DataFrame, slack: int) -> DataFrame:
    """``row, window`` of windows whose different terms all stand within ``size + slack`` neighbouring words, in any order.

    A stretch is sought around each posting of the rarest term; positions are bucketed by the stretch's length, so only
    neighbouring buckets meet, and what is gathered per posting is at most two stretches of words.
    """
    spans = lists.select("window", (F.col("size") + slack).alias("span"), F.array_distinct("lists.name").alias("names"), F.col("lists")[0]["name"].alias("name"))
    side = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans
    around = postings.select("row", F.col("pos").alias("at"), "name").join(side, "name").drop("name")
    bucket = F.floor(F.col("at") / F.col("span"))
    near = around.withColumn("name", F.explode("names")).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    needed = _listed(postings, side.select(F.explode("names").alias("name")))
    sizes = [r.span for r in spans.select("span").distinct().collect()]  # one for each size a window can have
    wide = needed.withColumn("span", F.explode(F.array(*[F.lit(s) for s in sizes] or [F.lit(1)]))).withColumn("bucket", F.floor(F.col("pos") / F.col("span")))
    met = near.join(wide, ["row", "name", "span", "bucket"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("span"))
    gathered = met.groupBy("row", "window", "at", "span").agg(F.collect_list(F.struct("pos", "name")).alias("places"), F.first(F.size("names")).alias("n"))
    inside = lambda p: F.size(F.array_distinct(F.transform(F.filter("places", lambda x: (x["pos"] >= p["pos"]) & (x["pos"] < p["pos"] + F.col("span"))), lambda x: x["name"])))
    return gathered.where(F.exists("places", lambda p: inside(p) == F.col("n"))).select("row", "window").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated``: one row per row of ``docs``.

    A word inside any occurrence of a window is hit; ``items`` are the ids, sorted as strings, of the items with occurring
    windows. Null and empty texts have no words and no hits; rows without id and rows that repeat an id or a text are
    judged each by itself; extra columns are ignored. Empty tables give no rows, or rows without hits.
    """
    found = windows_of(benchmark, width)
    postings = index(docs, found.terms)
    lists = rarest_first(found.windows, postings)
    matches = written(phrase_matches(lists, postings), "phrases")
    sizes = lists.select("window", "size")
    spans = matches.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "window").select("row", "start", (F.col("start") + F.col("size")).alias("stop"))
    # Words of a span that no earlier span of its document covers. The window is one document's spans.
    earlier = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.groupBy("row", "start").agg(F.max("stop").alias("stop")).withColumn("_to", F.coalesce(F.max("stop").over(earlier), F.lit(0)))
    hits = fresh.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "_to"))).cast("long").alias("n_hit"))
    named = matches.select("row", "window").distinct().join(_small(found.items), "window").select("row", "item_id").distinct()
    items = named.groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    heads = postings.where("name = 0").select("row", "doc_id", "n_words")
    whole = heads.join(hits, "row", "left").join(items, "row", "left")
    none = F.array().cast("array<string>")
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
                        F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def near_contamination(docs: DataFrame, benchmark: DataFrame, slack: int, width: int = WINDOW) -> DataFrame:
    """``doc_id, items``: documents in which all terms of a window stand within ``width + slack`` words, with the items' ids.

    Documents without such a stretch give no row. Other cases as in ``contamination``.
    """
    found = windows_of(benchmark, width)
    postings = index(docs, found.terms)
    near = proximity_matches(rarest_first(found.windows, postings), postings, slack)
    named = near.join(_small(found.items), "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return postings.where("name = 0").join(named, "row").select("doc_id", "items")
