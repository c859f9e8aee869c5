"""Document fingerprints from spots: a common word (anchor) and the chain of content words that follows it.

Anchors and content words alternate in running prose and hardly at all in menus and lists, so the spots mark the prose. A
document's signatures are a set of hashes; likeness of two documents is the Jaccard index of their sets. Only DataFrame
functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.llm.common import BROADCAST_ROWS

# Common words of English, German, French and Spanish prose.
ANCHORS = (
    "a an and are as at be by for from has he in is it not of on or that the this to was were which will with "
    "der die das den dem des ein eine und ist in zu von mit auf für nicht sich als auch es an werden aus bei "
    "le la les un une de du des et est en que qui dans pour pas sur par au avec ce il ne se "
    "el los las una y es por con para no su lo al del se como más"
).split()

CHAIN = 2  # content words after an anchor

# Ids that share all but the last bits make a block: at most 2 ** BLOCK_BITS documents follow one another in a window.
BLOCK_BITS = 11

_MARK = "\u0001"


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, anchors: list[str] = tuple(ANCHORS), chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a text as longs; null and empty texts have none.

    Words are lower-case runs of letters and digits. A text whose anchors start no full chain takes a chain at every word,
    one with fewer words than that its words as one signature, one without words its characters.
    """
    lower = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # Anchors are hung on the word before them: "x the of y z" becomes "x|the|of", "y", "z".
    hung = F.regexp_replace(lower, " (" + "|".join(sorted(set(anchors))) + ")(?= )", _MARK + "$1")
    units = F.split(F.trim(hung), " ")

    def content(x, i):
        return F.substring_index(F.get(x["u"], i), _MARK, 1)

    def spots(x, every):
        def one(u, i):
            full = i + chain < F.size(x["u"])
            if not every:
                full = full & (F.instr(u, _MARK) > 0)
            first = F.substring_index(u, _MARK, 1 if every else -1)
            return F.when(full, F.xxhash64(first, *[content(x, i + k) for k in range(1, chain + 1)]))

        return F.array_sort(F.array_distinct(F.filter(F.transform(x["u"], one), lambda s: s.isNotNull())))

    def pick(x):
        words = F.trim(x["t"])
        rest = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.when(words == "", text).otherwise(words))))
        return _bound(spots(x, False), lambda s: F.when(F.size(s) > 0, s).otherwise(_bound(spots(x, True), lambda e: F.when(F.size(e) > 0, e).otherwise(rest))))

    return _bound(F.struct(units.alias("u"), lower.alias("t")), pick)


def digest(sigs: Column) -> Column:
    """The fingerprint as text: SHA-256 of the sorted signatures. Equal exactly for equal sets."""
    return F.sha2(F.array_join(sigs.cast("array<string>"), ",").cast("binary"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two sets; two empty sets are alike. Sets of which one is empty aren't compared at all."""
    shared = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(shared / (F.size(a) + F.size(b) - shared)))


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """``doc_id, text, sigs`` per row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sigs", signatures(F.col("text"), chain=chain))


def following(rows: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``_next``, the ``text, sigs`` of the next row by falling ``doc_id``; after the last comes the first.

    Rows are dealt to blocks of neighbouring ids. The first row of each block is also sent to the block before it, where it
    follows the last one, so no window spans more than a block. Repeated ids follow one another by their text; rows
    without id come last.
    """
    rows = rows.withColumn("_block", F.coalesce(F.shiftright("doc_id", bits), F.lit(-(1 << 62))))
    tops = rows.groupBy("_block").agg(F.max("doc_id").alias("_top"))
    line = Window.orderBy(F.desc("_block"))  # one row per block
    feeds = tops.select(F.col("_block").alias("_from"), "_top",
                        F.coalesce(F.lag("_block").over(line), F.last("_block").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_to"))
    feeds = F.broadcast(feeds) if tops.count() <= BROADCAST_ROWS else feeds
    met = rows.join(feeds, (F.col("_block") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_top")), "left")
    place = F.struct(F.col("_block").alias("at"), F.lit(0).alias("fed"))
    again = F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("at"), F.lit(1).alias("fed")))
    sent = met.withColumn("_p", F.explode(F.array_compact(F.array(place, again))))
    order = Window.partitionBy("_p.at").orderBy("_p.fed", F.desc_nulls_last("doc_id"), "text")
    return sent.withColumn("_next", F.lead(F.struct("text", "sigs")).over(order)).where("_p.fed = 0").drop("_p", "_block", "_from", "_top", "_to")


def edited_likeness(docs: DataFrame, chain: int = CHAIN, bits: int = BLOCK_BITS) -> DataFrame:
    """Fingerprints of texts and of their edited forms, with likenesses, one row per row of ``docs``.

    Edited: the last third of the code points is replaced by the beginning of the next document's text.
    """
    rows = following(fingerprints(docs, chain), bits)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("_next.text"), F.lit(1), third))
    rows = rows.withColumn("_edited", edited).withColumn("_edited_sigs", signatures(F.col("_edited"), chain=chain))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("sigs")).alias("fingerprint"), digest(F.col("_edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("_edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("_next.sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"))


def near_pairs(docs: DataFrame, percent: int = 80, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """``(a, b, likeness)`` between representatives of equal fingerprints, and ``(doc_id, representative)``.

    Sets are partitioned by length so that sets of one partition and the next are the only ones that can be alike enough.
    Within a partition each set offers its rarest signatures, all but as many as any set alike enough must share less
    one; pairs that meet are pruned by their lengths and then compared. Sets without signatures have no pairs.
    """
    prints = fingerprints(docs, chain).where("doc_id IS NOT NULL").select("doc_id", "sigs", digest(F.col("sigs")).alias("_f"))
    sets = prints.groupBy("_f").agg(F.min("doc_id").alias("r"), F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")).where("n > 0")
    part = F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9)
    entries = sets.select("r", "n", part.alias("p"), F.explode("sigs").alias("s"))
    often = entries.groupBy("s").agg(F.count("*").alias("_df"))
    own = Window.partitionBy("r").orderBy("_df", "s")  # the signatures of one document
    prefix = entries.join(often, "s").withColumn("_rank", F.row_number().over(own))
    prefix = prefix.where((F.col("_df") > 1) & (F.col("_rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).select("r", "n", "p", "s")
    left = prefix.select(F.col("r").alias("a"), F.col("n").alias("_na"), "s", F.explode(F.array(F.col("p"), F.col("p") + 1)).alias("p"), F.col("p").alias("_pa"))
    right = prefix.select(F.col("r").alias("b"), F.col("n").alias("_nb"), "s", "p")
    met = left.join(right, ["s", "p"]).where((F.col("_na") * 100 >= F.col("_nb") * percent) & (F.col("_nb") * 100 >= F.col("_na") * percent))
    met = met.where((F.col("a") < F.col("b")) | ((F.col("_pa") < F.col("p")) & (F.col("a") != F.col("b"))))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    whole = sets.select("r", "sigs")
    both = pairs.join(whole.withColumnsRenamed({"r": "a", "sigs": "sa"}), "a").join(whole.withColumnsRenamed({"r": "b", "sigs": "sb"}), "b")
    out = both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") * 100 >= percent)
    members = prints.select("doc_id", "_f").join(sets.select("_f", "r"), "_f").select("doc_id", F.col("r").alias("representative"))
    return out, members
