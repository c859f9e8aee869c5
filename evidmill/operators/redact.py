"""Secret, path and personal-data scans over text and JSON (R family).

Everything that looks at text runs on the JVM. A text is cut at the matches of each detector; the lengths of the parts give
the places of the hits; one pass over the hits in order settles overlaps and writes the redacted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions import detectors as dt, json_spans
from evidmill.functions.paths import scrub_local_paths

_FINDING = "array<struct<start:int,end:int,detector:string,tier:string,line:int,excerpt:string,at:int>>"
_HIT = "array<struct<start:int,shorter:int,rank:int,stop:int,hit:string>>"
# States that a rewrite may raise to redacted.
UPGRADEABLE = ("safe", "unknown")
# Code points on either side of a finding that its excerpt shows.
WINDOW = 32


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def hits(text: Column, pattern: str, group: int, rank: int, reject: str | None = None, marked: Column | None = None) -> Column:
    """Places of a pattern's matches as ``(start, minus length, rank, stop, hit)``, counted from 0; none where ``marked`` is false."""
    none = F.array().cast(_HIT)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), part.alias("part"))

    def walk(acc, p):
        after = acc["at"] + F.length(p["gap"]) + F.coalesce(F.length(p["whole"]), F.lit(0))
        size = F.length(p["part"])
        bad = p["part"].isNull() | (size == 0)
        if reject:
            bad = bad | p["part"].rlike(f"^(?:{reject})$")
        hit = F.struct((after - size).alias("start"), (-size).alias("shorter"), F.lit(rank).alias("rank"), after.alias("stop"), p["part"].alias("hit"))
        return F.struct(after.alias("at"), F.when(F.coalesce(bad, F.lit(True)), acc["hits"]).otherwise(F.array_append(acc["hits"], hit)).alias("hits"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("hits")), walk, lambda acc: acc["hits"])
    # Conjunctions are evaluated from the left, so an unmarked text never meets the pattern.
    return F.when(text.rlike(pattern) if marked is None else marked & text.rlike(pattern), found).otherwise(none)


def spans(text: Column, key: Column, chosen: tuple[dt.Detector, ...]) -> Column:
    """Hits that don't overlap: earliest first, then longest, then registry order.

    A hit inside one of our own placeholders is dropped; one around it is kept.
    """
    found = [hits(text, dt.pattern(d), d.group, k, d.reject, dt.marked(text, d)) for k, d in enumerate(chosen)]
    for k, d in enumerate(chosen):
        if d.keyed:
            bare = hits(text, dt.pattern(d._replace(pattern=d.keyed[1])), 0, k, d.reject)
            found.append(F.when(key.rlike(d.keyed[0]), bare).otherwise(F.array().cast(_HIT)))
    names = "|".join(d.name for d in dt.DETECTORS if d.name != "home_path")
    own = hits(text, rf"\[REDACTED:(?:{names})\]", 0, 0, marked=F.contains(text, F.lit("[REDACTED:")))

    def settle(both):
        free = F.filter(both["all"], lambda h: ~F.exists(both["own"], lambda o: (o["start"] <= h["start"]) & (h["stop"] <= o["stop"])))
        start = F.struct(F.lit(0).alias("end"), F.array().cast(_HIT).alias("kept"))
        return F.aggregate(
            F.array_sort(free), start,
            lambda acc, h: F.when(h["start"] >= acc["end"], F.struct(h["stop"].alias("end"), F.array_append(acc["kept"], h).alias("kept"))).otherwise(acc),
            lambda acc: acc["kept"])

    return _bound(F.struct(F.array_distinct(F.concat(*found)).alias("all"), own.alias("own")), settle)


def replacement(hit: Column, chosen: tuple[dt.Detector, ...]) -> Column:
    """What stands in for a hit; the base name of a path stays."""
    names = F.array(*[F.lit(d.name) for d in chosen])
    name = F.get(names, hit["rank"])
    return (F.when(name == "home_path", dt.HOME_TEXT).when(name == "abs_path", scrub_local_paths(hit["hit"]))
            .otherwise(F.concat(F.lit("[REDACTED:"), name, F.lit("]"))))


def excerpt(text: Column, at: Column, window: int) -> Column:
    """The text around place ``at`` (from 0), with dots where it was cut."""
    before = F.substring(text, F.lit(1), at)
    after = F.substring(text, at + 1, F.lit(1 << 30))
    return F.concat(
        F.when(F.length(before) > window, "...").otherwise(""), F.right(before, F.lit(window)),
        F.left(after, F.lit(window)), F.when(F.length(after) > window, "...").otherwise(""))


def redacted(text: Column, kept: Column, chosen: tuple[dt.Detector, ...]) -> Column:
    """``redacted`` and ``findings`` of a text, given its hits in order."""
    mark = "array<struct<start:int,end:int,rank:int,line:int,at:int>>"
    first = F.struct(F.lit(0).alias("cursor"), F.lit("").alias("out"), F.lit(1).alias("line"), F.array().cast(mark).alias("marks"))

    def write(acc, h):
        gap = F.substring(text, acc["cursor"] + 1, h["start"] - acc["cursor"])
        passed = F.substring(text, acc["cursor"] + 1, h["stop"] - acc["cursor"])
        line = acc["line"] + F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit("")))
        before = F.concat(acc["out"], gap)
        here = F.struct(h["start"].alias("start"), h["stop"].alias("end"), h["rank"].alias("rank"), line.alias("line"), F.length(before).alias("at"))
        return F.struct(
            h["stop"].alias("cursor"), F.concat(before, replacement(h, chosen)).alias("out"),
            (acc["line"] + F.length(passed) - F.length(F.replace(passed, F.lit("\n"), F.lit("")))).alias("line"), F.array_append(acc["marks"], here).alias("marks"))

    def finish(done):
        whole = F.concat(done["out"], F.substring(text, done["cursor"] + 1, F.lit(1 << 30)))
        names, tiers = F.array(*[F.lit(d.name) for d in chosen]), F.array(*[F.lit(d.tier) for d in chosen])

        def finding(full):
            flat = lambda m: F.replace(F.replace(excerpt(full, m["at"], WINDOW), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
            return F.struct(full.alias("redacted"), F.transform(done["marks"], lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), F.get(names, m["rank"]).alias("detector"), F.get(tiers, m["rank"]).alias("tier"),
                m["line"].alias("line"), flat(m).alias("excerpt"), m["at"].alias("at"))).cast(_FINDING).alias("findings"))

        return _bound(whole, finding)

    return _bound(F.aggregate(kept, first, write), finish)


def scan(df: DataFrame, text: str, key: Column | None = None, names: tuple[str, ...] = dt.DEFAULT, more: tuple[dt.Detector, ...] = ()) -> DataFrame:
    """``df`` with ``redacted`` and ``findings``; ``more`` registers further detectors.

    ``start`` and ``end`` of a finding are places in the text, ``at`` is where its replacement begins in ``redacted``.
    """
    chosen = dt.chosen(names, more)
    key = F.lit(None).cast("string") if key is None else key
    clean = F.struct(F.col(text).alias("redacted"), F.array().cast(_FINDING).alias("findings"))
    # Hits are settled before they are used: the projections stay apart.
    placed = df.withColumn("_hits", spans(F.col(text), key, chosen))
    done = placed.withColumn("_r", F.when(F.size("_hits") > 0, redacted(F.col(text), F.col("_hits"), chosen)).otherwise(clean))
    return done.withColumns({"redacted": F.col("_r.redacted"), "findings": F.col("_r.findings")}).drop("_r", "_hits")


def findings(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding."""
    # A plain explode would also filter by the size of the array, that is, scan every text twice.
    return scanned.select(*keys, F.explode_outer("findings").alias("f")).where("f IS NOT NULL").select(*keys, "f.*")


def detector_counts(found: DataFrame) -> DataFrame:
    """Findings per detector with a total row."""
    return found.rollup("detector").agg(F.count("*").alias("n")).select(F.coalesce("detector", F.lit("all")).alias("detector"), "n")


def gate(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """A document fails when it holds any finding; skipped files never fail."""
    return scanned.groupBy(*keys).agg(
        F.count("*").alias("documents"), F.sum(F.size("findings")).alias("findings"),
        F.bool_or(F.size("findings") > 0).alias("failed"),
    )


def native_counts(df: DataFrame, keys: list[str], text: str, names: tuple[str, ...] = dt.DEFAULT) -> DataFrame:
    """Raw match counts per detector, before overlaps are resolved."""
    return df.select(*keys, *[F.size(hits(F.col(text), dt.pattern(d), d.group, 0, d.reject, dt.marked(F.col(text), d))).alias(d.name) for d in dt.chosen(names)])


def scan_json(docs: DataFrame, key: str, json_text: str, names: tuple[str, ...] = dt.DEFAULT) -> DataFrame:
    """Findings of every JSON value (with key context) and key, with path, pointer, place and owner.

    ``owner`` is the nearest object around the value that carries ``redaction_state``. Text that is no JSON is scanned as it
    stands: its findings have the path ``$`` and the location ``text``. Depth, repeated keys and keys with dots don't matter.
    """
    found = scan(json_spans.tokens(docs, key, json_text), "text", F.col("name"), names).where(F.size("findings") > 0)
    return found.select(
        key, "path", "location", "redacted", F.transform("findings", lambda f: f["detector"]).alias("detectors"), "owner",
        F.when(F.col("state").isin(*UPGRADEABLE), "redacted").otherwise(F.col("state")).alias("owner_state"),
        "pointer", "start", "stop", "state", "state_start", "state_stop", "findings")


def rewrite_json(docs: DataFrame, key: str, json_text: str, names: tuple[str, ...] = dt.DEFAULT) -> DataFrame:
    """``docs`` with ``redacted``: hits inside values replaced, and the state of the object that owns them raised.

    All other characters of a document stay as they are; one without findings is returned unchanged. Text that is no JSON is
    rewritten as plain text. Keys are reported by ``scan_json`` and never rewritten. ``key`` names a document; of rows without it none is rewritten.
    """
    found = scan_json(docs, key, json_text, names)
    plain = found.where("location = 'text'").select(key, F.col("redacted").alias("_plain"))
    parts = F.transform("findings", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["at"].alias("at")))
    values = found.where("location = 'value'").select(key, F.struct("start", "stop", F.col("redacted").alias("new"), parts.alias("parts")).alias("_c"))
    raised = F.struct(F.col("state_start").alias("start"), F.col("state_stop").alias("stop"), F.lit("redacted").alias("new"), F.array().cast("array<struct<start:int,end:int,at:int>>").alias("parts"))
    states = found.where("location = 'value' AND owner_state = 'redacted' AND state_start IS NOT NULL").where(F.col("state") != "redacted").select(key, raised.alias("_c")).distinct()
    # The edits of one document, at most its own values.
    edits = values.unionByName(states).groupBy(key).agg(F.collect_list("_c").cast(json_spans.EDITS).alias("_edits"))
    met = docs.join(edits, key, "left").join(plain, key, "left")
    same = met.where("_edits IS NULL").withColumn("redacted", F.coalesce("_plain", json_text))
    new = met.where("_edits IS NOT NULL").withColumn("redacted", json_spans.splice(F.col(json_text), F.col("_edits")))
    return same.unionByName(new).drop("_edits", "_plain")


def redacted_fields(nodes: DataFrame, key: str, payload: str) -> DataFrame:
    """Top-level strings and list items of a payload that carry a redaction marker."""
    spark = nodes.sparkSession
    rows = nodes.where(F.col(payload).contains("[REDACTED")).select(F.col(key), F.try_parse_json(payload).alias("v"))
    top = spark.sql("SELECT t.{k}, x.key AS field, x.value AS v FROM {t} t, LATERAL variant_explode(t.v) x", t=rows, k=F.col(key))
    inner = spark.sql("SELECT t.{k}, t.field, x.value AS v FROM {t} t, LATERAL variant_explode(t.v) x WHERE x.key IS NULL", t=top, k=F.col(key))
    both = top.unionByName(inner).where(F.schema_of_variant("v") == "STRING")
    return both.select(key, "field", F.try_variant_get("v", "$", "string").alias("value")).where(F.col("value").contains("[REDACTED"))


def masked_excerpt(redacted: Column, window: int = WINDOW) -> Column:
    """the text around the first marker, or its beginning where there is none."""
    marker = F.when(F.contains(redacted, F.lit("[REDACTED:")), "[REDACTED:").when(F.contains(redacted, F.lit(dt.HOME_TEXT)), dt.HOME_TEXT)
    return F.when(marker.isNotNull(), excerpt(redacted, F.instr(redacted, marker) - 1, window)).otherwise(excerpt(redacted, F.lit(0), 2 * window))
