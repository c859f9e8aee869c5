"""Artifact integrity, change evidence and manifest checks (V family, J7-J11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions.digests import digest_body, recomputable
from evidmill.functions.endpoints import parse_blob_uri
from evidmill.operators.grouping import latest
from evidmill.session import broadcast_if_small

# Schemes whose bytes are remote.
REMOTE_SCHEMES = ("bytestream", "grpc", "grpcs", "http", "https", "remote", "actioncache")

NOTES = {
    "missing": "declared local file is not on disk",
    "self_attested": "hashed; no digest was declared",
    "function": "present; the build used another digest function",
    "shape": "present; the declared digest is not a SHA-256",
    "match": "recomputed SHA-256 equals the declared digest",
    "mismatch": "recomputed SHA-256 differs from the declared digest",
    "mismatch_unsure": "recomputed SHA-256 differs; the digest function of the build is not known",
    "link_open": "link target cannot be resolved",
    "link": "link target exists; links carry no digest",
    "link_missing": "link target is not on disk",
    "inline_bad": "inline bytes are not valid base64",
    "remote_open": "remote reference without a verdict",
    "remote_missing": "the store does not hold the blob",
    "remote_match": "store bytes hash to the declared digest",
    "remote_mismatch": "store bytes differ from the declared digest",
    "remote_present": "the store holds the blob; bytes not checked",
}


# The verdict ladder, first match wins:
# (condition, presence, digest verified, computed digest from, note, confidence).
# Low confidence also takes the collectable label away.
_STEPS = (
    ("shape = 'link' AND local_path IS NULL", "", "", "", "link_open", "low"),
    ("shape = 'link' AND on_disk", "local_present", "", "", "link", "medium"),
    ("shape = 'link'", "missing", "", "", "link_missing", "low"),
    ("shape = 'inline' AND _inline IS NULL", "missing", "", "", "inline_bad", "low"),
    ("shape = 'inline' AND declared_digest IS NULL", "local_verified", "", "inline", "self_attested", "medium"),
    ("shape = 'inline' AND NOT _ok", "local_present", "", "inline", "shape", "medium"),
    ("shape = 'inline' AND _inline = _want", "local_verified", "yes", "inline", "match", "high"),
    ("shape = 'inline'", "local_mismatch", "no", "inline", "mismatch", "low"),
    ("local_path IS NOT NULL AND NOT on_disk", "missing", "", "", "missing", "low"),
    ("local_path IS NOT NULL AND declared_digest IS NULL", "local_verified", "", "disk", "self_attested", "medium"),
    ("local_path IS NOT NULL AND _other_fn", "local_present", "", "", "function", "medium"),
    ("local_path IS NOT NULL AND NOT _ok", "local_present", "", "", "shape", "medium"),
    ("local_path IS NOT NULL AND lower(disk_sha) = _want", "local_verified", "yes", "disk", "match", "high"),
    ("local_path IS NOT NULL AND options_seen", "local_mismatch", "no", "disk", "mismatch", "low"),
    ("local_path IS NOT NULL", "local_mismatch", "no", "disk", "mismatch_unsure", "low"),
    ("present IS NULL", "unverified_remote_reference", "", "", "remote_open", "low"),
    ("NOT present", "remote_missing", "", "", "remote_missing", "low"),
    ("blob_sha IS NULL OR declared_digest IS NULL OR NOT _ok", "remote_present", "", "blob", "remote_present", "medium"),
    ("lower(blob_sha) = _want", "remote_verified", "yes", "blob", "remote_match", "high"),
    ("true", "remote_mismatch", "no", "blob", "remote_mismatch", "low"),
)


def resolve_path(uri: Column, base: Column) -> Column:
    """V2: local path of a URI; NULL for remote and unknown schemes."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    inner = F.regexp_extract(uri, r"^(?i:file):(?://[^/?#]*)?([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))), inner)
    absolute = lambda p: F.when(p.startswith("/") | base.isNull(), p).otherwise(F.concat(base, F.lit("/"), p))
    return F.when(scheme == "file", absolute(decoded)).when(scheme == "", absolute(uri))


def downgraded(kind: Column) -> Column:
    return F.when(kind == "collectable_v1", "derived_v1").otherwise(kind)


def skip_reason(declared: Column, compressed: Column, size: Column, limit: int | None = None) -> Column:
    """V5: why the bytes of a present blob are not read; ``limit`` is a size from which on a caller leaves blobs alone."""
    plain = recomputable(declared, F.lit(None).cast("string"), F.lit(False))
    return (
        F.when(declared.isNull(), "no_digest")
        .when(compressed, "compressed")
        .when(~plain, "not_sha256")
        .when(size > limit if limit is not None else F.lit(False), "over_limit")
    )


def verify_references(
    refs: DataFrame, inventory: DataFrame, store: DataFrame | None = None, read_limit: int | None = None
) -> DataFrame:
    """A presence verdict for every reference.

    ``refs``: run_id, reference_key, uri, symlink_target, contents, declared_digest,
    base, fn_name, options_seen, source_kind. ``inventory``: path, sha256.
    ``store`` (X3): instance, hash, size, present, computed_digest; a row whose
    ``present`` is NULL is inconclusive. Rows without a local path or blob address
    skip the join concerned, so a NULL key never piles up in one task.
    """
    is_link = F.col("uri").isNull() & F.col("symlink_target").isNotNull() & F.col("contents").isNull()
    is_inline = F.col("uri").isNull() & F.col("contents").isNotNull() & F.col("symlink_target").isNull()
    link = F.col("symlink_target")
    link_path = F.when(link.startswith("/"), link).when(F.col("base").isNotNull(), F.concat("base", F.lit("/"), link))
    placed = refs.withColumn("shape", F.when(is_link, "link").when(is_inline, "inline").otherwise("file")).withColumn(
        "local_path",
        F.when(is_link, F.coalesce(link_path)).when(is_inline, None).otherwise(resolve_path(F.col("uri"), F.col("base"))),
    )
    blank = lambda df: df.withColumn("disk_sha", F.lit(None).cast("string")).withColumn("on_disk", F.lit(False))
    disk = broadcast_if_small(inventory.select(
        F.col("path").alias("local_path"), F.col("sha256").alias("disk_sha"), F.lit(True).alias("on_disk")
    ))
    local = placed.where("local_path IS NOT NULL").join(disk, "local_path", "left").withColumn(
        "on_disk", F.coalesce("on_disk", F.lit(False))
    )
    rest = blank(placed.where("local_path IS NULL"))
    if store is None:
        rest = rest.withColumn("present", F.lit(None).cast("boolean")).withColumn("blob_sha", F.lit(None).cast("string"))
    else:
        rest = _join_store(rest, store, read_limit)
    local = local.withColumn("present", F.lit(None).cast("boolean")).withColumn("blob_sha", F.lit(None).cast("string"))
    rows = local.unionByName(rest)

    # Costly parts once, in their own projection, so the ladder stays small.
    raw = F.try_to_binary("contents", F.lit("base64"))
    rows = rows.withColumns({
        "_want": digest_body(F.col("declared_digest")),
        "_ok": recomputable(F.col("declared_digest"), F.col("fn_name"), F.col("options_seen")),
        "_other_fn": F.coalesce(F.col("options_seen") & (F.col("fn_name") != "sha256"), F.lit(False)),
        "_inline": F.sha2(raw, 256),
    })
    at = F.lit(None).cast("int")
    for number, (cond, *_) in reversed(list(enumerate(_STEPS, 1))):
        at = F.when(F.expr(cond), F.lit(number)).otherwise(at)
    rows = rows.withColumn("_step", at)
    pick = lambda slot: F.try_element_at(F.lit([step[slot] for step in _STEPS]), F.col("_step"))
    source = pick(3)
    computed = F.when(source == "inline", F.col("_inline")).when(source == "disk", F.col("disk_sha")).when(
        source == "blob", F.col("blob_sha"))
    low = pick(5) == "low"
    verified = pick(2)
    return rows.select(
        "run_id", "reference_key", "uri",
        F.when(F.col("shape") == "link", F.coalesce("local_path", "symlink_target")).otherwise(F.col("local_path")).alias("local_path"),
        "declared_digest", F.nullif(pick(1), F.lit("")).alias("presence"),
        F.when(verified == "yes", True).when(verified == "no", False).alias("digest_verified"),
        computed.alias("computed_digest"), pick(4).alias("note_key"),
        F.when(low, downgraded(F.col("source_kind"))).otherwise(F.col("source_kind")).alias("source_kind"),
        pick(5).alias("confidence"),
    )


def with_notes(verdicts: DataFrame) -> DataFrame:
    """The verdict rows with the note in words."""
    names = F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])
    return verdicts.withColumn("verification_note", names[F.col("note_key")]).drop("note_key")


def _join_store(rest: DataFrame, store: DataFrame, read_limit: int) -> DataFrame:
    """Remote references with what the store inventory says about their blob."""
    addressed = rest.withColumn("_b", parse_blob_uri(F.col("uri"))).withColumn("_hash", F.col("_b.hash"))
    known = store.where("present IS NOT NULL").select(
        F.col("instance").alias("_instance"), F.lower("hash").alias("_hash"), F.col("size").alias("_size"),
        "present", F.col("computed_digest").alias("blob_sha"),
    )
    yes = addressed.where("_hash IS NOT NULL").withColumn("_instance", F.col("_b.instance")).withColumn("_size", F.col("_b.size"))
    why = skip_reason(F.col("declared_digest"), F.col("_b.compressed"), F.col("_b.size"), read_limit)
    joined = yes.join(known, ["_instance", "_hash", "_size"], "left").withColumn(
        "blob_sha", F.when(why.isNull(), F.col("blob_sha"))
    ).drop("_instance", "_size")
    no = addressed.where("_hash IS NULL").withColumn("present", F.lit(None).cast("boolean")).withColumn(
        "blob_sha", F.lit(None).cast("string")
    )
    return joined.unionByName(no).drop("_b", "_hash")


def probe_outcomes(refs: DataFrame, store: DataFrame, keys: list[str], read_limit: int | None = None) -> DataFrame:
    """What asking the store for each remote reference came to."""
    asked = refs.where("uri IS NOT NULL").where(resolve_path(F.col("uri"), F.lit("/")).isNull())
    rows = asked.withColumn("_b", parse_blob_uri(F.col("uri")))
    known = store.select(
        F.col("instance").alias("_i"), F.lower("hash").alias("_h"), F.col("size").alias("_s"), "present", "computed_digest"
    )
    cond = (F.col("_b.instance") == F.col("_i")) & (F.col("_b.hash") == F.col("_h")) & (F.col("_b.size") == F.col("_s"))
    # Unparseable addresses are counted without entering the join.
    good = rows.where("_b IS NOT NULL").join(known, cond, "left")
    bad = rows.where("_b IS NULL").withColumn("present", F.lit(None).cast("boolean")).withColumn("computed_digest", F.lit(None).cast("string"))
    cols = [*keys, "_b", "declared_digest", "present", "computed_digest"]
    every = good.select(*cols).unionByName(bad.select(*cols))
    why = skip_reason(F.col("declared_digest"), F.col("_b.compressed"), F.col("_b.size"), read_limit)
    there = F.coalesce("present", F.lit(False)) & F.col("_b").isNotNull()
    return every.groupBy(*keys).agg(
        F.count("*").alias("probed"),
        F.count_if(F.col("_b").isNull()).alias("unsupported"),
        F.count_if(F.col("_b").isNotNull() & ~F.col("present")).alias("missing"),
        F.count_if(there & why.isNull() & F.col("computed_digest").isNotNull()).alias("hashed"),
        F.count_if(there & why.isNotNull()).alias("present_not_read"),
        F.count_if(F.col("_b").isNotNull() & (F.col("present").isNull() | (there & why.isNull() & F.col("computed_digest").isNull()))).alias("inconclusive"),
    )


def verify_baselines(claims: DataFrame, objects: DataFrame, commits: DataFrame) -> DataFrame:
    """Claimed pre-edit hashes against the object inventory.

    ``claims``: run_id, path, commit, object_path, baseline_sha256. ``objects``:
    commit, object_path, object_sha256. ``commits``: commit. A claim of absence
    holds when the commit is known and has no such path.
    """
    known = commits.select("commit").distinct().withColumn("known", F.lit(True))
    rows = claims.join(objects, ["commit", "object_path"], "left").join(broadcast_if_small(known), "commit", "left")
    want, have = F.col("baseline_sha256"), F.col("object_sha256")
    state = (
        F.when(F.col("commit").isNull() | F.col("object_path").isNull() | F.col("known").isNull(), "unverifiable")
        .when(have.isNotNull(), F.when(want == have, "verified").otherwise("mismatch"))
        .when(want.isNull(), "verified")
        .otherwise("unverifiable")
    )
    return rows.select("run_id", "path", "commit", "baseline_sha256", state.alias("baseline_state"))


def change_evidence(paths: DataFrame, baselines: DataFrame, window_basis: str = "recorder_window") -> DataFrame:
    """Whether each path changed, against what, and what to note.

    ``paths``: run_id, path, before_hash, after_hash; ``baselines`` from V7.
    """
    rows = paths.join(baselines, ["run_id", "path"], "left")
    before, after, base = F.col("before_hash"), F.col("after_hash"), F.col("baseline_sha256")
    pinned = F.coalesce(F.col("baseline_state") == "verified", F.lit(False))
    refused = F.col("baseline_state").isin("mismatch", "unverifiable")
    changed = F.when(pinned, ~base.eqNullSafe(after)).otherwise(~before.eqNullSafe(after))
    note = (
        F.when(pinned, F.when(base == after, F.concat(F.lit("equal to baseline "), F.coalesce("commit", F.lit("unknown commit")))))
        .when(refused, F.concat(F.lit("baseline "), F.col("baseline_state")))
        .when(before.isNull() & after.isNull(), "never on disk")
        .when(before == after, "unchanged inside the recorded window")
    )
    return rows.select(
        "run_id", "path", "before_hash", "after_hash", F.when(pinned, base).alias("baseline_sha256"), changed.alias("changed"),
        F.when(pinned, "git_baseline").otherwise(window_basis).alias("changed_basis"), note.alias("note"),
    )


def patch_applied(evidence: DataFrame) -> DataFrame:
    """V6: per run, whether any path changed."""
    return evidence.groupBy("run_id").agg(F.bool_or("changed").alias("patch_applied"), F.count("*").alias("paths"))


def baseline_ref(ref: Column, commit: Column) -> Column:
    """``git:<commit>:<path>`` for a ``git:<label>:<path>`` reference."""
    path = F.regexp_extract(ref, r"^git:[^:]*:(.*)$", 1)
    return F.when(commit.isNull() | (commit == ""), None).when(path != "", F.concat_ws(":", F.lit("git"), commit, path)).otherwise(ref)


def escapes_root(path: Column) -> Column:
    return path.rlike(r"^/|(^|/)\.\.(/|$)")


def pending_edits(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose bytes differ from the newest recorded after-hash."""
    known = changes.where("after_hash IS NOT NULL AND after_hash <> '' AND path IS NOT NULL AND path <> ''")
    newest = latest(
        known.select("run_group", "path", "after_hash", "created_at", "id"), ["run_group", "path"],
        [F.col("created_at"), F.col("id")],
    )
    return newest.where(~escapes_root(F.col("path"))).join(current.select("path", "sha256"), "path").where(
        "sha256 <> after_hash"
    ).select("run_group", "path", "after_hash", "sha256")


def manifest_conflicts(entries: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """V9: one row per (root, key): writes, conflict flag, and whether the key is legal."""
    facts = F.struct(*compared)
    out = entries.groupBy(*keys).agg(F.count("*").alias("writes"), F.min(facts).alias("_lo"), F.max(facts).alias("_hi"))
    return out.select(
        *keys, "writes", (~F.col("_lo").eqNullSafe(F.col("_hi"))).alias("conflict"), escapes_root(F.col(keys[-1])).alias("illegal_key"))


def subjects(artifacts: DataFrame) -> DataFrame:
    """Attestation subjects: rows with a 64-hex hash, lower-cased, named by path or key."""
    ok = F.col("sha256").rlike("^[0-9a-fA-F]{64}$")
    name = F.coalesce(F.nullif("artifact_path", F.lit("")), F.nullif("artifact_key", F.lit("")), F.lit(""))
    return artifacts.where(ok).withColumn("name", name).withColumn("digest", F.lower("sha256"))
