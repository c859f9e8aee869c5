"""Queries: artifact verification, change evidence, manifests (V, J7-J11, A15, A31, F1, F5, F14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import digests
from evidmill.operators import rollup, verify
from evidmill.plans.binding import Spine, with_spine


def _references(s: Spine):
    d = s.table("documents").withColumn("h", F.sha2("text", 256)).withColumn("k", F.col("doc_id") % 10)
    n = F.col("n_chars").cast("string")
    blob = lambda inst: F.concat(F.lit(f"bytestream://cas/{inst}/blobs/"), F.col("h"), F.lit("/"), n)
    k = F.col("k")
    uri = (
        F.when(k <= 3, F.concat(F.lit("file:///ev/"), F.col("source"), F.lit("/f%20"), F.col("doc_id").cast("string"), F.lit(".txt")))
        .when(k == 4, F.concat(F.lit("out/f"), F.col("doc_id").cast("string")))
        .when(k == 5, F.concat(F.lit("/gone/f"), F.col("doc_id").cast("string")))
        .when(k == 6, blob("main")).when(k == 7, blob("main"))
        .when(k == 8, F.when(F.col("doc_id") % 20 == 8, blob("other")).otherwise(F.lit("https://x/y")))
    )
    inline = (k == 9) & (F.col("doc_id") % 20 == 9)
    return d.select(
        "doc_id", (F.col("doc_id") % 100).alias("run_id"), F.concat(F.lit("ref:"), F.col("doc_id").cast("string")).alias("reference_key"),
        uri.alias("uri"),
        F.when((k == 9) & ~inline, F.concat(F.lit("out/f"), (F.col("doc_id") - 5).cast("string"))).alias("symlink_target"),
        F.when(inline, F.when(F.col("doc_id") % 3 == 0, "***").otherwise(F.base64(F.col("text").cast("binary")))).alias("contents"),
        F.when(k == 1, F.sha2(F.concat("text", F.lit("x")), 256)).when(k == 2, None).when(k == 3, F.left("h", F.lit(40)))
        .when(k == 4, F.concat(F.lit("SHA-256:"), F.upper("h"))).otherwise(F.col("h")).alias("declared_digest"),
        F.lit("/work").alias("base"),
        F.when((F.col("doc_id") % 100) % 9 == 0, "blake3").alias("fn_name"),
        (((F.col("doc_id") % 100) % 9 == 0) | (F.col("doc_id") % 2 == 0)).alias("options_seen"),
        F.when(F.col("doc_id") % 11 == 0, "simulated_v1").otherwise("collectable_v1").alias("source_kind"),
    )


def _inventory(s: Spine):
    d = s.table("documents").where("doc_id % 10 < 5")
    path = F.when(F.col("doc_id") % 10 == 4, F.concat(F.lit("/work/out/f"), F.col("doc_id").cast("string"))).otherwise(
        F.concat(F.lit("/ev/"), F.col("source"), F.lit("/f "), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(path.alias("path"), F.sha2("text", 256).alias("sha256"))


def _store(s: Spine):
    d = s.table("documents").where("doc_id % 10 IN (6, 7)")
    k20 = F.col("doc_id") % 20
    return d.select(
        F.lit("main").alias("instance"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"),
        F.when(k20 == 17, False).otherwise(True).alias("present"),
        F.when(k20 == 6, F.sha2("text", 256)).when(k20 == 7, F.sha2(F.concat("text", F.lit("z")), 256)).alias("computed_digest"),
        "doc_id")


def _store_unique(s: Spine):
    """Copies of a text share a blob: the first document's facts hold."""
    return _store(s).groupBy("instance", "hash", "size").agg(
        F.min_by(F.struct("present", "computed_digest"), "doc_id").alias("f")).select(
        "instance", "hash", "size", "f.present", "f.computed_digest")


def _verified(s: Spine):
    return verify.verify_references(_references(s), _inventory(s), _store_unique(s))


def _baselines(s: Spine):
    c = s.changes
    d = F.split("id", ":")[1].cast("bigint")
    claims = c.where(d % 2 == 0).select(
        "run_id", "path", F.concat(F.lit("c"), (d % 5).cast("string")).alias("commit"), F.col("path").alias("object_path"),
        F.when(d % 8 == 0, None).otherwise(F.coalesce("before_hash", F.lit("0" * 64))).alias("baseline_sha256"))
    objects = c.where(d % 3 > 0).select(
        F.concat(F.lit("c"), (d % 5).cast("string")).alias("commit"), F.col("path").alias("object_path"),
        F.when(d % 16 == 2, F.sha2("path", 256)).otherwise(F.col("before_hash")).alias("object_sha256")).where("object_sha256 IS NOT NULL")
    commits = c.where(d % 5 < 4).select(F.concat(F.lit("c"), (d % 5).cast("string")).alias("commit"))
    return verify.verify_baselines(claims, objects, commits)


def _evidence(s: Spine):
    return verify.change_evidence(s.changes.select("run_id", "path", "before_hash", "after_hash"), _baselines(s))


def _pending(s: Spine):
    d = s.table("documents")
    changes = d.select(
        (F.col("doc_id") % 50).alias("run_group"),
        F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("../f"), F.col("source"))).otherwise(F.concat(F.lit("src/"), F.col("source"))).alias("path"),
        F.sha2("text", 256).alias("after_hash"), F.col("doc_id").alias("created_at"), F.col("doc_id").alias("id"))
    current = d.groupBy(F.concat(F.lit("src/"), F.col("source")).alias("path")).agg(F.sha2(F.max_by("text", "doc_id"), 256).alias("sha256"))
    return verify.pending_edits(changes, current)


def _manifest(s: Spine):
    entries = s.lineitem.select(
        (F.col("l_suppkey") % 10).alias("root"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("artifact_key"),
        "l_returnflag", "l_linestatus")
    return verify.manifest_conflicts(entries, ["root", "artifact_key"], ["l_returnflag", "l_linestatus"])


QUERIES = {
    "V1_V2_V3_V4_J7_J8_verdicts": lambda s: _verified(s).drop("note_key"),
    "V1_local_only": lambda s: verify.verify_references(_references(s), _inventory(s)).groupBy("presence", "confidence").agg(F.count("*").alias("n")),
    "A15_presence_rollup": lambda s: rollup.presence_rollup(_verified(s), ["run_id"]),
    "A31_V5_probe_outcomes": lambda s: verify.probe_outcomes(_references(s), _store_unique(s), ["run_id"]),
    "V7_J10_baselines": lambda s: _baselines(s).groupBy("baseline_state").agg(F.count("*").alias("n")),
    "V6_J9_change_evidence": lambda s: _evidence(s).select("run_id", "path", "changed", "changed_basis", "baseline_sha256"),
    "V6_patch_applied": lambda s: verify.patch_applied(_evidence(s)),
    "V8_J11_pending_edits": _pending,
    "V9_manifest_conflicts": _manifest,
    "P6_P5_subjects": lambda s: verify.subjects(s.artifacts.withColumn("artifact_path", F.lit(None).cast("string")).withColumn(
        "sha256", F.when(F.length("sha256") > 0, F.when(F.col("run_id") % 5 == 0, F.left("sha256", F.lit(40))).otherwise(F.upper("sha256"))))).select("name", "digest"),
    "F1_stable_ids": lambda s: s.runs.select("id", digests.stable_id("runs", F.col("stable_key")).alias("stable_id")),
    "F2_text_hashes": lambda s: s.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256")),
    "F5_digest_shapes": lambda s: _references(s).select(
        "reference_key", digests.digest_prefix(F.col("declared_digest")).alias("prefix"), digests.digest_body(F.col("declared_digest")).alias("body")),
    "F14_baseline_refs": lambda s: s.changes.select("id", verify.baseline_ref(
        F.concat(F.lit("git:HEAD:"), F.col("path")), F.substring("after_hash", 1, 10)).alias("ref")),
}

_REFS = """
 refs AS (SELECT doc_id, doc_id % 100 AS run_id, concat('ref:', doc_id) AS reference_key, doc_id % 10 AS k, n_chars, sha256(text) AS h, text, source,
  CASE doc_id % 10 WHEN 1 THEN sha256(concat(text, 'x')) WHEN 2 THEN NULL WHEN 3 THEN left(sha256(text), 40) WHEN 4 THEN concat('SHA-256:', upper(sha256(text))) ELSE sha256(text) END AS declared_digest,
  (doc_id % 100) % 9 = 0 AS other_fn, CASE WHEN doc_id % 11 = 0 THEN 'simulated_v1' ELSE 'collectable_v1' END AS sk FROM documents),
 store AS (SELECT h, n_chars, arg_min(present, doc_id) AS present, arg_min(coalesce(computed, ''), doc_id) AS computed FROM (SELECT sha256(text) AS h, n_chars, doc_id, doc_id % 20 <> 17 AS present,
   CASE doc_id % 20 WHEN 6 THEN sha256(text) WHEN 7 THEN sha256(concat(text, 'z')) END AS computed FROM documents WHERE doc_id % 10 IN (6, 7)) x GROUP BY 1, 2)
"""
_VERDICTS = f"""WITH {_REFS},
 r AS (SELECT refs.*, present, nullif(computed, '') AS computed FROM refs LEFT JOIN store ON store.h = refs.h AND store.n_chars = refs.n_chars AND k IN (6, 7)),
 v AS (SELECT *,
  CASE WHEN k = 9 THEN CASE WHEN doc_id % 20 = 9 THEN CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN other_fn THEN 'local_present' ELSE 'local_verified' END ELSE 'local_present' END
   WHEN k = 5 THEN 'missing' WHEN k = 2 THEN 'local_verified' WHEN k < 5 AND other_fn THEN 'local_present' WHEN k = 3 THEN 'local_present' WHEN k = 1 THEN 'local_mismatch' WHEN k < 5 THEN 'local_verified'
   WHEN k = 8 THEN 'unverified_remote_reference' WHEN NOT present THEN 'remote_missing' WHEN computed IS NULL OR other_fn THEN 'remote_present' WHEN computed = h THEN 'remote_verified' ELSE 'remote_mismatch' END AS presence,
  CASE WHEN k = 9 THEN CASE WHEN doc_id % 20 = 9 AND doc_id % 3 > 0 THEN h END WHEN k = 2 THEN h WHEN k < 5 AND NOT other_fn AND k <> 3 THEN h WHEN k IN (6, 7) AND present THEN computed END AS computed_digest,
  CASE WHEN k <= 3 THEN concat('/ev/', source, '/f ', doc_id, '.txt') WHEN k = 4 THEN concat('/work/out/f', doc_id) WHEN k = 5 THEN concat('/gone/f', doc_id) WHEN k = 9 AND doc_id % 20 <> 9 THEN concat('/work/out/f', doc_id - 5) END AS local_path,
  CASE WHEN k <= 3 THEN concat('file:///ev/', source, '/f%20', doc_id, '.txt') WHEN k = 4 THEN concat('out/f', doc_id) WHEN k = 5 THEN concat('/gone/f', doc_id) WHEN k IN (6, 7) THEN concat('bytestream://cas/main/blobs/', h, '/', n_chars)
   WHEN k = 8 THEN CASE WHEN doc_id % 20 = 8 THEN concat('bytestream://cas/other/blobs/', h, '/', n_chars) ELSE 'https://x/y' END END AS uri FROM r),
 w AS (SELECT *, CASE WHEN presence IN ('local_mismatch', 'remote_mismatch') THEN false WHEN presence = 'remote_verified' THEN true WHEN presence = 'local_verified' AND k <> 2 THEN true END AS digest_verified,
  CASE WHEN presence IN ('missing', 'local_mismatch', 'remote_mismatch', 'remote_missing', 'unverified_remote_reference') THEN 'low' WHEN presence IN ('local_present', 'remote_present') OR k = 2 THEN 'medium' ELSE 'high' END AS confidence FROM v)
"""
_LOCAL = f"""WITH {_REFS}, v AS (SELECT CASE WHEN k = 9 THEN CASE WHEN doc_id % 20 = 9 THEN CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN other_fn THEN 'local_present' ELSE 'local_verified' END ELSE 'local_present' END
   WHEN k = 5 THEN 'missing' WHEN k = 2 THEN 'local_verified' WHEN k < 5 AND other_fn THEN 'local_present' WHEN k = 3 THEN 'local_present' WHEN k = 1 THEN 'local_mismatch' WHEN k < 5 THEN 'local_verified' ELSE 'unverified_remote_reference' END AS presence, k FROM refs)
 SELECT presence, CASE WHEN presence IN ('missing', 'local_mismatch', 'unverified_remote_reference') THEN 'low' WHEN presence = 'local_present' OR k = 2 THEN 'medium' ELSE 'high' END AS confidence, count(*) AS n FROM v GROUP BY ALL"""
_BASE = """
 d AS (SELECT *, CAST(split_part(id, ':', 2) AS BIGINT) AS d FROM changes),
 o AS (SELECT d, CASE WHEN d % 16 = 2 THEN sha256(path) ELSE before_hash END AS have FROM d WHERE d % 3 > 0),
 b AS (SELECT d.run_id, d.path, d.d, CASE WHEN d.d % 8 = 0 THEN NULL ELSE coalesce(before_hash, repeat('0', 64)) END AS want, have FROM d LEFT JOIN o ON o.d = d.d WHERE d.d % 2 = 0),
 base AS (SELECT *, CASE WHEN d % 5 = 4 THEN 'unverifiable' WHEN have IS NOT NULL THEN CASE WHEN want = have THEN 'verified' ELSE 'mismatch' END WHEN want IS NULL THEN 'verified' ELSE 'unverifiable' END AS baseline_state FROM b),
 ev AS (SELECT d.run_id, d.path, CASE WHEN baseline_state = 'verified' THEN want IS DISTINCT FROM after_hash ELSE before_hash IS DISTINCT FROM after_hash END AS changed,
  CASE WHEN baseline_state = 'verified' THEN 'git_baseline' ELSE 'recorder_window' END AS changed_basis, CASE WHEN baseline_state = 'verified' THEN want END AS baseline_sha256
  FROM d LEFT JOIN base ON base.d = d.d)
"""

ORACLES = {
    "V1_V2_V3_V4_J7_J8_verdicts": _VERDICTS + """SELECT run_id, reference_key, uri, local_path, declared_digest, presence, digest_verified, computed_digest,
 CASE WHEN confidence = 'low' AND sk = 'collectable_v1' THEN 'derived_v1' ELSE sk END AS source_kind, confidence FROM w""",
    "V1_local_only": _LOCAL,
    "A15_presence_rollup": _VERDICTS + "SELECT run_id, count(*) AS total, " + ", ".join(
        f"count(*) FILTER (WHERE presence = '{p}') AS {n}" for p, n in rollup.PRESENCE_COUNTERS.items()) + " FROM w GROUP BY 1",
    "A31_V5_probe_outcomes": f"""WITH {_REFS}, r AS (SELECT refs.*, present, nullif(computed, '') AS computed, CASE WHEN k = 8 AND doc_id % 20 <> 8 THEN true ELSE false END AS bad FROM refs LEFT JOIN store ON store.h = refs.h AND store.n_chars = refs.n_chars AND k IN (6, 7) WHERE k IN (6, 7, 8))
 SELECT run_id, count(*) AS probed, count(*) FILTER (WHERE bad) AS unsupported, count(*) FILTER (WHERE NOT present) AS missing, count(*) FILTER (WHERE present AND computed IS NOT NULL) AS hashed,
 0 AS present_not_read, count(*) FILTER (WHERE NOT bad AND (present IS NULL OR (present AND computed IS NULL))) AS inconclusive FROM r GROUP BY 1""",
    "V7_J10_baselines": with_spine("changes", body=f"WITH {_BASE} SELECT baseline_state, count(*) AS n FROM base GROUP BY 1"),
    "V6_J9_change_evidence": with_spine("changes", body=f"WITH {_BASE} SELECT * FROM ev"),
    "V6_patch_applied": with_spine("changes", body=f"WITH {_BASE} SELECT run_id, bool_or(changed) AS patch_applied, count(*) AS paths FROM ev GROUP BY 1"),
    "V8_J11_pending_edits": """WITH n AS (SELECT doc_id % 50 AS run_group, concat('src/', source) AS path, sha256(text) AS after_hash FROM documents WHERE doc_id % 13 <> 0
 QUALIFY row_number() OVER (PARTITION BY doc_id % 50, source ORDER BY doc_id DESC) = 1), c AS (SELECT concat('src/', source) AS path, sha256(arg_max(text, doc_id)) AS sha256 FROM documents GROUP BY 1)
 SELECT run_group, path, after_hash, sha256 FROM n JOIN c USING (path) WHERE sha256 <> after_hash""",
    "V9_manifest_conflicts": """SELECT l_suppkey % 10 AS root, concat('part/', l_partkey) AS artifact_key, count(*) AS writes, count(DISTINCT concat(l_returnflag, l_linestatus)) > 1 AS conflict, false AS illegal_key FROM lineitem GROUP BY ALL""",
    "P6_P5_subjects": with_spine("artifacts", body="SELECT artifact_key AS name, sha256 AS digest FROM artifacts WHERE run_id % 5 <> 0"),
    "F1_stable_ids": with_spine("runs", body="""SELECT id, concat('runs_', left(sha256(concat('["runs","', stable_key, '"]')), 24)) AS stable_id FROM runs"""),
    "F2_text_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "F5_digest_shapes": f"WITH {_REFS} SELECT reference_key, CASE WHEN k = 4 THEN 'sha256' END AS prefix, CASE WHEN k = 4 THEN h ELSE declared_digest END AS body FROM refs",
    "F14_baseline_refs": with_spine("changes", body="SELECT id, CASE WHEN after_hash IS NOT NULL THEN concat('git:', left(after_hash, 10), ':', path) END AS ref FROM changes"),
}
