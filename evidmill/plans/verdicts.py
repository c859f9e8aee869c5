"""Queries: verdicts, retention, reports and checks (D, K, M, A14, A20, A28, A29, J16-J18, V12-V14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from evidmill.operators import graph, remote, report, retention, rollup, verdict, verify
from evidmill.plans.binding import Spine, with_spine
from evidmill.plans.rollups import COUNTED, _COUNT_COLS, _COUNT_JOINS
from evidmill.plans.verification import _VERDICTS, _pending, _verified

TARGET = "//b1:t"


def _logs(s: Spine):
    k = F.col("doc_id") % 10
    tail = (
        F.when(k == 0, "\nFATAL: bazel exited\n").when(k.isin(2, 3), f"\nFAIL: {TARGET} at /home/me/x\nnext\n")
        .when(k == 4, "\nan Error here").otherwise("")
    )
    return s.table("documents").select(
        (F.floor(F.col("doc_id") / 2) + 1).alias("run_group"),
        F.when(F.col("doc_id") % 2 == 0, verdict.LOG_NAMES[0]).otherwise(verdict.LOG_NAMES[1]).alias("log_name"),
        F.concat("text", tail).alias("text"))


def _classified(s: Spine):
    return verdict.classify_logs(_logs(s), "run_group", F.lit(TARGET))


def _verdicts(s: Spine):
    return verdict.verdicts(
        s.runs, s.failures, s.cache_events, [s.targets, s.changes, s.agent_blocks], _classified(s),
        verdict.failure_excerpts(_logs(s), "run_group"), _pending(s))


def _index(s: Spine):
    return rollup.run_group_index(s.runs)


def _tables(s: Spine):
    return {n: getattr(s, n) for n in COUNTED}


def _retained(s: Spine):
    return retention.report(retention.keep_last(_index(s), 700), s.runs, _tables(s), _dirs(s))


def _dirs(s: Spine):
    return s.table("documents").select((F.col("doc_id") % 1500).alias("run_group"), F.lit(1).alias("files"), F.col("n_chars").alias("bytes"))


def _ref_rows(s: Spine):
    return _verified(s).withColumn("redaction_state", F.lit("safe"))


def _labels(s: Spine):
    refs = _ref_rows(s)
    return report.block_labels(s.runs, {
        "scope": [], "invocations": [s.invocations], "cache": [s.cache_events], "cache_economics": [s.cache_events],
        "remote_execution": [graph.remote_configs(s.invocations)], "validation": [s.targets, s.actions, s.failures],
        "artifacts": [s.artifacts], "artifact_verification": [refs]})


def _facts(s: Spine):
    """One wide row per group with everything the reports need."""
    legs = rollup.cache_legs(s.timed_runs, s.invocations, s.cache_events)
    refs = _verified(s).join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")
    agents = rollup.packet_counts(s.runs, {"agent_blocks": s.agent_blocks}).drop("runs")
    return (
        rollup.packet_counts(s.runs, _tables(s)).join(rollup.cache_metrics(s.runs, s.cache_events), "run_group")
        .join(rollup.cold_warm(legs), "run_group", "left").join(rollup.presence_rollup(refs, ["run_group"]), "run_group", "left")
        .join(agents, "run_group").withColumn("block_failures", F.col("failures"))
    )


def _blocks(s: Spine):
    metrics = report.block_metrics(_facts(s), {
        "cache": ["hits", "misses", "unknown"], "validation": ["targets", "actions", "failures"], "artifacts": ["artifacts"]})
    return report.standard_blocks(_labels(s), metrics)


def _subjects(s: Spine):
    rows = verify.subjects(s.artifacts.withColumn("artifact_path", F.lit(None).cast("string")))
    return rows.join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")


def _attested(s: Spine):
    agents = s.agent_blocks.join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")
    return report.attestation_rows(_subjects(s), s.runs, rollup.packet_counts(s.runs, _tables(s)), agents)


def _envelopes(s: Spine):
    d = s.table("documents")
    body = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    env = d.select(F.col("doc_id").alias("key"),
                   F.when(F.col("doc_id") % 11 == 0, "%%").otherwise(F.base64(body.cast("binary"))).alias("payload"),
                   F.when(F.col("doc_id") % 5 == 0, F.sha2("lang", 256)).otherwise(F.sha2("text", 256)).alias("subject_sha256"))
    return report.envelope_check(env, d.select(F.col("doc_id").alias("key"), F.col("text").alias("statement")),
                                 d.select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("digest")))


def _surviving(s: Spine):
    """Rows of every table that stay."""
    left = retention.apply_plan(retention.keep_last(_index(s), 700), s.runs, _tables(s))
    parts = [df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in left.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


QUERIES = {
    "D1_log_classification": lambda s: _classified(s).select("run_group", "classification", "referenced", F.concat_ws("|", "matched_signatures").alias("signatures")),
    "D2_S4_L2_log_sections": lambda s: verdict.log_excerpts(_logs(s)).select("run_group", "log_name", "section"),
    "D2_failure_excerpts": lambda s: verdict.failure_excerpts(_logs(s), "run_group"),
    "D3_D4_verdicts": lambda s: _verdicts(s).select(
        "run_group", "status", "failure_count", "classification", "hits", "misses", "hit_rate", "pending_paths", "confidence", F.concat_ws(",", "next_steps").alias("next_steps")),
    "D5_exit_codes": lambda s: verdict.exit_codes(_verdicts(s)),
    "D7_verdict_blocks": lambda s: verdict.verdict_blocks(_verdicts(s), F.lit("2026-01-01T00:00:00Z")).select(
        "run_group", "stable_key", F.get_json_object("payload", "$.next_steps[0].action").alias("first_step")),
    "M3_verdict_lines": lambda s: verdict.one_line(_verdicts(s)).select("run_group", "line"),
    "K1_keep_last": lambda s: retention.keep_last(_index(s), 700).select("run_group", "disposition"),
    "K2_keep_days": lambda s: retention.keep_days(_index(s), 400, F.lit("2001-12-01 00:00:00").cast("timestamp")).select("run_group", "disposition"),
    "K3_U5_named_groups": lambda s: retention.named(_index(s), s.table("supplier").select(F.col("s_suppkey").alias("run_group"))).select("run_group", "disposition"),
    "K3_missing_names": lambda s: retention.missing_names(_index(s), s.table("part").select(F.col("p_partkey").alias("run_group"))),
    "K4_would_empty": lambda s: retention.would_empty(retention.keep_last(_index(s), 700)),
    "K4_outside_root": lambda s: retention.outside_root(
        retention.keep_last(_index(s), 700), s.table("documents").select(
            (F.col("doc_id") % 1500).alias("run_group"),
            F.concat(F.when(F.col("doc_id") % 3 == 0, "/other/").when(F.col("doc_id") % 3 == 1, "/ev/").otherwise("rel/"), "source").alias("path")), "/ev"),
    "K5_A23_J16_report": lambda s: _retained(s).select("run_group", "disposition", "run_count", "rows", "files", "bytes"),
    "K5_totals": lambda s: retention.totals(_retained(s)),
    "J17_survivors": lambda s: _surviving(s),
    "A14_blocks": lambda s: _blocks(s).drop("ordinal", "metrics"),
    "A14_block_metrics": lambda s: _blocks(s).where("metrics <> '{}'").select("run_group", "block_id", "metrics"),
    "A20_block_mix": lambda s: rollup.block_mix(_blocks(s), ["run_group"]),
    "A28_A29_review_summary": lambda s: report.review_summary(_facts(s)).drop("source_kind", "confidence", "redaction_state", "has_legs"),
    "M2_F10_review_text": lambda s: report.review_text(report.review_summary(_facts(s))),
    "M1_report_sections": lambda s: report.report_sections(_blocks(s), report.review_summary(_facts(s))).groupBy("section").agg(F.count("*").alias("n")),
    "M4_P7_attestation_rows": lambda s: _attested(s).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("sort_key").alias("keys")),
    "V14_empty_subjects": lambda s: report.empty_subjects(s.runs, _subjects(s)),
    "J18_envelopes": _envelopes,
    "V12_label_violations": lambda s: report.label_violations(s.runs, "id").select("id", F.concat_ws(",", "violations").alias("violations")),
    "V13_contract_violations": lambda s: report.contract_violations(
        rollup.cache_metrics(s.runs, s.cache_events).withColumn("misses", F.col("misses") - 5), "run_group", ["hit_rate"], ["hits", "misses"], ["hit_rate"]
    ).select("run_group", F.concat_ws(",", "violations").alias("violations")),
}

_LOG = f""" logs AS (SELECT doc_id // 2 + 1 AS run_group, CASE WHEN doc_id % 2 = 0 THEN 'bazel.stderr.txt' ELSE 'bazel.stdout.txt' END AS log_name,
  concat(text, CASE doc_id % 10 WHEN 0 THEN concat(chr(10), 'FATAL: bazel exited', chr(10)) WHEN 2 THEN concat(chr(10), 'FAIL: {TARGET} at /home/me/x', chr(10), 'next', chr(10))
   WHEN 3 THEN concat(chr(10), 'FAIL: {TARGET} at /home/me/x', chr(10), 'next', chr(10)) WHEN 4 THEN concat(chr(10), 'an Error here') ELSE '' END) AS text FROM documents)"""
_SIGS = "[" + ", ".join(f"'{x}'" for x in verdict.TOOLCHAIN_SIGNATURES) + "]"
_CLASS = f"""{_LOG}, sig AS (SELECT unnest({_SIGS}) AS x, generate_subscripts({_SIGS}, 1) AS o),
 hit AS (SELECT run_group, string_agg(x, '|' ORDER BY o) AS signatures FROM (SELECT DISTINCT run_group, x, o FROM logs JOIN sig ON contains(text, x)) z GROUP BY 1),
 cl AS (SELECT l.run_group, bool_or(contains(text, '{TARGET}')) AS referenced, coalesce(any_value(signatures), '') AS signatures,
  CASE WHEN any_value(signatures) IS NOT NULL THEN 'toolchain_failure' WHEN bool_or(contains(text, '{TARGET}')) THEN 'scenario_validation_failure' ELSE 'unattributed_failure' END AS classification
  FROM logs l LEFT JOIN hit ON hit.run_group = l.run_group GROUP BY 1)"""
_SECT = f"""{_LOG}, ln AS (SELECT run_group, log_name, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT run_group, log_name, string_split(text, chr(10)) AS l FROM logs) z),
 f AS (SELECT *, list_position(list_transform(l, lambda x: contains(x, 'FAIL') OR contains(x, 'Error') OR contains(x, 'error:')), true) AS first_line FROM ln),
 sect AS (SELECT run_group, log_name, concat('[artifact: ', log_name, ']', chr(10), regexp_replace(array_to_string(l[first_line:first_line + 79], chr(10)), '(/Users/[^\\s"'')(]+|/home/[^\\s"'')(]+|/private/var/[^\\s"'')(]*)', '<redacted-path>', 'g')) AS section FROM f WHERE first_line > 0)"""
_PEND = """ pn AS (SELECT doc_id % 50 AS run_group, source, sha256(text) AS a FROM documents WHERE doc_id % 13 <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id % 50, source ORDER BY doc_id DESC) = 1),
 pc AS (SELECT source, sha256(arg_max(text, doc_id)) AS b FROM documents GROUP BY 1), pend AS (SELECT run_group, count(*) AS pending_paths FROM pn JOIN pc USING (source) WHERE a <> b GROUP BY 1)"""
_VERD = f"""WITH {_CLASS}, {_SECT.split(', ln AS', 1)[0].replace(_LOG, 'zz AS (SELECT 1)')}, ln AS{_SECT.split(', ln AS', 1)[1]}, {_PEND},
 lab AS (SELECT run_group, r.confidence FROM runs r UNION ALL """ + " UNION ALL ".join(
    f"SELECT r.run_group, c.confidence FROM {t} c JOIN runs r ON r.id = c.run_id" for t in ("failures", "cache_events", "targets", "changes", "agent_blocks")) + """),
 conf AS (SELECT run_group, CASE WHEN bool_and(confidence = 'high') THEN 'high' WHEN bool_or(confidence = 'low') THEN 'low' ELSE 'medium' END AS confidence FROM lab GROUP BY 1),
 g AS (SELECT r.run_group, count(c.run_id) FILTER (WHERE hit) AS hits, count(c.run_id) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE hit) / CAST(nullif(count(*) FILTER (WHERE hit IS NOT NULL), 0) AS DOUBLE) AS hit_rate FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1),
 fc AS (SELECT run_group, count(f.id) AS failure_count FROM runs r LEFT JOIN failures f ON f.run_id = r.id GROUP BY 1),
 v AS (SELECT g.*, failure_count, CASE WHEN failure_count > 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN failure_count = 0 THEN 'first_pass_success' ELSE coalesce(classification, 'unclassified') END AS classification, conf.confidence,
  coalesce(pending_paths, 0) AS pending_paths, classification IS NOT NULL AS seen, g.run_group IN (SELECT run_group FROM sect) AS ex FROM g JOIN fc USING (run_group) JOIN conf USING (run_group) LEFT JOIN cl USING (run_group) LEFT JOIN pend USING (run_group)),
 verdicts AS (SELECT *, concat_ws(',', CASE WHEN classification = 'toolchain_failure' THEN 'record_environment_blocker' END, CASE WHEN pending_paths > 0 THEN 'rerun_validation' END,
  CASE WHEN status = 'failed' AND classification = 'scenario_validation_failure' AND ex THEN 'dispatch_fix_with_evidence' END,
  CASE WHEN status = 'failed' AND (NOT seen OR NOT ex OR classification = 'unattributed_failure') THEN 'attach_missing_evidence' END, CASE WHEN status = 'ok' THEN 'none_complete' END) AS next_steps FROM v)
"""
_VT = ("runs", "failures", "cache_events", "targets", "changes", "agent_blocks")
_IDX = "idx AS (SELECT run_group, count(*) AS run_count, min(started_at) AS a, max(started_at) AS l FROM runs GROUP BY 1)"
_KEEP = f"""{_IDX}, top AS (SELECT run_group FROM idx WHERE l IS NOT NULL ORDER BY l DESC, run_group LIMIT 700),
 plan AS (SELECT idx.*, CASE WHEN l IS NULL THEN 'unknown' WHEN run_group IN (SELECT run_group FROM top) THEN 'keep' ELSE 'delete' END AS disposition FROM idx)"""
_REP = f"""WITH {_KEEP}, x AS (SELECT * FROM plan), n AS (SELECT x.run_group, disposition, run_count, {_COUNT_COLS} FROM x{_COUNT_JOINS}),
 d AS (SELECT doc_id % 1500 AS run_group, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1),
 rep AS (SELECT n.run_group, disposition, run_count, run_count + {' + '.join(COUNTED)} AS rows, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes FROM n LEFT JOIN d USING (run_group))"""
_BLOCK_ROWS = {
    "invocations": "invocations", "cache": "cache_events", "cache_economics": "cache_events", "artifacts": "artifacts",
}
_STACK = "SELECT run_group, 'scope' AS block_id, source_kind, confidence, redaction_state FROM runs" + "".join(
    f" UNION ALL SELECT r.run_group, '{b}', c.source_kind, c.confidence, c.redaction_state FROM {t} c JOIN runs r ON r.id = c.run_id" for b, t in (
        *_BLOCK_ROWS.items(), ("validation", "targets"), ("validation", "actions"), ("validation", "failures"))) + (
    " UNION ALL SELECT r.run_group, 'remote_execution', c.source_kind, c.confidence, c.redaction_state FROM invocations c JOIN runs r ON r.id = c.run_id WHERE endpoint IS NOT NULL"
    " UNION ALL SELECT r.run_group, 'artifact_verification', CASE WHEN c.confidence = 'low' AND sk = 'collectable_v1' THEN 'derived_v1' ELSE sk END, c.confidence, 'safe' FROM w c JOIN runs r ON r.id = c.run_id")
_QUAD = """CASE WHEN count(s.block_id) = 0 THEN 'future' WHEN count(s.source_kind) = 0 THEN 'derived_v1' WHEN bool_or(s.source_kind = 'collectable_v1') THEN 'collectable_v1' WHEN bool_or(s.source_kind = 'derived_v1') THEN 'derived_v1'
   WHEN bool_or(s.source_kind = 'simulated_v1') THEN 'simulated_v1' ELSE 'future' END AS source_kind,
  CASE WHEN count(s.block_id) = 0 THEN 'unknown' WHEN bool_and(s.confidence = 'high') THEN 'high' WHEN bool_or(s.confidence = 'low') THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN count(s.block_id) = 0 THEN 'unknown' WHEN bool_and(s.redaction_state = 'safe') THEN 'safe' WHEN bool_or(s.redaction_state = 'blocked') THEN 'blocked' WHEN bool_or(s.redaction_state = 'redacted') THEN 'redacted' ELSE 'unknown' END AS redaction_state"""
_BLOCKS = _VERDICTS + f""", stack AS ({_STACK}), b AS (SELECT unnest({list(report.BLOCKS)}) AS block_id, unnest({list(report.BLOCKS.values())}) AS title),
 blocks AS (SELECT g.run_group, b.block_id, b.title, {_QUAD} FROM (SELECT DISTINCT run_group FROM runs) g CROSS JOIN b LEFT JOIN stack s ON s.run_group = g.run_group AND s.block_id = b.block_id GROUP BY 1, 2, 3)"""
_BT = ("runs", "invocations", "cache_events", "targets", "actions", "failures", "artifacts")

ORACLES = {
    "D1_log_classification": f"WITH {_CLASS} SELECT run_group, classification, referenced, signatures FROM cl",
    "D2_S4_L2_log_sections": f"WITH {_SECT} SELECT run_group, log_name, section FROM sect",
    "D3_D4_verdicts": with_spine(*_VT, body=_VERD + "SELECT run_group, status, failure_count, classification, hits, misses, hit_rate, pending_paths, confidence, next_steps FROM verdicts"),
    "D5_exit_codes": with_spine(*_VT, body=_VERD + "SELECT run_group, CASE WHEN split_part(next_steps, ',', 1) = 'none_complete' THEN 0 ELSE 1 END AS exit_code FROM verdicts"),
    "D7_verdict_blocks": with_spine(*_VT, body=_VERD + "SELECT run_group, concat('evaluation:', run_group) AS stable_key, split_part(next_steps, ',', 1) AS first_step FROM verdicts"),
    "M3_verdict_lines": with_spine(*_VT, body=_VERD + "SELECT run_group, concat('status=', status, ' · classification=', classification, ' · next=', split_part(next_steps, ',', 1)) AS line FROM verdicts"),
    "K1_keep_last": with_spine("runs", body=f"WITH {_KEEP} SELECT run_group, disposition FROM plan"),
    "K2_keep_days": with_spine("runs", body=f"WITH {_IDX} SELECT run_group, CASE WHEN l IS NULL THEN 'unknown' WHEN CAST(l AS TIMESTAMP) < TIMESTAMP '2001-12-01' - INTERVAL 400 DAY THEN 'delete' ELSE 'keep' END AS disposition FROM idx"),
    "K3_U5_named_groups": with_spine("runs", body=f"WITH {_IDX} SELECT run_group, CASE WHEN run_group IN (SELECT s_suppkey FROM supplier) THEN 'delete' ELSE 'keep' END AS disposition FROM idx"),
    "K3_missing_names": "SELECT p_partkey AS run_group FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)",
    "K4_would_empty": with_spine("runs", body=f"WITH {_KEEP} SELECT bool_or(disposition = 'delete') AND bool_and(disposition = 'delete') AS would_empty FROM plan"),
    "K4_outside_root": with_spine("runs", body=f"WITH {_KEEP} SELECT doc_id % 1500 AS run_group, count(*) AS stray_paths FROM documents WHERE doc_id % 3 = 0 AND doc_id % 1500 IN (SELECT run_group FROM plan WHERE disposition = 'delete') GROUP BY 1"),
    "K5_A23_J16_report": with_spine("runs", *COUNTED, body=_REP + " SELECT * FROM rep"),
    "K5_totals": with_spine("runs", *COUNTED, body=_REP + " SELECT disposition, count(*) AS groups, sum(run_count)::BIGINT AS runs, sum(rows)::BIGINT AS rows, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM rep GROUP BY 1"),
    "J17_survivors": with_spine("runs", *COUNTED, body=f"WITH {_KEEP}, left_runs AS (SELECT id FROM runs WHERE run_group NOT IN (SELECT run_group FROM plan WHERE disposition = 'delete'))" + " UNION ALL ".join(
        [" SELECT 'runs' AS part, count(*) AS n FROM left_runs", *[f" SELECT '{t}', count(*) FROM {t} c JOIN left_runs r ON r.id = c.run_id" for t in COUNTED]])),
    "A14_blocks": with_spine(*_BT, body=_BLOCKS + " SELECT * FROM blocks"),
    "A20_block_mix": with_spine(*_BT, body=_BLOCKS + """ SELECT run_group, count(*) AS total, count(*) FILTER (WHERE source_kind = 'collectable_v1') AS recorded, count(*) FILTER (WHERE source_kind = 'derived_v1') AS computed,
 count(*) FILTER (WHERE source_kind = 'simulated_v1') AS simulated, count(*) FILTER (WHERE source_kind = 'future') AS not_collected, 0 AS unknown FROM blocks GROUP BY 1"""),
    "A14_block_metrics": with_spine("runs", *COUNTED, body=f"""WITH x AS (SELECT run_group, count(*) AS runs FROM runs GROUP BY 1), n AS (SELECT x.run_group, {_COUNT_COLS} FROM x{_COUNT_JOINS}),
 c AS (SELECT run_group, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, count(*) FILTER (WHERE c.run_id IS NOT NULL AND hit IS NULL) AS unknown FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1)
 SELECT run_group, 'cache' AS block_id, concat('{{"hits":', hits, ',"misses":', misses, ',"unknown":', unknown, '}}') AS metrics FROM c
 UNION ALL SELECT run_group, 'validation', concat('{{"actions":', actions, ',"failures":', failures, ',"targets":', targets, '}}') FROM n UNION ALL SELECT run_group, 'artifacts', concat('{{"artifacts":', artifacts, '}}') FROM n"""),
    "M1_report_sections": f"SELECT section, (SELECT count(DISTINCT o_custkey) FROM orders) AS n FROM (SELECT unnest({['summary', *report.BLOCKS]}) AS section)",
    "M4_P7_attestation_rows": with_spine("runs", "artifacts", "agent_blocks", body="""SELECT '0-proof' AS part, count(DISTINCT run_group) AS n, 1 AS keys FROM runs UNION ALL SELECT '1-subject', count(*), count(DISTINCT a.artifact_key) FROM artifacts a JOIN runs r ON r.id = a.run_id
 UNION ALL SELECT '2-run', count(*), count(*) FROM runs UNION ALL SELECT '3-agent', count(*), count(*) FROM agent_blocks a JOIN runs r ON r.id = a.run_id"""),
    "V14_empty_subjects": with_spine("runs", "artifacts", body="SELECT DISTINCT run_group FROM runs WHERE run_group NOT IN (SELECT r.run_group FROM artifacts a JOIN runs r ON r.id = a.run_id)"),
    "J18_envelopes": """SELECT doc_id AS key, doc_id % 11 <> 0 AS decodes, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS identical, doc_id % 5 <> 0 AS subject_recorded FROM documents""",
    "V12_label_violations": with_spine("runs", body="SELECT id, 'source_kind' AS violations FROM runs WHERE source_kind IS NULL"),
    "V13_contract_violations": with_spine("runs", "cache_events", body="""WITH c AS (SELECT run_group, count(*) FILTER (WHERE hit) AS h, count(*) FILTER (WHERE NOT hit) AS m FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1)
 SELECT run_group, concat_ws(',', CASE WHEN h + m = 0 THEN 'hit_rate: required' END, CASE WHEN m < 5 THEN 'misses: negative' END) AS violations FROM c WHERE m < 5 OR h + m = 0"""),
}
