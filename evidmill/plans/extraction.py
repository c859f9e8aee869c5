"""Queries: extraction from raw evidence and agent receipts (E, V10, V11, J12, J13, A16, A19, A24, A26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.operators import extract, receipts, rollup, verify
from evidmill.plans import evidence
from evidmill.plans.binding import Spine, with_spine
from evidmill.plans.evidence import LABEL, LINE_AT


def _calls(s: Spine):
    a = receipts.normalize_a(evidence.agent_results_a(s)).withColumn("cli_name", F.lit("claude"))
    b = receipts.normalize_b(evidence.agent_results_b(s)).withColumn("cli_name", F.lit("gemini"))
    c = receipts.normalize_c(evidence.agent_events_c(s)).withColumn("cli_name", F.lit("codex"))
    every = a.unionByName(b).unionByName(c)
    prompts = s.agent_blocks.select(F.col("run_id").alias("call_id"), "prompt_sha256")
    status = receipts.call_status(F.lit(True), F.col("is_error"), F.lit(0), F.col("api_error_status"), F.col("api_error_code"))
    return every.join(prompts, "call_id").withColumns({
        "status": status, "cli_name": F.when(F.col("call_id") % 13 == 0, "stub.sh").otherwise(F.col("cli_name")),
        "cli_version": F.lit("1.0"), "requested_model": F.lit("m-a"), "captured_at": F.lit("2026-01-01T00:00:00Z"),
        "command": F.array(F.lit("agent"), F.lit("--json"))})


def _receipts(s: Spine):
    return receipts.build_receipts(_calls(s))


def _call_view(df):
    return df.select("call_id", F.sha2(F.coalesce("response_text", F.lit("-")), 256).alias("response"), F.concat_ws(",", "models").alias("models"), "session_id",
                     "input_tokens", "output_tokens", "cache_read_tokens", "num_turns", "result_subtype", "api_error_status", "api_error_code", "is_error")


def _blocks(s: Spine):
    side = s.agent_blocks.select("run_id", F.col("run_id").alias("call_id"), F.lit("helper").alias("agent_name"),
                                 F.lit("m-op").alias("operator_model"), F.lit("sc").alias("scenario"), "prompt_sha256")
    applied = verify.patch_applied(verify.change_evidence(
        s.changes.select("run_id", "path", "before_hash", "after_hash"),
        s.changes.select("run_id", "path", F.lit(None).cast("string").alias("commit"), F.lit(None).cast("string").alias("baseline_sha256"),
                         F.lit(None).cast("string").alias("baseline_state"))))
    summaries = receipts.receipt_summary(_receipts(s)).where("call_id % 4 > 0")
    return receipts.provenance_blocks(side, summaries, applied)


def _results(s: Spine):
    return s.invocations.select(
        "run_id", "id", "exit_code", F.when(F.col("run_id") % 17 == 0, "timeout").when(F.col("run_id") % 19 == 0, "environment_blocker").otherwise("completed").alias("status"),
        F.lit(None).cast("string").alias("detail"))


def _configs(s: Spine):
    o = s.table("orders")
    k = F.col("o_orderkey") % 6
    doc = F.concat(
        F.lit('{"schedulers":['), F.when(k == 1, "").otherwise('{"name":"MAIN"}'), F.lit('],"workers":['),
        F.when(k == 2, "").otherwise("{}"), F.lit('],"servers":[{"services":{"cas":{},"ac":{},"execution":{}}},{"services":{"capabilities":{}'),
        F.when(k == 3, "").otherwise(',"worker_api":{}'), F.lit("}}]}"))
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.parse_json(doc).alias("config"), F.lit(None).cast("string").alias("config_error"),
        F.lit(1).alias("expected_workers"), F.when(k == 4, "preflight").otherwise("ports").alias("phase"),
        (F.col("o_orderkey") % 5 > 0).alias("public_open"), (F.col("o_orderkey") % 4 > 0).alias("worker_open"))


def _tool_blocks(s: Spine):
    """Distinct versions per group; versions of a group are few, the rows many."""
    facts = extract.extract_build_facts(evidence.build_events(s)).where("tool_version IS NOT NULL")
    return facts.join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id").groupBy("run_group", "tool_version").agg(
        F.min("run_id").alias("first_run"))


def _bundles(s: Spine):
    """All five lists of an ingest."""
    events = evidence.build_events(s)
    return rollup.bundle_counts({
        "targets": extract.extract_targets(events), "actions": extract.extract_actions(events), "failures": extract.extract_failures(events),
        "artifact_references": extract.extract_references(events), "cache_events": extract.extract_cache_events(evidence.parsed(evidence.exec_lines(s)))})


def _forbidden(s: Spine):
    doc = F.to_json(F.struct(
        F.struct(F.array(F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).alias("prompt"), F.lit(1).alias("n"))).alias("items")).alias("outer"),
        F.when(F.col("turn") == 3, F.lit("x")).alias("raw_prompt"), F.col("role").alias("kind")))
    docs = s.table("conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), doc.alias("json"))
    return receipts.forbidden_keys(docs, "doc", "json")


QUERIES = {
    "E1_E2_targets": lambda s: extract.extract_targets(evidence.build_events(s)),
    "E3_actions": lambda s: extract.extract_actions(evidence.build_events(s)),
    "E4_failures": lambda s: extract.extract_failures(evidence.build_events(s)).drop("event_index"),
    "E5_F6_references": lambda s: extract.extract_references(evidence.build_events(s)).select(
        "run_id", "reference_key", "uri", "contents", "declared_digest", "declared_size"),
    "E6_E7_S2_cache_events": lambda s: extract.extract_cache_events(evidence.parsed(evidence.exec_lines(s))).drop("event_index"),
    "A24_bundle_lists": lambda s: _bundles(s),
    "A24_bundle_counts": lambda s: extract.extract_cache_events(evidence.parsed(evidence.exec_lines(s))).groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_distinct("event_key").alias("keys")),
    "E8_profile_events": lambda s: extract.extract_profile_events(evidence.parsed(evidence.trace_lines(s))).drop("event_index"),
    "E9_E10_E11_F3_build_facts": lambda s: extract.extract_build_facts(evidence.build_events(s)).drop("fn_raw"),
    "A16_tool_versions": _tool_blocks,
    "E12_worker_lines": lambda s: extract.extract_workers(s.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("line_no"),
        F.concat(F.lit("x worker W"), F.col("l_suppkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " STARTED ").otherwise(" "),
                 F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("worker_name=W"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).cast("string"))).otherwise("")).alias("line")),
        ["l_orderkey", "l_linenumber", "l_partkey"]),
    "E13_calls_family_a": lambda s: _call_view(receipts.normalize_a(evidence.agent_results_a(s))),
    "E14_A26_calls_family_b": lambda s: _call_view(receipts.normalize_b(evidence.agent_results_b(s))),
    "E15_E16_calls_family_c": lambda s: _call_view(receipts.normalize_c(evidence.agent_events_c(s))),
    "E17_E18_receipts": lambda s: _receipts(s).select("call_id", "status", "detail", "live", "model_resolved", "source_kind", "confidence",
                                                      F.size("evidence_refs").alias("refs")),
    "E19_receipt_summary": lambda s: receipts.receipt_summary(_receipts(s)).select("call_id", "receipt_sha256", "live"),
    "V11_receipt_violations": lambda s: receipts.violations(_receipts(s).withColumn(
        "prompt_sha256", F.when(F.col("call_id") % 6 == 0, F.left("prompt_sha256", F.lit(12))).otherwise(F.col("prompt_sha256")))).select(
        "call_id", F.concat_ws(",", "violations").alias("violations")),
    "E20_E27_provenance_blocks": lambda s: _blocks(s).select("run_id", "model", "provenance_class", "patch_applied", "source_kind", "confidence", F.size("evidence_refs").alias("refs")),
    "A19_provenance_counts": lambda s: s.agent_blocks.join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id").groupBy(
        "run_group", "provenance_class").agg(F.count("*").alias("n")),
    "J12_imported_receipts": lambda s: receipts.import_receipts(
        receipts.receipt_summary(_receipts(s)), s.agent_blocks.select(F.col("run_id").alias("call_id"), (F.col("run_id") % 37 + 1).alias("run_group")), s.runs
    ).select("run_id", "run_group", "call_id", "provenance_class"),
    "J13_run_key_conflicts": lambda s: receipts.run_key_conflicts(
        s.runs.select("stable_key", F.when(F.col("id") % 9 == 0, F.col("run_group") + 1).otherwise(F.col("run_group")).alias("run_group")), s.runs),
    "V10_forbidden_keys": _forbidden,
    "E24_readiness": lambda s: extract.readiness(_configs(s)).select("run_id", "status", "configured_workers", F.concat_ws("; ", "reasons").alias("reasons")),
    "E26_identity_blocks": lambda s: extract.worker_blocks(s.worker_events).unionByName(
        extract.readiness_blocks(extract.readiness(_configs(s)))).groupBy("block_kind").agg(F.count("*").alias("n")),
    "E28_terminal_status": lambda s: extract.terminal_status(_results(s)),
    "E28_command_failures": lambda s: extract.command_failures(_results(s)).select("run_id", "command", "message"),
    "E25_first_code_block": lambda s: s.table("documents").select(
        "doc_id", F.concat(F.lit("intro\n```python\n"), F.col("text"), F.lit("\n```\nmore ```\nx```")).alias("r")).select(
        "doc_id", F.sha2(extract.first_code_block(F.col("r")), 256).alias("code")),
}

_E = f"""WITH e AS (SELECT l_orderkey AS run_id, {LINE_AT} AS evt, {LABEL} AS label, l_linenumber AS ln, l_partkey, l_suppkey, l_quantity, l_returnflag AS rf, l_linestatus AS ls FROM lineitem)"""
_MSG = "CASE WHEN ls = 'F' THEN concat('part ', l_partkey) ELSE concat(label, ' completed unsuccessfully') END"
_FAM_A = """ a AS (SELECT run_id AS call_id, response, turns, run_id % 5 > 0 AS has_session, run_id % 4 = 0 AS two, run_id % 11 = 0 AS is_error, CASE WHEN run_id % 22 = 0 THEN 529 END AS st
 FROM agent_blocks JOIN resp ON conv_id = run_id WHERE run_id % 3 = 0) """
_RESP = " resp AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response FROM conversations GROUP BY 1) "
_FAM_B = """ b AS (SELECT run_id AS call_id, response, turns AS t, run_id % 4 = 0 AS two, CASE run_id % 10 WHEN 0 THEN 429 END AS st, CASE run_id % 10 WHEN 1 THEN 'PERMISSION_DENIED' END AS sc, run_id % 10 < 2 AS is_error
 FROM agent_blocks JOIN resp ON conv_id = run_id WHERE run_id % 3 = 1) """
_FAM_C = """ c AS (SELECT conv_id AS call_id, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response, (sum(greatest(length(text) - turn * 50, 0)) FILTER (WHERE role = 'assistant'))::BIGINT AS net,
  (sum(turn) FILTER (WHERE role = 'assistant'))::BIGINT AS out, (sum(turn * 50) FILTER (WHERE role = 'assistant'))::BIGINT AS cached, nullif(count(*) FILTER (WHERE role = 'assistant'), 0) AS turns,
  conv_id % 5 = 0 AND bool_or(turn = 1) AS bad FROM conversations WHERE conv_id % 3 = 2 GROUP BY conv_id) """
_VIEW_A = """SELECT call_id, sha256(coalesce(response, '-')) AS response, CASE WHEN two THEN 'm-a,m-b' ELSE 'm-a' END AS models, CASE WHEN has_session THEN concat('s', call_id) END AS session_id,
 turns * 10 AS input_tokens, turns AS output_tokens, CAST(NULL AS BIGINT) AS cache_read_tokens, turns AS num_turns, NULL AS result_subtype, st AS api_error_status, NULL AS api_error_code, is_error FROM a"""
_VIEW_B = """SELECT call_id, sha256(coalesce(response, '-')) AS response, CASE WHEN two THEN 'g-1,g-2' ELSE 'g-1' END AS models, concat('s', call_id) AS session_id,
 t * 70 AS input_tokens, CASE WHEN two THEN t * 3 ELSE t END AS output_tokens, CASE WHEN two THEN t * 35 ELSE t * 30 END AS cache_read_tokens, CAST(NULL AS BIGINT) AS num_turns,
 CASE WHEN st = 429 THEN 'ApiError' ELSE sc END AS result_subtype, st AS api_error_status, sc AS api_error_code, is_error FROM b"""
_VIEW_C = """SELECT call_id, sha256(coalesce(response, '-')) AS response, CASE WHEN call_id % 2 = 0 THEN 'x-1' ELSE '' END AS models, concat('t', call_id) AS session_id, net AS input_tokens, out AS output_tokens,
 cached AS cache_read_tokens, turns AS num_turns, CASE WHEN bad THEN 'invalid_request_error' END AS result_subtype, CASE WHEN bad THEN 400 END AS api_error_status, NULL AS api_error_code, coalesce(bad, false) AS is_error FROM c"""
_RCPT = f"""WITH {_RESP}, {_FAM_A}, {_FAM_B}, {_FAM_C}, every AS (SELECT 'claude' AS cli, response AS raw, v.* FROM ({_VIEW_A.replace('sha256(coalesce(response, ' + "'-'" + ')) AS response', 'response')}) v UNION ALL SELECT 'gemini', response, v.* FROM ({_VIEW_B.replace('sha256(coalesce(response, ' + "'-'" + ')) AS response', 'response')}) v
  UNION ALL SELECT 'codex', response, v.* FROM ({_VIEW_C.replace('sha256(coalesce(response, ' + "'-'" + ')) AS response', 'response')}) v),
 st AS (SELECT e.* EXCLUDE (cli), CASE WHEN call_id % 13 = 0 THEN 'stub.sh' ELSE cli END AS cli, CASE WHEN is_error AND (api_error_status IS NOT NULL OR api_error_code IS NOT NULL) THEN 'api_error' WHEN is_error THEN 'cli_error' ELSE 'success' END AS s0,
   CASE WHEN models <> '' AND strpos(models, ',') = 0 THEN models END AS model_resolved, b.prompt_sha256 FROM every e JOIN agent_blocks b ON b.run_id = e.call_id),
 r0 AS (SELECT *, concat_ws(', ', CASE WHEN raw IS NULL THEN 'response' END, CASE WHEN model_resolved IS NULL THEN 'model.resolved' END, CASE WHEN session_id IS NULL THEN 'session_id' END) AS miss FROM st),
 r AS (SELECT *, CASE WHEN s0 = 'success' AND miss <> '' THEN 'invalid_output' ELSE s0 END AS status, CASE WHEN s0 = 'success' AND miss <> '' THEN concat('missing: ', miss) END AS detail,
   cli <> 'stub.sh' AND s0 = 'success' AND miss = '' AS live FROM r0)
"""
_RT = ("runs", "agent_blocks")

ORACLES = {
    "E1_E2_targets": _E + """, x AS (SELECT run_id, label, evt + 1 AS i, concat('kind ', ln) AS kind, NULL AS hard, 'CONFIGURED' AS soft FROM e WHERE ln % 2 = 1
 UNION ALL SELECT run_id, label, evt + 3, NULL, CASE WHEN l_quantity < 25 THEN 'PASSED' ELSE 'FLAKY' END, NULL FROM e WHERE ln % 3 = 0
 UNION ALL SELECT run_id, label, evt + 4, NULL, CASE WHEN rf = 'R' THEN 'FAILED' END, CASE WHEN rf = 'A' THEN 'PASSED' END FROM e)
 SELECT run_id, label, arg_max(kind, i) FILTER (WHERE kind IS NOT NULL) AS target_kind, coalesce(arg_max(hard, i) FILTER (WHERE hard IS NOT NULL), CASE WHEN bool_or(soft = 'PASSED') THEN 'PASSED' WHEN bool_or(soft = 'CONFIGURED') THEN 'CONFIGURED' END) AS status FROM x GROUP BY 1, 2""",
    "E3_actions": _E + """, x AS (SELECT run_id, label, evt + 2 AS i, concat(label, ':action:out/', l_suppkey % 4) AS action_key, concat('M', ln) AS mnemonic, CASE rf WHEN 'A' THEN 'SUCCESS' WHEN 'R' THEN 'FAILED' END AS status FROM e
 UNION ALL SELECT run_id, label, evt + 3, concat(label, ':test:run=', ln, ':shard=1:attempt=1'), 'BazelTest', CASE WHEN l_quantity < 25 THEN 'PASSED' ELSE 'FLAKY' END FROM e WHERE ln % 3 = 0)
 SELECT run_id, action_key, label AS target_label, mnemonic, status FROM x QUALIFY row_number() OVER (PARTITION BY run_id, action_key ORDER BY i DESC) = 1""",
    "E4_failures": _E + f""" SELECT run_id, concat(label, ':target_completed:', evt + 4) AS failure_key, 'target_completed' AS failure_kind, {_MSG} AS message FROM e WHERE rf = 'R'
 UNION ALL SELECT o_orderkey, 'build_finished:4000000000000:BUILD_FAILURE', 'build_finished', 'Bazel finished with BUILD_FAILURE (exit code 1)' FROM orders WHERE o_orderstatus = 'P'""",
    "E5_F6_references": _E + """, x AS (SELECT run_id, evt + 3 AS i, concat(label, ':artifact:test.log') AS reference_key, concat('file:///ev/', l_suppkey) AS uri, NULL AS contents, sha256(CAST(l_partkey AS STRING)) AS declared_digest, l_partkey AS declared_size FROM e WHERE ln % 3 = 0
 UNION ALL SELECT run_id, evt + 4, concat(label, ':artifact:inline.txt'), NULL, 'YWJj', NULL, NULL FROM e WHERE ln = 6)
 SELECT * EXCLUDE (i) FROM x QUALIFY row_number() OVER (PARTITION BY run_id, reference_key ORDER BY i) = 1""",
    "E6_E7_S2_cache_events": _E + """, x AS (SELECT *, CASE ln % 3 WHEN 0 THEN concat_ws('/', concat('h', l_partkey % 5), nullif(l_suppkey, 0)) WHEN 1 THEN concat('d', l_partkey % 5) END AS digest FROM e)
 SELECT run_id, concat(label, ':M', ln % 2, ':', coalesce(digest, CAST(evt AS STRING))) AS event_key, CASE rf WHEN 'A' THEN 'remote_cache_hit' WHEN 'R' THEN 'cache_miss' ELSE 'action_cache_observed' END AS event_kind,
 CASE rf WHEN 'A' THEN true WHEN 'R' THEN false END AS hit, digest, label AS target_label, CASE rf WHEN 'N' THEN 'derived_v1' ELSE 'collectable_v1' END AS source_kind, CASE rf WHEN 'N' THEN 'low' ELSE 'high' END AS confidence FROM x""",
    "A24_bundle_counts": _E + """, x AS (SELECT run_id, concat(label, ':M', ln % 2, ':', CASE ln % 3 WHEN 0 THEN concat_ws('/', concat('h', l_partkey % 5), nullif(l_suppkey, 0)) WHEN 1 THEN concat('d', l_partkey % 5) ELSE CAST(evt AS STRING) END) AS k FROM e)
 SELECT run_id, count(*) AS events, count(DISTINCT k) AS keys FROM x GROUP BY 1""",
    "E8_profile_events": _E + """ SELECT run_id, concat('profile:', label, ':Action:', l_suppkey) AS event_key, CASE rf WHEN 'A' THEN 'remote_cache_hit' ELSE 'action_cache_observed' END AS event_kind, CASE rf WHEN 'A' THEN true END AS hit,
 NULL AS digest, label AS target_label, 'derived_v1' AS source_kind, CASE rf WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence FROM e WHERE ln < 6""",
    "E9_E10_E11_F3_build_facts": """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate + CASE WHEN o_orderkey % 4 = 1 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 SECOND END, '%Y-%m-%dT%H:%M:%S.%fZ') END AS started_at,
 CASE WHEN o_orderkey % 3 > 0 THEN concat(6 + o_orderkey % 5, '.4.1') END AS tool_version, o_orderkey % 7 < 3 AS options_seen, CASE o_orderkey % 7 WHEN 0 THEN 'sha256' WHEN 1 THEN 'blake3' END AS fn_name,
 o_orderkey % 3 > 0 AND 6 + o_orderkey % 5 NOT IN (7, 9) AS version_out_of_range FROM orders""",
    "A16_tool_versions": """SELECT o_custkey AS run_group, concat(6 + o_orderkey % 5, '.4.1') AS tool_version, min(o_orderkey) AS first_run FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2""",
    "E12_worker_lines": """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS line_no, concat('W', l_suppkey) AS a, concat('W', l_suppkey + l_linenumber % 2) AS b FROM lineitem)
 SELECT l_orderkey, l_linenumber, l_partkey, line_no, a AS worker_name FROM x WHERE l_linenumber % 2 = 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, line_no, b FROM x WHERE l_linenumber % 3 = 0 AND NOT (l_linenumber % 2 = 0 AND a = b)""",
    "E13_calls_family_a": with_spine("agent_blocks", body=f"WITH {_RESP}, {_FAM_A} {_VIEW_A}"),
    "E14_A26_calls_family_b": with_spine("agent_blocks", body=f"WITH {_RESP}, {_FAM_B} {_VIEW_B}"),
    "E15_E16_calls_family_c": f"WITH {_FAM_C} {_VIEW_C}",
    "E17_E18_receipts": with_spine(*_RT, body=_RCPT + """SELECT call_id, status, detail, live, model_resolved, CASE WHEN live OR status <> 'success' THEN 'collectable_v1' ELSE 'simulated_v1' END AS source_kind,
 CASE WHEN live OR status <> 'success' THEN 'high' ELSE 'medium' END AS confidence, 2 + CASE WHEN raw IS NULL THEN 0 ELSE 1 END + CASE WHEN session_id IS NULL THEN 0 ELSE 1 END AS refs FROM r"""),
    "V11_receipt_violations": with_spine(*_RT, body=_RCPT + "SELECT call_id, CASE WHEN call_id % 6 = 0 THEN 'prompt_sha256' ELSE '' END AS violations FROM r"),
    "E20_E27_provenance_blocks": with_spine(*_RT, "changes", body=_RCPT + """, ap AS (SELECT run_id, bool_or(before_hash IS DISTINCT FROM after_hash) AS patch FROM changes GROUP BY 1)
 SELECT b.run_id, CASE WHEN b.run_id % 4 > 0 AND r.live THEN r.model_resolved ELSE 'm-op' END AS model, CASE WHEN b.run_id % 4 = 0 OR r.call_id IS NULL THEN 'operator_asserted_v1' WHEN r.live THEN 'receipt_verified_v1' ELSE 'stub_receipt_v1' END AS provenance_class,
 coalesce(patch, false) AS patch_applied, CASE WHEN b.run_id % 4 > 0 AND NOT r.live THEN 'simulated_v1' ELSE 'collectable_v1' END AS source_kind, CASE WHEN b.run_id % 4 > 0 AND NOT r.live THEN 'medium' ELSE 'high' END AS confidence,
 4 + CASE WHEN b.run_id % 4 > 0 THEN 2 + CASE WHEN session_id IS NULL THEN 0 ELSE 1 END ELSE 0 END AS refs FROM agent_blocks b LEFT JOIN r ON r.call_id = b.run_id LEFT JOIN ap ON ap.run_id = b.run_id"""),
    "A19_provenance_counts": with_spine(*_RT, body="SELECT run_group, provenance_class, count(*) AS n FROM agent_blocks b JOIN runs r ON r.id = b.run_id GROUP BY ALL"),
    "J12_imported_receipts": with_spine(*_RT, body="""WITH l AS (SELECT run_group, id FROM runs QUALIFY row_number() OVER (PARTITION BY run_group ORDER BY started_at DESC NULLS LAST, created_at DESC, id DESC) = 1)
 SELECT l.id AS run_id, l.run_group, b.run_id AS call_id, 'receipt_imported_v1' AS provenance_class FROM agent_blocks b JOIN l ON l.run_group = b.run_id % 37 + 1"""),
    "J13_run_key_conflicts": with_spine("runs", body="SELECT stable_key, run_group + 1 AS run_group, run_group AS known_group FROM runs WHERE id % 9 = 0"),
    "V10_forbidden_keys": """SELECT conv_id * 100 + turn AS doc, '$.outer.items[0].prompt' AS path, 'prompt' AS name FROM conversations WHERE turn % 2 = 0
 UNION ALL SELECT conv_id * 100 + turn, '$.raw_prompt', 'raw_prompt' FROM conversations WHERE turn = 3""",
    "E24_readiness": """WITH x AS (SELECT o_orderkey AS run_id, o_orderkey % 6 AS k, o_orderkey % 5 > 0 AS p, o_orderkey % 4 > 0 AS w FROM orders)
 SELECT run_id, CASE WHEN k IN (1, 2, 3) THEN 'configuration_blocker' WHEN k = 4 THEN 'configuration_ready' WHEN p AND w THEN 'worker_endpoints_ready' ELSE 'endpoint_blocker' END AS status, CASE WHEN k = 2 THEN 0 ELSE 1 END AS configured_workers,
 CASE k WHEN 1 THEN 'missing scheduler' WHEN 2 THEN 'configured worker count 0 below expected 1' WHEN 3 THEN 'missing services: worker_api' WHEN 4 THEN '' ELSE concat_ws('; ', CASE WHEN NOT p THEN 'public endpoint port did not open' END, CASE WHEN NOT w THEN 'worker API endpoint port did not open' END) END AS reasons FROM x""",
    "E26_identity_blocks": with_spine("worker_events", body="SELECT 'worker_admin_identity_v1' AS block_kind, count(DISTINCT run_id) AS n FROM worker_events UNION ALL SELECT 'worker_readiness_boundary', count(*) FROM orders"),
    "E28_terminal_status": with_spine("invocations", body="""SELECT run_id, CASE WHEN run_id % 17 = 0 THEN 'timeout' WHEN run_id % 19 = 0 THEN 'environment_blocker' WHEN bool_or(exit_code <> 0) THEN 'failed' ELSE 'completed' END AS status FROM invocations GROUP BY 1"""),
    "E28_command_failures": with_spine("invocations", body="SELECT run_id, id AS command, 'command exited with code 1' AS message FROM invocations WHERE exit_code = 1"),
    "E25_first_code_block": "SELECT doc_id, sha256(concat(text, chr(10))) AS code FROM documents",
}

ORACLES["A24_bundle_lists"] = " UNION ALL ".join(
    f"SELECT run_id, '{name}' AS list, count(*) AS n FROM ({ORACLES[query]}) {name} GROUP BY 1"
    for name, query in (("targets", "E1_E2_targets"), ("actions", "E3_actions"), ("failures", "E4_failures"), ("artifact_references", "E5_F6_references"), ("cache_events", "E6_E7_S2_cache_events")))
