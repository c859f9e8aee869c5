"""Queries: action graph, attribution, partition, remote boundary (G, A17-A22, A27, E21-E23, P3, P9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import endpoints
from evidmill.operators import graph, remote, rollup
from evidmill.plans.binding import Spine, with_spine

TABLES = ("runs", "agent_blocks", "changes", "invocations", "worker_events", "artifacts", "targets", "actions",
          "cache_events", "failures")


def _graph(s: Spine):
    return graph.build_graph({n: getattr(s, n) for n in TABLES})


def _override(s: Spine, nodes):
    """Every third artifact names an invocation of the order with its number."""
    inv = s.invocations.groupBy("run_id").agg(F.min("id").alias("inv"))
    refs = s.artifacts.where("run_id % 3 = 0").join(inv, "run_id").select(
        "id", F.array(F.lit("x:y"), F.concat(F.lit("invocation:"), F.col("inv"))).alias("evidence_refs"))
    return graph.producing_invocations(refs, nodes)


def _parents(s: Spine):
    nodes, edges = _graph(s)
    nodes = graph.settled_ids(nodes)
    return nodes, graph.parents(nodes, edges, _override(s, nodes))


def _attributed(s: Spine):
    return graph.run_attribution(*_parents(s))


def _partition(s: Spine):
    nodes, parent = _parents(s)
    opened = s.runs.where("id % 4 = 0").select(F.concat(F.lit("run:"), F.col("id").cast("string")).alias("id"))
    return graph.card_partition(nodes, parent, opened)


def _node_groups(s: Spine):
    nodes, _ = _graph(s)
    return nodes.join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")


def _lens(s: Spine):
    counts = rollup.packet_counts(s.runs, {"invocations": s.invocations}).drop("runs")
    return remote.run_join("remote_lens", {
        "node_counts": counts, "remote_metrics": remote.remote_metrics(s.runs, s.invocations, s.worker_events)})


def _blob_uris(s: Spine):
    """Blob addresses in all the recorded shapes, from the document table."""
    d = s.table("documents").withColumn("h", F.sha2("text", 256))
    n = F.col("n_chars").cast("string")
    uri = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("bytestream://cas.example:8980/blobs/"), F.upper("h"), F.lit("/"), n))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("bytestream://cas/team%20a/main/blobs/"), F.col("h"), F.lit("/"), n))
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("bytestream://cas/main/compressed-blobs/zstd/"), F.col("h"), F.lit("/"), n))
        .when(F.col("doc_id") % 6 == 3, F.concat(F.lit("bytestream://cas/uploads/1/blobs/"), F.col("h"), F.lit("/"), n))
        .when(F.col("doc_id") % 6 == 4, F.concat(F.lit("https://cas/blobs/"), F.col("h"), F.lit("/"), n))
        .otherwise(F.concat(F.lit("bytestream://cas/main/blobs/"), F.col("source"), F.lit("/"), n))
    )
    return d.select("doc_id", endpoints.parse_blob_uri(uri).alias("b")).select("doc_id", "b.*")


QUERIES = {
    "G1_nodes": lambda s: _graph(s)[0].select("id", "run_id", "kind", "label", "status", "source_kind", "confidence", "redaction_state"),
    "G2_edges": lambda s: _graph(s)[1].select("id", F.col("from").alias("from_id"), F.col("to").alias("to_id"), "kind"),
    "P2_node_payloads": lambda s: _graph(s)[0].where("kind IN ('run', 'invocation')").select(
        "id", F.get_json_object("payload", "$.mode").alias("mode"), F.get_json_object("payload", "$.exit_code").alias("exit_code"),
        F.get_json_object("payload", "$.command[3]").alias("cache_arg")),
    "G7_graph_summary": lambda s: graph.graph_summary(*_graph(s)),
    "G8_connected_edges": lambda s: graph.connected_edges(*_graph(s)).groupBy("kind").agg(F.count("*").alias("n")),
    "G3_G4_run_attribution": _attributed,
    "A22_J15_artifacts_per_run": lambda s: graph.artifact_attribution(_attributed(s)),
    "G5_card_partition": _partition,
    "A27_cluster_composition": lambda s: graph.cluster_composition(_partition(s)),
    "G5_change_cluster": lambda s: graph.change_cluster(_graph(s)[0]),
    "G6_agent_nodes": lambda s: _graph(s)[0].where("kind = 'agent'").select(
        "id", "run_id", "label", F.get_json_object("payload", "$.prompt_sha256").alias("prompt_sha256"), "source_kind"),
    "L4_visible_hint": lambda s: graph.visible_hint(_graph(s)[0]),
    "L5_ranked_search": lambda s: graph.ranked_search(
        s.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("kind")), "ring"
    ).select("id", "score"),
    "P3_focus_counts": lambda s: graph.focus_counts(_node_groups(s), ["run_group"]),
    "P9_evidence_tone": lambda s: graph.evidence_tone(_node_groups(s), ["run_group"], "run_group"),
    "A17_remote_metrics": lambda s: remote.remote_metrics(s.runs, s.invocations, s.worker_events),
    "A18_endpoint_summaries": lambda s: remote.endpoint_summaries(s.runs, s.invocations),
    "D6_claims_per_run": lambda s: remote.claims_per_run(s.runs, s.worker_events).select("run_id", F.concat_ws(",", "claims").alias("claims")),
    "D6_claims_per_group": lambda s: remote.claims_per_group(
        remote.remote_metrics(s.runs, s.invocations, s.worker_events)).select("run_group", F.concat_ws(",", "claims").alias("claims")),
    "J19_X4_remote_lens": _lens,
    "J4_remote_worker_pairs": lambda s: graph.remote_configs(s.invocations).select("id", "run_id").join(s.worker_events, "run_id").select(
        "id", "worker_name", "line_number"),
    "E21_remote_endpoints": lambda s: s.invocations.select(
        "id", F.concat_ws(",", endpoints.remote_endpoints(F.col("command"))).alias("endpoints")),
    "E22_F8_sanitized_args": lambda s: s.invocations.select(
        "id", F.concat_ws(" ", endpoints.sanitize_args(F.col("command"))).alias("command")),
    "E23_blob_uris": _blob_uris,
}

_KIND_ROWS = """
 cfg AS (SELECT id, run_id, endpoint, endpoint_args, created_at, redaction_state, left(sha256(endpoint), 16) AS fp,
   CASE WHEN endpoint_args = 1 THEN endpoint ELSE concat('grpc://<redacted>:8980#', left(sha256(endpoint), 16)) END AS label FROM invocations WHERE endpoint IS NOT NULL),
 nodes AS (
 SELECT concat('run:', id) AS id, id AS run_id, 'run' AS kind, scenario AS label, status, coalesce(source_kind, 'unknown') AS source_kind, confidence, redaction_state FROM runs
 UNION ALL SELECT id, run_id, 'agent', model, NULL, source_kind, confidence, redaction_state FROM agent_blocks
 UNION ALL SELECT id, run_id, 'change', path, NULL, source_kind, confidence, redaction_state FROM changes
 UNION ALL SELECT id, run_id, 'invocation', invocation_kind, CAST(exit_code AS STRING), coalesce(source_kind, 'unknown'), confidence, redaction_state FROM invocations
 UNION ALL SELECT concat('remote_execution_config:', id), run_id, 'remote_execution_config', label, 'configured', 'derived_v1', 'high', redaction_state FROM cfg
 UNION ALL SELECT concat('worker:', c.id, ':', worker_name), c.run_id, 'worker', worker_name, 'observed', 'collectable_v1', 'high', redaction_state FROM cfg c JOIN worker_events w ON w.run_id = c.run_id
 UNION ALL SELECT id, run_id, 'artifact', artifact_key, NULL, coalesce(source_kind, 'unknown'), confidence, redaction_state FROM artifacts
 UNION ALL SELECT id, run_id, 'target', label, status, coalesce(source_kind, 'unknown'), confidence, redaction_state FROM targets
 UNION ALL SELECT id, run_id, 'action', mnemonic, status, coalesce(source_kind, 'unknown'), confidence, redaction_state FROM actions
 UNION ALL SELECT id, run_id, 'cache_event', event_kind, NULL, coalesce(source_kind, 'unknown'), confidence, redaction_state FROM cache_events
 UNION ALL SELECT id, run_id, 'failure', failure_kind, NULL, coalesce(source_kind, 'unknown'), confidence, redaction_state FROM failures)
"""
_EDGE_ROWS = """
 edges AS (
 SELECT 'authored_change' AS kind, a.agent AS f, c.id AS t FROM changes c JOIN (SELECT run_id, arg_max(id, created_at) AS agent FROM agent_blocks GROUP BY 1) a ON a.run_id = c.run_id
 UNION ALL SELECT 'validated_by', id, concat('run:', run_id) FROM changes
 UNION ALL SELECT 'recorded_invocation', concat('run:', run_id), id FROM invocations
 UNION ALL SELECT 'configured_remote_execution', id, concat('remote_execution_config:', id) FROM cfg
 UNION ALL SELECT 'observed_worker_identity', concat('remote_execution_config:', c.id), concat('worker:', c.id, ':', worker_name) FROM cfg c JOIN worker_events w ON w.run_id = c.run_id
 UNION ALL SELECT 'recorded_artifact', concat('run:', run_id), id FROM artifacts
 UNION ALL SELECT 'evaluated_target', concat('run:', run_id), id FROM targets
 UNION ALL SELECT 'produced_action', coalesce(target_id, concat('run:', run_id)), id FROM actions
 UNION ALL SELECT 'observed_cache_event', coalesce(action_id, target_id, concat('run:', run_id)), id FROM cache_events
 UNION ALL SELECT 'observed_failure', concat('run:', run_id), id FROM failures)
"""
_WALK = f"""WITH RECURSIVE {_KIND_ROWS}, {_EDGE_ROWS},
 ov AS (SELECT a.id, min(i.id) AS owner FROM artifacts a JOIN invocations i ON i.run_id = a.run_id WHERE a.run_id % 3 = 0 GROUP BY 1),
 kinds AS (SELECT DISTINCT id, kind FROM nodes),
 ranked AS (SELECT t AS id, f AS parent, row_number() OVER (PARTITION BY t ORDER BY list_position(['authored_change', 'validated_by', 'recorded_invocation', 'configured_remote_execution',
  'observed_worker_identity', 'recorded_artifact', 'evaluated_target', 'produced_action', 'observed_cache_event', 'observed_failure'], kind), f) AS place
  FROM edges WHERE f IN (SELECT id FROM kinds) AND t IN (SELECT id FROM kinds)),
 par AS (SELECT coalesce(e.id, ov.id) AS id, coalesce(owner, parent) AS parent FROM (SELECT id, parent FROM ranked WHERE place = 1) e FULL JOIN ov ON ov.id = e.id),
 walk AS (SELECT id, kind, id AS cursor, 0 AS hop, false AS hit FROM kinds WHERE kind <> 'run'
  UNION ALL SELECT w.id, w.kind, p.parent, hop + 1, starts_with(coalesce(p.parent, ''), 'run:') FROM walk w LEFT JOIN par p ON p.id = w.cursor WHERE NOT w.hit AND w.cursor IS NOT NULL AND hop < 1000),
 final AS (SELECT id, kind, CASE WHEN hit THEN cursor END AS run, hop + 2 AS depth FROM walk WHERE hit OR cursor IS NULL UNION ALL SELECT id, kind, id, 2 FROM kinds WHERE kind = 'run')
"""
_GT = ("runs", "agent_blocks", "changes", "invocations", "worker_events", "artifacts", "targets", "actions", "cache_events", "failures")
_PART = """, own AS (SELECT k.id, k.kind, p.parent FROM kinds k LEFT JOIN par p ON p.id = k.id),
 part AS (SELECT o.id, o.kind, CASE WHEN o.kind NOT IN ('invocation', 'artifact', 'target', 'action', 'cache_event') OR o.parent IS NULL THEN NULL ELSE 'x' END AS fold, o.parent,
   coalesce(o.parent IN (SELECT concat('run:', id) FROM runs WHERE id % 4 = 0), false) AS opened FROM own o),
 down AS (SELECT id, kind, CAST(NULL AS STRING) AS owner FROM part WHERE fold IS NULL
  UNION ALL SELECT p.id, p.kind, CASE WHEN d.owner IS NOT NULL THEN d.owner WHEN NOT p.opened THEN d.id END FROM down d JOIN part p ON p.parent = d.id AND p.fold IS NOT NULL)
"""
_METRICS = """m AS (SELECT run_group, count(i.endpoint) AS remote_invocations, count(DISTINCT i.endpoint) AS endpoints,
  coalesce(sum(greatest(endpoint_args - 1, 0)), 0)::BIGINT AS overrides, coalesce(bool_or(i.run_id IN (SELECT run_id FROM worker_events)), false) AS worker_identity_observed,
  false AS queue_time_observed, false AS scheduler_assignment_observed FROM runs r LEFT JOIN invocations i ON i.run_id = r.id GROUP BY 1)"""
_CLAIMS = "CASE WHEN {w} THEN '' ELSE 'worker_identity,' END || 'action_placement,queue_time,scheduler_assignment,load_distribution' AS claims"

ORACLES = {
    "G1_nodes": with_spine(*_GT, body=f"WITH {_KIND_ROWS} SELECT * FROM nodes"),
    "G2_edges": with_spine(*_GT, body=f"WITH {_KIND_ROWS}, {_EDGE_ROWS} SELECT concat(kind, ':', f, ':', t) AS id, f AS from_id, t AS to_id, kind FROM edges"),
    "P2_node_payloads": with_spine("runs", "invocations", body="""SELECT concat('run:', id) AS id, mode, NULL AS exit_code, NULL AS cache_arg FROM runs
 UNION ALL SELECT id, NULL, CAST(exit_code AS STRING), concat('--remote_cache=grpc://<redacted>:9092#', left(sha256(cache_endpoint), 16)) FROM invocations"""),
    "G7_graph_summary": with_spine(*_GT, body=f"WITH {_KIND_ROWS}, {_EDGE_ROWS} SELECT 'node' AS part, kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY ALL"),
    "G8_connected_edges": with_spine(*_GT, body=f"WITH {_KIND_ROWS}, {_EDGE_ROWS} SELECT kind, count(*) AS n FROM edges WHERE f IN (SELECT id FROM nodes) AND t IN (SELECT id FROM nodes) GROUP BY 1"),
    "G3_G4_run_attribution": with_spine(*_GT, body=_WALK + """SELECT id, kind, run, CASE kind WHEN 'agent' THEN 0 WHEN 'change' THEN 1 ELSE CASE WHEN run IS NULL THEN least(depth, 6) ELSE depth END END AS depth FROM final"""),
    "A22_J15_artifacts_per_run": with_spine(*_GT, body=_WALK + "SELECT coalesce(run, 'unattributed') AS run, count(*) AS artifacts FROM final WHERE kind = 'artifact' GROUP BY 1"),
    "G5_card_partition": with_spine(*_GT, body=_WALK + _PART + "SELECT id, kind, owner, NULL AS reason FROM down"),
    "A27_cluster_composition": with_spine(*_GT, body=_WALK + _PART + """, c AS (SELECT owner, kind, count(*) AS n, CASE kind WHEN 'invocation' THEN 0 WHEN 'artifact' THEN 1 WHEN 'target' THEN 2 WHEN 'action' THEN 3 ELSE 4 END AS o FROM down WHERE owner IS NOT NULL GROUP BY 1, 2)
 SELECT owner, sum(n)::BIGINT AS members, string_agg(concat(n, ' ', replace(kind, '_', ' '), CASE WHEN n = 1 THEN '' ELSE 's' END), ' · ' ORDER BY o) AS label, arg_max(kind, n * 10 - o) AS dominant FROM c GROUP BY 1"""),
    "G5_change_cluster": with_spine("changes", body="SELECT run_id, count(*) AS changes, count(*) >= 4 AS folded FROM changes GROUP BY 1"),
    "G6_agent_nodes": with_spine("agent_blocks", body="SELECT id, run_id, model AS label, prompt_sha256, source_kind FROM agent_blocks"),
    "L4_visible_hint": with_spine(*_GT, body=f"WITH {_KIND_ROWS} SELECT run_id, least(count(*), 8) AS visible, greatest(count(*) - 8, 0) AS overflow FROM nodes GROUP BY 1"),
    "L5_ranked_search": """SELECT id, score FROM (SELECT p_partkey AS id, CASE WHEN strpos(lower(p_name), 'ring') > 0 THEN 1001 - strpos(lower(p_name), 'ring')
 WHEN strpos(lower(p_type), 'ring') > 0 THEN 501 - strpos(lower(p_type), 'ring') WHEN regexp_matches(lower(p_name), 'r.*i.*n.*g') THEN 200 WHEN regexp_matches(lower(p_type), 'r.*i.*n.*g') THEN 100 END AS score FROM part) WHERE score IS NOT NULL""",
    "P3_focus_counts": with_spine(*_GT, body=f"""WITH {_KIND_ROWS} SELECT run_group, count(*) AS "all", count(*) FILTER (WHERE kind = 'cache_event') AS cache, count(*) FILTER (WHERE kind = 'failure') AS failures,
 count(*) FILTER (WHERE kind = 'remote_execution_config') AS remote, count(*) FILTER (WHERE kind IN ('agent', 'change')) AS agent, count(*) FILTER (WHERE n.source_kind = 'derived_v1') AS derived,
 CASE WHEN count(*) FILTER (WHERE kind = 'remote_execution_config') > 0 THEN count(*) FILTER (WHERE kind = 'remote_execution_config') ELSE count(*) END AS remote_highlight
 FROM nodes n JOIN runs r ON r.id = n.run_id GROUP BY 1"""),
    "P9_evidence_tone": with_spine(*_GT, body=f"""WITH {_KIND_ROWS}, c AS (SELECT run_group, count(*) FILTER (WHERE n.source_kind = 'collectable_v1') AS collectable, count(*) FILTER (WHERE n.source_kind = 'simulated_v1') AS simulated
 FROM nodes n JOIN runs r ON r.id = n.run_id GROUP BY 1) SELECT *, CASE WHEN simulated > collectable THEN 'simulated' WHEN simulated > 0 AND collectable > 0 THEN 'mixed' WHEN collectable > 0 THEN 'collectable' ELSE 'none' END AS tone FROM c"""),
    "A17_remote_metrics": with_spine("runs", "invocations", "worker_events", body=f"WITH {_METRICS} SELECT * FROM m"),
    "A18_endpoint_summaries": with_spine("runs", "invocations", body="""SELECT DISTINCT run_group, left(sha256(endpoint), 16) AS fingerprint,
 CASE WHEN endpoint_args = 1 THEN endpoint ELSE concat('grpc://<redacted>:8980#', left(sha256(endpoint), 16)) END AS label, endpoint_args = 2 AS redacted FROM invocations i JOIN runs r ON r.id = i.run_id WHERE endpoint IS NOT NULL"""),
    "D6_claims_per_run": with_spine("runs", "worker_events", body=f"SELECT id AS run_id, {_CLAIMS.format(w='id IN (SELECT run_id FROM worker_events)')} FROM runs"),
    "D6_claims_per_group": with_spine("runs", "invocations", "worker_events", body=f"WITH {_METRICS} SELECT run_group, {_CLAIMS.format(w='worker_identity_observed')} FROM m"),
    "J19_X4_remote_lens": with_spine("runs", "invocations", "worker_events", body=f"""WITH {_METRICS}, n AS (SELECT run_group, count(i.id) AS invocations FROM runs r LEFT JOIN invocations i ON i.run_id = r.id GROUP BY 1)
 SELECT run_group, invocations, remote_invocations, endpoints, overrides, remote_invocations > 0 AS observed, CASE WHEN worker_identity_observed THEN 'observed' ELSE 'not observed' END AS worker_identity,
 'not observed' AS scheduler_assignment, 'not observed' AS queue_time, CASE WHEN remote_invocations > 0 THEN concat(remote_invocations, ' of ', invocations, ' recorded invocations used remote execution') ELSE 'no remote execution observed' END AS statement
 FROM n JOIN m USING (run_group)"""),
    "J4_remote_worker_pairs": with_spine("invocations", "worker_events", body="SELECT i.id, worker_name, line_number FROM invocations i JOIN worker_events w ON w.run_id = i.run_id WHERE endpoint IS NOT NULL"),
    "E21_remote_endpoints": with_spine("invocations", body="""SELECT id, CASE endpoint_args WHEN 2 THEN concat('grpcs://exec', l_suppkey % 4, '.example:443,', endpoint) WHEN 1 THEN endpoint ELSE '' END AS endpoints FROM invocations"""),
    "E22_F8_sanitized_args": with_spine("invocations", body="""SELECT id, concat('bazel build //... --remote_cache=grpc://<redacted>:9092#', left(sha256(cache_endpoint), 16), ' ',
 CASE endpoint_args WHEN 1 THEN concat('--remote_executor=', endpoint) WHEN 2 THEN concat('--remote_executor grpcs://<redacted>:443#', left(sha256(concat('grpcs://exec', l_suppkey % 4, '.example:443')), 16),
  ' --remote_executor=grpc://<redacted>:8980#', left(sha256(endpoint), 16)) ELSE '--config=ci' END) AS command FROM invocations"""),
    "E23_blob_uris": """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN 'team a/main' WHEN doc_id % 6 = 2 THEN 'main' END AS instance,
 CASE WHEN doc_id % 6 < 3 THEN sha256(text) END AS hash, CASE WHEN doc_id % 6 < 3 THEN n_chars END AS size, CASE WHEN doc_id % 6 < 3 THEN doc_id % 6 = 2 END AS compressed FROM documents""",
}
