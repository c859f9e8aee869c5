"""Queries: scans, roll-ups, history, runway, lists (A, J, L, S10, S11, T9-T11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import labels
from evidmill.functions.truth import SOURCE_KINDS, truth_quad
from evidmill.operators import rollup
from evidmill.operators.grouping import latest
from evidmill.plans.binding import Spine, with_spine

MIX_ORDER = (*SOURCE_KINDS, "unknown")
LANES = ("run", "invocation", "target", "action", "cache_event", "failure", "artifact")
COUNTED = ("artifacts", "targets", "actions", "cache_events", "failures", "changes", "invocations")


def _tables(s: Spine) -> dict:
    return {n: getattr(s, n) for n in COUNTED}


def node_kinds(s: Spine):
    """(run_group, kind) of every spine row that the runway lanes count."""
    rows = {"invocation": s.invocations, "target": s.targets, "action": s.actions,
            "cache_event": s.cache_events, "failure": s.failures, "artifact": s.artifacts}
    out = s.runs.select("run_group", F.lit("run").alias("kind"), F.lit(1).alias("w"))
    for kind, df in rows.items():
        per_run = df.groupBy("run_id").agg(F.count("*").alias("w"))
        one = s.runs.select(F.col("id").alias("run_id"), "run_group").join(per_run, "run_id")
        out = out.unionByName(one.select("run_group", F.lit(kind).alias("kind"), F.col("w").cast("int")))
    return out


def _runway(s: Spine):
    runs = s.timed_runs.withColumn("run_id", F.col("id"))
    tables = {
        "runs": (runs, F.lit("run"), F.col("scenario")),
        "invocations": (s.invocations, F.col("invocation_kind"), F.col("id")),
        "cache_events": (s.cache_events, labels.cache_lane(F.col("hit")), F.col("id")),
        "targets": (s.targets, F.lit("target"), F.col("label")),
        "failures": (s.failures, F.lit("failure"), F.col("message")),
        "artifacts": (s.artifacts, F.lit("artifact"), F.col("artifact_key")),
    }
    return rollup.runway(s.runs, tables, labels.lane)


def _lane_counts(s: Spine):
    kinds = node_kinds(s)
    wide = kinds.groupBy("run_group").agg(
        *[F.sum(F.when(F.col("kind") == n, F.col("w")).otherwise(0)).alias(n) for n in LANES]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("n")) for n in LANES]))
    return wide.select("run_group", pairs.alias("p")).select(
        "run_group", "p.lane", "p.n", (F.col("p.n") == 0).alias("empty")
    )


def _ledger(s: Spine):
    listing = s.table("customer").join(
        rollup.run_group_index(s.runs), F.col("c_custkey") == F.col("run_group"), "left"
    )
    return listing.select(
        F.col("c_custkey").alias("source"),
        F.coalesce("run_count", F.lit(0)).alias("runs"),
        F.col("last_started_at").alias("newest"),
        F.when(F.col("c_nationkey") == 7, "format").alias("reason"),
    )


def _labelled(s: Spine):
    """Recorded lines with the label they name: some without one, some with one that the run doesn't have."""
    label = F.concat(F.lit("//"), F.coalesce("p_brand", F.lit("none")), F.lit(":"), F.col("l_partkey").cast("string"))
    rows = s.table("lineitem").join(s.table("part"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"),
                       F.when(F.col("l_linenumber") % 7 == 6, F.concat(label, F.lit("_x"))).when(F.col("l_linenumber") % 7 < 6, F.when(F.col("l_linenumber") != 5, label)).alias("label"))


QUERIES = {
    "S10_child_rows_of_runs": lambda s: rollup.scan_of_runs(
        s.cache_events, s.runs.where("mode = 'remote'")
    ).select("id", "run_id", "event_kind"),
    "S11_runs_of_group": lambda s: rollup.run_scan(s.runs, 1).select("id", "scenario", "status", "started_at"),
    "J1_semi_join_rows": lambda s: rollup.scan_of_runs(s.failures, s.runs.where("status = 'failed'")).groupBy(
        "failure_kind").agg(F.count("*").alias("n")),
    "J2_failed_target_labels": lambda s: s.actions.select("run_id", F.col("id").alias("action"), "target_id").join(
        s.targets.where("status = 'FAILED'").select(F.col("run_id"), F.col("id").alias("target_id"), "label"),
        ["run_id", "target_id"], "left").select("action", "label"),
    "J2_resolve_targets": lambda s: rollup.resolve_targets(_labelled(s), s.targets).select("run_id", "line", "label", "target_id"),
    "A1_run_status_counts": lambda s: rollup.status_counts(s.runs, None, rollup.status_key()),
    "A1_action_status_counts": lambda s: rollup.status_counts(s.runs, s.actions, rollup.status_key()),
    "A1_cache_status_counts": lambda s: rollup.status_counts(s.runs, s.cache_events, rollup.status_key(None, "event_kind")),
    "A2_cache_metrics": lambda s: rollup.cache_metrics(s.runs, s.cache_events),
    "A3_cache_legs": lambda s: rollup.cache_legs(s.timed_runs, s.invocations, s.cache_events).select(
        "run_group", "run_id", "scenario", "mode", "status", "duration_seconds", "hits", "misses", "unknown", "hit_rate"),
    "A4_cold_warm": lambda s: rollup.cold_warm(rollup.cache_legs(s.timed_runs, s.invocations, s.cache_events)),
    "A5_run_durations": lambda s: rollup.run_durations(s.timed_runs, s.invocations),
    "A6_A8_A9_label_rollup": lambda s: rollup.label_rollup(s.runs, s.cache_events),
    "A7_evidence_mix": lambda s: rollup.evidence_mix(
        s.cache_events.join(s.runs.select(F.col("id").alias("run_id"), "run_group"), "run_id"), ["run_group"], MIX_ORDER),
    "A10_ordered_refs": lambda s: rollup.ordered_refs(
        s.lineitem.select(
            F.col("l_suppkey").alias("owner"), "l_orderkey", "l_linenumber", "l_partkey",
            F.array(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")),
                    F.concat(F.lit("brandline:"), F.col("l_linenumber").cast("string"))).alias("evidence_refs")),
        ["owner"], ["l_orderkey", "l_linenumber", "l_partkey"]
    ).select("owner", "ref", F.col("first_seen.l_orderkey").alias("first_order"),
             F.col("first_seen.l_linenumber").alias("first_line"), F.col("first_seen.slot").alias("slot")),
    "A11_run_group_index": lambda s: rollup.newest_first(rollup.run_group_index(s.runs)),
    "A12_run_history": lambda s: rollup.run_history(s.runs, _tables(s), s.cache_events),
    "A13_packet_counts": lambda s: rollup.packet_counts(s.runs, _tables(s)),
    "A21_lane_counts": _lane_counts,
    "A23_counts_per_table": lambda s: rollup.counts_per_table(
        s.runs, {"runs": s.runs, **_tables(s)}).select(
        F.coalesce(F.col("run_group").cast("string"), F.lit("all")).alias("run_group"),
        F.coalesce("table_name", F.lit("all")).alias("table_name"), "n"),
    "A30_source_ledger": lambda s: rollup.source_ledger(_ledger(s)),
    "C9_listing_order": lambda s: rollup.listing_order(_ledger(s)).select("source", "runs", "newest", "reason", "class"),
    "L1_newest_groups": lambda s: rollup.newest_groups(rollup.run_group_index(s.runs), 25),
    "P4_T9_runway": lambda s: _runway(s),
    "T10_latest_run": lambda s: latest(
        s.runs.select("run_group", "id", "scenario", "status", "started_at", "created_at"), ["run_group"],
        [F.col("started_at"), F.col("created_at"), F.col("id")]).select("run_group", "id", "scenario", "status"),
    "T11_run_ordinal": lambda s: rollup.run_ordinal(s.runs),
    "P1_truth_quad": lambda s: s.runs.select(
        "id", *truth_quad(refs=False)),
    "P10_status_tone": lambda s: s.lineitem.select(
        F.concat(F.lit("exit "), (F.col("l_linenumber") - 1).cast("string")).alias("a"),
        F.concat(F.col("l_returnflag"), F.lit(" not completed")).alias("b"),
        F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "PASSED").alias("c"),
    ).select(labels.status_tone(F.col("a")).alias("ta"), labels.status_tone(F.col("b")).alias("tb"),
             labels.status_tone(F.col("c")).alias("tc")).groupBy("ta", "tb", "tc").agg(F.count("*").alias("n")),
    "F15_duration_label": lambda s: rollup.run_durations(s.timed_runs, s.invocations).where(
        "duration_seconds IS NOT NULL").select("run_id", labels.duration_label(F.col("duration_seconds")).alias("label")),
    "F9_F7_content_type": lambda s: s.artifacts.select(
        "id", labels.content_type(F.col("artifact_key")).alias("content_type"),
        labels.hash_prefix(F.col("sha256")).alias("sha256_prefix")),
    "F12_command_label": lambda s: s.invocations.select(
        "id", labels.command_label(F.col("command"), F.col("exit_code")).alias("label")),
}

_STATUS = "SELECT r.run_group, {key} AS status, count(*) AS n FROM {t} c JOIN runs r ON r.id = c.run_id GROUP BY ALL"
_DUR = """
 span AS (SELECT run_id, max(CASE WHEN epoch_us(CAST(ended_at AS TIMESTAMP)) >= epoch_us(CAST(started_at AS TIMESTAMP))
   THEN (epoch_us(CAST(ended_at AS TIMESTAMP)) - epoch_us(CAST(started_at AS TIMESTAMP))) / 1e6 END) AS inv FROM invocations GROUP BY 1),
 dur AS (SELECT r.id AS run_id, coalesce(CASE WHEN epoch_us(CAST(r.ended_at AS TIMESTAMP)) >= epoch_us(CAST(r.started_at AS TIMESTAMP))
   THEN (epoch_us(CAST(r.ended_at AS TIMESTAMP)) - epoch_us(CAST(r.started_at AS TIMESTAMP))) / 1e6 END, inv) AS duration_seconds
   FROM timed_runs r LEFT JOIN span s ON s.run_id = r.id)
"""
_LEGS = f"""WITH {_DUR},
 cm AS (SELECT run_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
   count(*) FILTER (WHERE hit IS NULL) AS unknown FROM cache_events GROUP BY 1),
 legs AS (SELECT r.run_group, r.id AS run_id, scenario, mode, status, duration_seconds, coalesce(hits, 0) AS hits,
   coalesce(misses, 0) AS misses, coalesce(unknown, 0) AS unknown,
   hits / CAST(nullif(hits + misses, 0) AS DOUBLE) AS hit_rate, started_at, created_at
   FROM timed_runs r LEFT JOIN cm ON cm.run_id = r.id LEFT JOIN dur d ON d.run_id = r.id
   WHERE r.run_group IN (SELECT run_group FROM runs GROUP BY 1 HAVING count(*) >= 2))
"""
_COUNT_JOINS = "".join(
    f" LEFT JOIN (SELECT run_group AS g, count(*) AS {t} FROM {t} c JOIN runs r ON r.id = c.run_id GROUP BY 1) n_{t} ON n_{t}.g = x.run_group"
    for t in COUNTED
)
_COUNT_COLS = ", ".join(f"coalesce({t}, 0) AS {t}" for t in COUNTED)
_CACHE = """SELECT run_group, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
 count(*) FILTER (WHERE c.run_id IS NOT NULL AND hit IS NULL) AS unknown,
 count(*) FILTER (WHERE hit) / CAST(nullif(count(*) FILTER (WHERE hit IS NOT NULL), 0) AS DOUBLE) AS hit_rate
 FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1"""
_LEDGER = """WITH idx AS (SELECT run_group, count(*) AS n, max(started_at) AS newest FROM runs GROUP BY 1),
 listing AS (SELECT c_custkey AS source, coalesce(n, 0) AS runs, newest, CASE WHEN c_nationkey = 7 THEN 'format' END AS reason
 FROM customer LEFT JOIN idx ON run_group = c_custkey)"""
_LATEST = "row_number() OVER (PARTITION BY run_group ORDER BY started_at DESC NULLS LAST, created_at DESC, id DESC) = 1"

ORACLES = {
    "S10_child_rows_of_runs": with_spine("runs", "cache_events", body=
        "SELECT id, run_id, event_kind FROM cache_events WHERE run_id IN (SELECT id FROM runs WHERE mode = 'remote')"),
    "S11_runs_of_group": with_spine("runs", body="SELECT id, scenario, status, started_at FROM runs WHERE run_group = 1"),
    "J1_semi_join_rows": with_spine("runs", "failures", body=
        "SELECT failure_kind, count(*) AS n FROM failures WHERE run_id IN (SELECT id FROM runs WHERE status = 'failed') GROUP BY 1"),
    "J2_failed_target_labels": with_spine("actions", "targets", body=
        "SELECT a.id AS action, t.label FROM actions a LEFT JOIN targets t ON t.run_id = a.run_id AND t.id = a.target_id AND t.status = 'FAILED'"),
    "J2_resolve_targets": with_spine("targets", body="""WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS line, concat('//', coalesce(p_brand, 'none'), ':', l_partkey) AS l FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
 n AS (SELECT run_id, line, CASE WHEN line % 7 = 6 THEN concat(l, '_x') WHEN line % 7 < 6 AND line <> 5 THEN l END AS label FROM r)
 SELECT n.run_id, line, n.label, t.id AS target_id FROM n LEFT JOIN (SELECT run_id, label, min(id) AS id FROM targets GROUP BY 1, 2) t ON t.run_id = n.run_id AND t.label = n.label"""),
    "A1_run_status_counts": with_spine("runs", body="SELECT run_group, coalesce(status, 'unknown') AS status, count(*) AS n FROM runs GROUP BY ALL"),
    "A1_action_status_counts": with_spine("runs", "actions", body=_STATUS.format(key="coalesce(c.status, 'unknown')", t="actions")),
    "A1_cache_status_counts": with_spine("runs", "cache_events", body=_STATUS.format(key="coalesce(c.event_kind, 'unknown')", t="cache_events")),
    "A2_cache_metrics": with_spine("runs", "cache_events", body=_CACHE),
    "A3_cache_legs": with_spine("timed_runs", "invocations", "cache_events", body=_LEGS +
        " SELECT * EXCLUDE (started_at, created_at) FROM legs"),
    "A4_cold_warm": with_spine("timed_runs", "invocations", "cache_events", body=_LEGS + """,
 last AS (SELECT * FROM legs WHERE scenario IN ('cold-cache', 'warm-cache') QUALIFY row_number() OVER
   (PARTITION BY run_group, scenario ORDER BY started_at DESC NULLS LAST, created_at DESC, run_id DESC) = 1)
 SELECT c.run_group, c.hit_rate AS cold_hit_rate, w.hit_rate AS warm_hit_rate, c.duration_seconds AS cold_duration_seconds,
  w.duration_seconds AS warm_duration_seconds, coalesce(w.hit_rate > c.hit_rate, false) AS warm_hit_rate_higher,
  coalesce(w.duration_seconds < c.duration_seconds, false) AS warm_duration_lower, w.hit_rate - c.hit_rate AS hit_rate_delta,
  w.duration_seconds - c.duration_seconds AS duration_delta_seconds
 FROM last c JOIN last w ON w.run_group = c.run_group AND c.scenario = 'cold-cache' AND w.scenario = 'warm-cache'"""),
    "A5_run_durations": with_spine("timed_runs", "invocations", body=f"WITH {_DUR} SELECT run_id, duration_seconds FROM dur"),
    "A6_A8_A9_label_rollup": with_spine("runs", "cache_events", body="""
 SELECT run_group,
  CASE WHEN count(c.id) = 0 THEN 'future' WHEN count(c.source_kind) = 0 THEN 'derived_v1'
   WHEN bool_or(c.source_kind = 'collectable_v1') THEN 'collectable_v1' WHEN bool_or(c.source_kind = 'derived_v1') THEN 'derived_v1'
   WHEN bool_or(c.source_kind = 'simulated_v1') THEN 'simulated_v1' ELSE 'future' END AS source_kind,
  CASE WHEN count(c.id) = 0 THEN 'unknown' WHEN bool_and(c.confidence = 'high') THEN 'high' WHEN bool_or(c.confidence = 'low') THEN 'low' ELSE 'medium' END AS confidence,
  CASE WHEN count(c.id) = 0 THEN 'unknown' WHEN bool_and(c.redaction_state = 'safe') THEN 'safe' WHEN bool_or(c.redaction_state = 'blocked') THEN 'blocked'
   WHEN bool_or(c.redaction_state = 'redacted') THEN 'redacted' ELSE 'unknown' END AS redaction_state
 FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1"""),
    "A7_evidence_mix": with_spine("runs", "cache_events", body="""
 WITH k AS (SELECT run_group, coalesce(c.source_kind, 'unknown') AS kind, count(*) AS n FROM cache_events c JOIN runs r ON r.id = c.run_id GROUP BY ALL)
 SELECT run_group, kind, n, n / CAST(sum(n) OVER (PARTITION BY run_group) AS DOUBLE) AS fraction,
  first_value(kind) OVER (PARTITION BY run_group ORDER BY n DESC, CASE kind WHEN 'collectable_v1' THEN 0 WHEN 'derived_v1' THEN 1 WHEN 'simulated_v1' THEN 2 WHEN 'future' THEN 3 ELSE 4 END) AS dominant
 FROM k"""),
    "A10_ordered_refs": """WITH f AS (SELECT l_suppkey AS owner, l_orderkey, l_linenumber, l_partkey, 0 AS slot, concat('part:', l_partkey) AS ref FROM lineitem
 UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, 1, concat('brandline:', l_linenumber) FROM lineitem)
 SELECT owner, ref, l_orderkey AS first_order, l_linenumber AS first_line, slot FROM f
 QUALIFY row_number() OVER (PARTITION BY owner, ref ORDER BY l_orderkey, l_linenumber, l_partkey, slot) = 1""",
    "A11_run_group_index": with_spine("runs", body="SELECT run_group, count(*) AS run_count, min(started_at) AS first_started_at, max(started_at) AS last_started_at FROM runs GROUP BY 1"),
    "A12_run_history": with_spine("runs", *COUNTED, body=f"""
 WITH x AS (SELECT run_group, count(*) AS run_count, min(started_at) AS first_started_at, max(started_at) AS last_started_at FROM runs GROUP BY 1),
 la AS (SELECT run_group, scenario, mode FROM runs QUALIFY {_LATEST}),
 sc AS (SELECT run_group, string_agg(concat(status, '=', n), ',' ORDER BY concat(status, '=', n)) AS status_counts
   FROM (SELECT run_group, status, count(*) AS n FROM runs GROUP BY ALL) GROUP BY 1),
 cm AS ({_CACHE})
 SELECT x.*, la.scenario, la.mode, sc.status_counts, {_COUNT_COLS}, cm.hits, cm.misses, cm.unknown, cm.hit_rate, 0 AS agent_blocks
 FROM x JOIN la USING (run_group) JOIN sc USING (run_group) JOIN cm USING (run_group){_COUNT_JOINS}"""),
    "A13_packet_counts": with_spine("runs", *COUNTED, body=
        f"SELECT x.run_group, x.runs, {_COUNT_COLS} FROM (SELECT run_group, count(*) AS runs FROM runs GROUP BY 1) x{_COUNT_JOINS}"),
    "A21_lane_counts": with_spine("runs", "invocations", "targets", "actions", "cache_events", "failures", "artifacts", body=
        "WITH k AS (SELECT run_group, 'run' AS lane FROM runs" + "".join(
            f" UNION ALL SELECT run_group, '{k}' FROM {t} c JOIN runs r ON r.id = c.run_id" for k, t in
            (("invocation", "invocations"), ("target", "targets"), ("action", "actions"), ("cache_event", "cache_events"),
             ("failure", "failures"), ("artifact", "artifacts"))) +
        "), d AS (SELECT unnest(['run','invocation','target','action','cache_event','failure','artifact']) AS lane)"
        " SELECT g.run_group, d.lane, count(k.lane) AS n, count(k.lane) = 0 AS empty FROM (SELECT DISTINCT run_group FROM runs) g CROSS JOIN d"
        " LEFT JOIN k ON k.run_group = g.run_group AND k.lane = d.lane GROUP BY 1, 2"),
    "A23_counts_per_table": with_spine("runs", *COUNTED, body=
        "WITH k AS (SELECT run_group, 'runs' AS table_name FROM runs" + "".join(
            f" UNION ALL SELECT run_group, '{t}' FROM {t} c JOIN runs r ON r.id = c.run_id" for t in COUNTED) +
        ") SELECT coalesce(CAST(run_group AS VARCHAR), 'all') AS run_group, coalesce(table_name, 'all') AS table_name, count(*) AS n FROM k GROUP BY ROLLUP (run_group, table_name)"),
    "A30_source_ledger": with_spine("runs", body=_LEDGER +
        " SELECT count(*) AS sources, count(*) FILTER (WHERE reason IS NULL AND runs > 0) AS readable,"
        " count(*) FILTER (WHERE reason IS NOT NULL) AS unreadable, count(*) FILTER (WHERE reason IS NULL AND runs = 0) AS empty FROM listing"),
    "C9_listing_order": with_spine("runs", body=_LEDGER +
        " SELECT *, CASE WHEN reason IS NOT NULL THEN 2 WHEN runs = 0 THEN 1 ELSE 0 END AS class FROM listing"),
    "L1_newest_groups": with_spine("runs", body="SELECT run_group, count(*) AS run_count, min(started_at) AS first_started_at, max(started_at) AS last_started_at"
        " FROM runs GROUP BY 1 ORDER BY last_started_at DESC NULLS LAST, run_group LIMIT 25"),
    "P4_T9_runway": with_spine("timed_runs", "invocations", "cache_events", "targets", "failures", "artifacts", body="""
 SELECT CAST(id AS VARCHAR) AS id, id AS run_id, 'run' AS lane, scenario AS label, status, coalesce(started_at, created_at) AS started_at FROM timed_runs
 UNION ALL SELECT id, run_id, 'bazel', id, NULL, started_at FROM invocations
 UNION ALL SELECT id, run_id, 'cache', id, event_kind, created_at FROM cache_events
 UNION ALL SELECT id, run_id, 'target', label, status, created_at FROM targets
 UNION ALL SELECT id, run_id, 'failure', message, NULL, created_at FROM failures
 UNION ALL SELECT id, run_id, 'artifact', artifact_key, NULL, created_at FROM artifacts"""),
    "T10_latest_run": with_spine("runs", body=f"SELECT run_group, id, scenario, status FROM runs QUALIFY {_LATEST}"),
    "T11_run_ordinal": with_spine("runs", body=
        "SELECT run_group, id, row_number() OVER (PARTITION BY run_group ORDER BY started_at NULLS FIRST, created_at, id) AS ordinal FROM runs"),
    "P1_truth_quad": with_spine("runs", body=
        "SELECT id, coalesce(source_kind, 'unknown') AS source_kind, confidence, redaction_state FROM runs"),
    "P10_status_tone": """SELECT CASE WHEN l_linenumber = 1 THEN 'pass' ELSE 'fail' END AS ta, 'neutral' AS tb,
 CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'pass' ELSE 'neutral' END AS tc, count(*) AS n FROM lineitem GROUP BY ALL""",
    "F15_duration_label": with_spine("timed_runs", "invocations", body=f"""WITH {_DUR}
 SELECT run_id, CASE WHEN duration_seconds >= 90 THEN concat(CAST(floor(duration_seconds / 60) AS BIGINT), 'm ',
  CAST(round(duration_seconds - floor(duration_seconds / 60) * 60) AS BIGINT), 's')
  ELSE concat(printf('%.1f', duration_seconds), 's') END AS label FROM dur WHERE duration_seconds IS NOT NULL"""),
    "F9_F7_content_type": with_spine("artifacts", body="""SELECT id, CASE WHEN artifact_key LIKE '%.json' THEN 'application/json'
 WHEN artifact_key LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS content_type, left(sha256, 12) AS sha256_prefix FROM artifacts"""),
    "F12_command_label": with_spine("invocations", body="SELECT id, concat('bazel-', exit_code) AS label FROM invocations"),
}
