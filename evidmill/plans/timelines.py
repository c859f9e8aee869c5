"""Queries: timeline, repair chapters, histogram, comparison (T, J20, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.operators import compare, timeline
from evidmill.plans.binding import Spine, with_spine


def _stream(s: Spine):
    events = s.events.select(
        F.col("ts").cast("string").alias("ts"), "kind", "source",
        F.when(F.col("kind") == "run", 0).otherwise(1).alias("kind_pos"),
        F.lit(None).cast("string").alias("created_at"), F.col("id").cast("string").alias("id"),
        "run_group", "status", "next_action", "confidence", "redaction_state",
    )
    return timeline.event_stream(events)


def _members(s: Spine):
    stream = _stream(s)
    return stream, timeline.chapter_members(stream)


def _chapters(s: Spine):
    return timeline.chapters(_members(s)[1])


def _pauses(s: Spine):
    stream, members = _members(s)
    return timeline.pauses(stream, timeline.chapters(members))


def _summary(s: Spine):
    stream, members = _members(s)
    return timeline.timeline_summary(stream, timeline.chapters(members))


def _placement(s: Spine):
    stream, members = _members(s)
    return timeline.placement(stream, members).select(
        "index", F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "lineage", "chapter_start")


def _text_hour(df):
    return df.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


def _loops(s: Spine):
    """Each user is one loop; iterations are the event's hundredth."""
    e = s.table("events").where("event_type IN ('error', 'purchase', 'click')")
    verdicts = e.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit("-iter"), (F.col("event_id") % 7 + 1).cast("string")).alias("run_group"),
        F.col("event_id").alias("index"),
        F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"),
        F.expr("CASE event_type WHEN 'error' THEN 'dispatch_fix_with_evidence' WHEN 'purchase' THEN 'none_complete' ELSE 'attach_missing_evidence' END").alias("next_action"),
        F.when(F.col("event_type") == "error", "scenario_validation_failure").otherwise("unattributed_failure").alias("classification"),
        F.when(F.col("value") > 10, 1).otherwise(0).alias("hits"),
        (F.col("event_id") % 2 == 0).alias("has_receipt"),
    )
    return timeline.loop_outcomes(verdicts)


def _pairs(s: Spine):
    return compare.adjacent_pairs(s.runs)


def _facts(s: Spine):
    return compare.group_facts(s.runs, s.cache_events, s.worker_events, s.agent_blocks)


def _across(s: Spine):
    """Each group of the dataset against the next newer one of a second dataset, which holds hits only and has seen no worker."""
    first = {n: getattr(s, n) for n in _CMP_TABLES}
    second = {**first, "cache_events": s.cache_events.where("hit"), "worker_events": s.worker_events.limit(0)}
    pairs = _pairs(s).select(F.lit("x").alias("left_source"), "left_group", F.lit("y").alias("right_source"), "right_group")
    return compare.compare_sources(pairs, compare.facts_of_sources({"x": first, "y": second}))


def _compared(s: Spine):
    return compare.compare_groups(_pairs(s), _facts(s))


def _documents(s: Spine):
    p = s.table("orders")
    return p.select(
        F.col("o_orderkey").alias("ordinal"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("left_run_group"),
        F.concat(F.lit("g"), (F.col("o_custkey") + 1).cast("string")).alias("right_run_group"),
        (F.col("o_orderkey") % 11).alias("left_runs"), (F.col("o_orderkey") % 13).alias("right_runs"),
        F.array(F.concat(F.lit("run_group:h"), F.col("o_custkey").cast("string")), F.lit("projection:x")).alias("refs"))


QUERIES = {
    "T1_event_stream": lambda s: _stream(s).select("index", "ts", "kind", "source", "run_group", "status", "next_action"),
    "T2_lineage": lambda s: s.events.select(timeline.lineage(F.col("run_group")).alias("lineage")).groupBy("lineage").agg(F.count("*").alias("n")),
    "T3_chapter_members": lambda s: _members(s)[1].select("lineage", "chapter_start", "index", "kind", "closes"),
    "T4_chapters": _chapters,
    "T5_timeline_summary": _summary,
    "T6_hourly_histogram": lambda s: _text_hour(timeline.hourly_histogram(s.events.withColumn("ts", F.col("ts").cast("string")))),
    "T7_event_placement": _placement,
    "T8_pauses": _pauses,
    "J20_bucket_marks": lambda s: _text_hour(timeline.bucket_marks(_members(s)[1])),
    "T12_loop_outcomes": _loops,
    "C1_C2_C3_C4_C6_compare": _compared,
    "C4_agent_summaries": lambda s: compare.agent_summaries(s.runs, s.agent_blocks),
    "C5_J6_status_deltas": lambda s: compare.status_deltas(_pairs(s), s.runs),
    "C6_across_sources": _across,
    "C6_adjacent_pairs": _pairs,
    "C7_missing_sides": lambda s: compare.missing_sides(
        s.table("customer").select(F.col("c_custkey").alias("left_group"), (F.col("c_custkey") + 3).alias("right_group")), s.runs),
    "C8_headlines": lambda s: compare.headlines(_compared(s)),
    "U6_named_groups": lambda s: compare.named_groups(_documents(s)),
}

_STREAM = """
 stream AS (SELECT CAST(ts AS STRING) AS ts, kind, source, run_group, status, next_action, confidence, redaction_state,
   regexp_replace(run_group, '(-(red|green|iter[0-9]+|r[0-9]+))+$', '') AS lineage,
   row_number() OVER (ORDER BY ts, source, CASE kind WHEN 'run' THEN 0 ELSE 1 END, CAST(id AS STRING)) - 1 AS index FROM timeline)
"""
_MEMBERS = f"""WITH {_STREAM},
 flagged AS (SELECT *, CASE WHEN kind = 'verdict' AND next_action = 'dispatch_fix_with_evidence' THEN 1 ELSE 0 END AS d FROM stream),
 numbered AS (SELECT *, max(CASE WHEN d = 1 THEN index END) OVER (PARTITION BY lineage ORDER BY index) AS chapter_start FROM flagged),
 marked AS (SELECT *, coalesce(count(*) FILTER (WHERE kind = 'verdict' AND d = 0 AND status = 'ok')
   OVER (PARTITION BY lineage, chapter_start ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS greens
   FROM numbered WHERE chapter_start IS NOT NULL),
 members AS (SELECT *, kind = 'verdict' AND d = 0 AND status = 'ok' AS closes FROM marked WHERE greens = 0),
 chapters AS (SELECT lineage, chapter_start, max(index) AS last_index, count(*) AS events, count(*) FILTER (WHERE kind = 'verdict') AS verdict_refs,
   min(ts) FILTER (WHERE index = chapter_start) AS start_ts, max(ts) FILTER (WHERE closes) AS end_ts, NOT bool_or(closes) AS open,
   CASE WHEN bool_and(redaction_state = 'safe') THEN 'safe' WHEN bool_or(redaction_state = 'blocked') THEN 'blocked'
    WHEN bool_or(redaction_state = 'redacted') THEN 'redacted' ELSE 'unknown' END AS redaction_state,
   'derived_v1' AS source_kind, 'medium' AS confidence FROM members GROUP BY 1, 2)
"""
_PAIRS = """ idx AS (SELECT run_group, max(started_at) AS l FROM runs GROUP BY 1),
 pairs AS (SELECT * FROM (SELECT lag(run_group) OVER (ORDER BY l NULLS FIRST, run_group DESC) AS left_group, run_group AS right_group FROM idx) x WHERE left_group IS NOT NULL)
"""
_FACTS = """ cm AS (SELECT run_group, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses,
   count(*) FILTER (WHERE hit) / CAST(nullif(count(*) FILTER (WHERE hit IS NOT NULL), 0) AS DOUBLE) AS hit_rate
   FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1),
 facts AS (SELECT run_group, count(*) AS runs, any_value(hits) AS hits, any_value(misses) AS misses, any_value(hit_rate) AS hit_rate,
   bool_or(r.id IN (SELECT run_id FROM worker_events)) AS worker_seen,
   (SELECT count(*) FROM agent_blocks a JOIN runs q ON q.id = a.run_id WHERE q.run_group = r.run_group) AS agent_blocks
   FROM runs r JOIN cm USING (run_group) GROUP BY 1)
"""
_COMPARED = f"""WITH {_PAIRS}, {_FACTS},
 compared AS (SELECT left_group, right_group, l.runs AS left_runs, r.runs AS right_runs, r.runs - l.runs AS delta_runs,
  l.hits AS left_hits, r.hits AS right_hits, r.hits - l.hits AS delta_hits, l.misses AS left_misses, r.misses AS right_misses,
  r.misses - l.misses AS delta_misses, l.hit_rate AS left_hit_rate, r.hit_rate AS right_hit_rate, r.hit_rate - l.hit_rate AS delta_hit_rate,
  l.worker_seen AS left_worker_seen, r.worker_seen AS right_worker_seen, l.worker_seen <> r.worker_seen AS worker_changed,
  CASE WHEN l.worker_seen OR r.worker_seen THEN 'high' ELSE 'medium' END AS worker_confidence,
  l.agent_blocks AS left_agent_blocks, r.agent_blocks AS right_agent_blocks, r.agent_blocks - l.agent_blocks AS delta_agent_blocks,
  (l.agent_blocks > 0) <> (r.agent_blocks > 0) AS agent_presence_changed
  FROM pairs JOIN facts l ON l.run_group = left_group JOIN facts r ON r.run_group = right_group)
"""
_CMP_TABLES = ("runs", "cache_events", "worker_events", "agent_blocks")

_SECOND_FACTS = _FACTS.replace(" cm AS", " cm2 AS").replace(" facts AS", " facts2 AS").replace("JOIN cm USING", "JOIN cm2 USING").replace(
    "LEFT JOIN cache_events c ON", "LEFT JOIN (SELECT * FROM cache_events WHERE hit) c ON").replace("FROM worker_events)", "FROM worker_events WHERE false)")

ORACLES = {
    "C6_across_sources": with_spine(*_CMP_TABLES, body=_COMPARED.replace(_FACTS, _FACTS + "," + _SECOND_FACTS).replace("JOIN facts r ON", "JOIN facts2 r ON")
                                    + "SELECT 'x' AS left_source, 'y' AS right_source, * FROM compared"),
    "T1_event_stream": with_spine("timeline", body=f"WITH {_STREAM} SELECT index, ts, kind, source, run_group, status, next_action FROM stream"),
    "T2_lineage": with_spine("timeline", body=f"WITH {_STREAM} SELECT lineage, count(*) AS n FROM stream GROUP BY 1"),
    "T3_chapter_members": with_spine("timeline", body=_MEMBERS + "SELECT lineage, chapter_start, index, kind, closes FROM members"),
    "T4_chapters": with_spine("timeline", body=_MEMBERS + "SELECT * FROM chapters"),
    "T5_timeline_summary": with_spine("timeline", body=_MEMBERS + """SELECT min(ts) AS start, max(ts) AS "end", count(*) AS events,
 count(*) FILTER (WHERE kind = 'run') AS runs, count(*) FILTER (WHERE kind = 'verdict') AS verdicts, count(*) FILTER (WHERE kind = 'receipt') AS receipts,
 CASE WHEN bool_and(confidence = 'high') THEN 'high' WHEN bool_or(confidence = 'low') THEN 'low' ELSE 'medium' END AS confidence,
 CASE WHEN bool_and(redaction_state = 'safe') THEN 'safe' WHEN bool_or(redaction_state = 'blocked') THEN 'blocked' WHEN bool_or(redaction_state = 'redacted') THEN 'redacted' ELSE 'unknown' END AS redaction_state,
 (SELECT count(*) FROM chapters) AS repair_loops FROM stream"""),
    "T6_hourly_histogram": with_spine("timeline", body="""
 WITH h AS (SELECT unnest(generate_series(min(date_trunc('hour', ts)), max(date_trunc('hour', ts)), INTERVAL 1 HOUR)) AS hour FROM timeline)
 SELECT strftime(h.hour, '%Y-%m-%d %H') AS hour, count(*) FILTER (WHERE kind = 'run') AS runs, count(*) FILTER (WHERE kind = 'verdict') AS verdicts,
  count(*) FILTER (WHERE kind = 'receipt') AS receipts, count(kind) AS total FROM h LEFT JOIN timeline t ON date_trunc('hour', t.ts) = h.hour GROUP BY 1"""),
    "T7_event_placement": with_spine("timeline", body=_MEMBERS + """SELECT s.index, strftime(CAST(s.ts AS TIMESTAMP), '%Y-%m-%d %H') AS hour, m.lineage, m.chapter_start
 FROM stream s LEFT JOIN members m ON m.index = s.index"""),
    "T8_pauses": with_spine("timeline", body=_MEMBERS + """, p AS (SELECT s.index, c.chapter_start FROM stream s LEFT JOIN chapters c ON c.chapter_start = s.index)
 SELECT index, chapter_start IS NOT NULL AS is_pause, min(chapter_start) OVER (ORDER BY index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_pause FROM p"""),
    "J20_bucket_marks": with_spine("timeline", body=_MEMBERS + """, t AS (SELECT DISTINCT m.lineage, m.chapter_start, strftime(CAST(m.ts AS TIMESTAMP), '%Y-%m-%d %H') AS hour, c.open
 FROM members m JOIN chapters c ON c.lineage = m.lineage AND c.chapter_start = m.chapter_start) SELECT hour, count(*) AS chapters, bool_or(open) AS open FROM t GROUP BY 1"""),
    "T12_loop_outcomes": """WITH v AS (SELECT concat('user-', user_id) AS prefix, event_id % 7 + 1 AS n, event_id AS i, event_type AS t, value FROM events WHERE event_type IN ('error', 'purchase', 'click')),
 a AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n, i) = 1),
 z AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, i DESC) = 1),
 k AS (SELECT prefix, count(DISTINCT n) AS iterations FROM v GROUP BY 1)
 SELECT prefix, iterations, CASE z.t WHEN 'purchase' THEN CASE WHEN z.n > 1 THEN 'fixed_and_green' ELSE 'green_first_pass' END WHEN 'error' THEN 'iteration_cap_red' ELSE 'blocked' END AS outcome,
  a.t <> 'purchase' AS first_iteration_red, a.t = 'error' AS honest_classification, iterations > 1 AND z.i % 2 = 0 AS fix_receipt_present,
  z.t = 'purchase' AS final_green, z.value > 10 AS warm_cache_final, iterations > 1 AS comparable FROM k JOIN a USING (prefix) JOIN z USING (prefix)""",
    "C1_C2_C3_C4_C6_compare": with_spine(*_CMP_TABLES, body=_COMPARED + "SELECT * FROM compared"),
    "C4_agent_summaries": with_spine("runs", "agent_blocks", body="SELECT run_group, a.id AS block_id, model, left(prompt_sha256, 12) AS prompt_prefix, provenance_class, live AS receipt_verified FROM agent_blocks a JOIN runs r ON r.id = a.run_id"),
    "C5_J6_status_deltas": with_spine("runs", body=f"""WITH {_PAIRS}, c AS (SELECT run_group, status, count(*) AS n FROM runs GROUP BY ALL),
 l AS (SELECT left_group, right_group, status, n FROM pairs JOIN c ON c.run_group = left_group), r AS (SELECT left_group, right_group, status, n FROM pairs JOIN c ON c.run_group = right_group)
 SELECT coalesce(l.left_group, r.left_group) AS left_group, coalesce(l.right_group, r.right_group) AS right_group, coalesce(l.status, r.status) AS status,
  coalesce(l.n, 0) AS left_n, coalesce(r.n, 0) AS right_n, coalesce(r.n, 0) - coalesce(l.n, 0) AS delta
 FROM l FULL JOIN r ON l.left_group = r.left_group AND l.right_group = r.right_group AND l.status = r.status"""),
    "C6_adjacent_pairs": with_spine("runs", body=f"WITH {_PAIRS} SELECT * FROM pairs"),
    "C7_missing_sides": """WITH a AS (SELECT 'left' AS side, c_custkey AS run_group FROM customer UNION SELECT 'right', c_custkey + 3 FROM customer)
 SELECT side, run_group FROM a WHERE run_group NOT IN (SELECT o_custkey FROM orders)""",
    "C8_headlines": with_spine(*_CMP_TABLES, body=_COMPARED + """, t AS (SELECT left_group, right_group, 'run_counts' AS dimension, CAST(left_runs AS STRING) AS left_value, CAST(right_runs AS STRING) AS right_value, delta_runs AS d FROM compared
 UNION ALL SELECT left_group, right_group, 'cache_metrics', concat(left_hits, '/', left_misses), concat(right_hits, '/', right_misses), delta_hits FROM compared)
 SELECT left_group, right_group, dimension, left_value, right_value, concat('Δ ', CASE WHEN d > 0 THEN '+' ELSE '' END, d) AS delta_text,
  CASE WHEN d > 0 THEN 'increase' WHEN d < 0 THEN 'decrease' ELSE 'flat' END AS tone FROM t
 UNION ALL SELECT left_group, right_group, 'worker_identity', CASE WHEN left_worker_seen THEN 'observed' ELSE 'not observed' END, CASE WHEN right_worker_seen THEN 'observed' ELSE 'not observed' END,
  CASE WHEN worker_changed THEN 'differs' ELSE 'match' END, CASE WHEN worker_changed THEN 'differs' ELSE 'match' END FROM compared"""),
    "U6_named_groups": """WITH d AS (SELECT o_orderkey AS o, 0 AS s, concat('g', o_custkey) AS run_group, o_orderkey % 11 AS n FROM orders
 UNION ALL SELECT o_orderkey, 1, concat('g', o_custkey + 1), o_orderkey % 13 FROM orders UNION ALL SELECT o_orderkey, 2, concat('h', o_custkey), NULL FROM orders)
 SELECT run_group, n AS run_count FROM d QUALIFY row_number() OVER (PARTITION BY run_group ORDER BY o, s) = 1""",
}
