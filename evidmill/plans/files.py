"""Queries: sources, sinks and streams over files that Spark derives from the tables (S, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.operators import extract, receipts, redact, rollup
from evidmill.plans import evidence
from evidmill.plans.binding import Spine, with_spine
from evidmill.session import scratch_path
from evidmill.sources import evidence as src, spine
from evidmill.streaming import jobs


def _events_from_files(s: Spine):
    path = scratch_path(s.spark, "events")
    lines = evidence.build_event_lines(s).select(F.col("line").alias("value"))
    lines.write.option("compression", "gzip").text(path)
    events = src.read_build_events(s.spark, path)
    return events.groupBy(extract.bep_label().alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("event_index") > 0).alias("numbered"))


def _execs_from_files(s: Spine):
    path = scratch_path(s.spark, "exec")
    evidence.exec_lines(s).select(F.col("line").alias("value")).write.text(path)
    execs = src.read_exec_log(s.spark, path).withColumnRenamed("source_file", "run_id")
    return extract.extract_cache_events(execs).groupBy("event_kind", "confidence").agg(F.count("*").alias("n"))


def _logs_from_files(s: Spine):
    path = scratch_path(s.spark, "logs")
    s.table("documents").select(F.col("source"), F.col("text").alias("value")).write.partitionBy("source").text(path)
    logs = src.read_logs(s.spark, f"{path}/*")
    return logs.groupBy(F.regexp_extract("source_file", "source=([^/]+)/", 1).alias("source")).agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def _incoming(s: Spine):
    o = s.table("orders")
    return o.select(
        F.concat(F.lit("run:"), F.col("o_custkey").cast("string")).alias("stable_key"), F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("run_group"), F.lit("completed").alias("status"), F.col("o_orderdate").cast("string").alias("created_at"))


def _upserted(s: Spine):
    """Two loads of keys that repeat within and across them: the first write stays."""
    root = scratch_path(s.spark, "spine")
    spine.create(s.spark, root)
    rows = _incoming(s)
    spine.upsert(rows.where("CAST(id AS BIGINT) % 2 = 0"), root, "runs")
    spine.upsert(rows, root, "runs")
    tables, reason = spine.open_or_reason(s.spark, root)
    assert reason is None, reason
    return tables["runs"].select("stable_key", "id", "confidence", F.size("evidence_refs").alias("refs"))


def _finalized(s: Spine):
    runs = _incoming(s).withColumns({"ended_at": F.lit(None).cast("string"), "updated_at": F.lit("t0"),
                                     "evidence_refs": F.array().cast("array<string>")})
    done = s.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.max("l_shipdate").cast("string").alias("ended_at"))
    results = done.where("CAST(id AS BIGINT) % 3 = 0").withColumns({
        "status": F.lit("failed"), "updated_at": F.lit("t1"), "evidence_refs": F.array(F.lit("run:x"))})
    return spine.finalize_runs(runs, results).select("id", "status", "ended_at", "updated_at")


def _upgraded(s: Spine):
    old, new = scratch_path(s.spark, "old"), scratch_path(s.spark, "new")
    rows = s.runs.select(F.col("id").cast("string").alias("id"), "stable_key", "status", F.col("run_group").cast("string").alias("run_group"))
    rows.write.parquet(f"{old}/runs")
    s.spark.range(1).select(F.lit(1).alias("version")).write.json(f"{old}/_meta")
    spine.upgrade(s.spark, old, new)
    tables, reason = spine.open_or_reason(s.spark, new)
    assert reason is None, reason
    return tables["runs"].groupBy("status", "confidence", F.col("scenario").isNull().alias("no_scenario")).agg(F.count("*").alias("n"))


def _projected(s: Spine):
    path = scratch_path(s.spark, "projection")
    spine.write_projection(rollup.cache_metrics(s.runs, s.cache_events), path)
    docs = s.spark.read.text(path)
    get = lambda f, t: F.get_json_object("value", f"$.{f}").cast(t)
    return docs.select(get("run_group", "bigint").alias("run_group"), get("hits", "bigint").alias("hits"), get("misses", "bigint").alias("misses"))


def _mirrored(s: Spine):
    out = scratch_path(s.spark, "mirror")
    docs = s.table("documents").select(
        F.concat(F.lit("/ev/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("doc_id") % 5 == 0, "binary").otherwise("text").alias("kind"), "text")
    spine.write_mirror(redact.scan(docs, "text", names=("email",)).select("path", "kind", "redacted"), "/ev", out)
    return s.spark.read.parquet(out).select("rel_path", F.sha2("text", 256).alias("sha256"))


def _logged(s: Spine):
    path = scratch_path(s.spark, "gc")
    report = s.runs.groupBy("mode").agg(F.count("*").alias("groups"))
    spine.append_gc_event(report, path)
    spine.append_gc_event(report, path)
    return s.spark.read.schema("mode string, groups bigint").json(path).groupBy("mode").agg(F.count("*").alias("events"), F.sum("groups").alias("groups"))


def _event_stream(s: Spine):
    path = scratch_path(s.spark, "stream")
    ts = F.col("ts").cast("timestamp")
    s.events.select(ts.alias("ts"), "id", "kind", "run_group", "status", "next_action").write.parquet(path)
    schema = "ts timestamp, id bigint, kind string, run_group string, status string, next_action string"
    return s.spark.readStream.schema(schema).parquet(path)


def _streamed_runs(s: Spine):
    root, landing = scratch_path(s.spark, "w1"), scratch_path(s.spark, "landing")
    spine.create(s.spark, root)
    _incoming(s).write.parquet(landing)
    stream = s.spark.readStream.schema("stable_key string, id string, run_group string, status string, created_at string").parquet(landing)
    jobs.ingest(stream, root, "runs", scratch_path(s.spark, "ckpt")).awaitTermination()
    return spine.open_or_reason(s.spark, root)[0]["runs"].groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("stable_key").alias("keys"))


def _shuffled_stream(s: Spine, batches: int = 4):
    """The events out of order: each comes up to an hour late, in several batches, and a mark ends the log."""
    path = scratch_path(s.spark, "stream")
    ts = F.col("ts").cast("timestamp")
    rows = s.events.select(ts.alias("ts"), F.col("id").cast("string").alias("id"), "kind", "run_group", "status", "next_action", F.col("source").cast("string").alias("source"))
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("id", "kind", "source"), F.lit(3600))
    ends = rows.agg(F.min(late).alias("a"), F.max(late).alias("b"), F.max("ts").alias("z")).first()
    wide = (ends.b - ends.a) // batches + 1
    for k in range(batches):
        part = rows.where((late >= ends.a + k * wide) & (late < ends.a + (k + 1) * wide))
        part.orderBy(F.xxhash64("id", "kind")).coalesce(1).write.mode("append").parquet(path)
    mark = s.spark.range(1).select((F.lit(ends.z) + F.expr("interval 1 day")).alias("ts"), F.lit("").alias("id"), F.lit(jobs.END).alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("run_group", "status", "next_action", "source")])
    mark.coalesce(1).write.mode("append").parquet(path)
    return s.spark.readStream.schema("ts timestamp, id string, kind string, run_group string, status string, next_action string, source string").option("maxFilesPerTrigger", 1).parquet(path)


def _streamed_members(s: Spine):
    out = scratch_path(s.spark, "w2")
    jobs.run_to(jobs.live_members(_shuffled_stream(s)), out, scratch_path(s.spark, "ckpt"))
    return s.spark.read.schema(jobs.MEMBER_ROW).parquet(out)


def _streamed_chapters(s: Spine):
    rows = jobs.chapters_so_far(_streamed_members(s))
    return rows.select("lineage", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_ts"), "open", "events")


def _streamed_hours(s: Spine):
    out = scratch_path(s.spark, "w3")
    jobs.run_to(jobs.hourly_counts(_event_stream(s)), out, scratch_path(s.spark, "ckpt"))
    rows = s.spark.read.schema("hour timestamp, kind string, n bigint").parquet(out)
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "kind", "n")


def _listed(rows, name: str, order: list[str], key: str, first: str):
    """Rows as one JSON document per ``key``: an envelope around a list whose first element is ``first``."""
    path = scratch_path(rows.sparkSession, name)
    lines = rows.select(key, F.lit(1).alias("at"), *order, F.concat(F.lit(","), F.to_json(F.struct(*[c for c in rows.columns if c != key]))).alias("value"))
    ends = rows.select(key).distinct().select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("at"), F.lit(v).alias("value")) for a, v in ((0, '{"meta": {"x": [{}]}, "%s": [%s' % (name, first)), (2, '], "tail": [{"name": "no"}]}'))])).alias("e"))
    both = lines.unionByName(ends.select(key, "e.*"), allowMissingColumns=True)
    both.repartition(key).sortWithinPartitions(key, "at", *order).select(key, "value").write.partitionBy(key).text(path)
    return f"{path}/*"


def _profile_rows(s: Spine):
    rows = s.table("lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_orderkey").alias("ts"), F.col("l_linenumber").alias("tid"), F.concat(F.lit("}{ "), F.col("l_linenumber").cast("string")).alias("name"))
    events = src.read_profile(s.spark, _listed(rows, "traceEvents", ["ts", "tid"], "mode", "7")).select("event_index", F.try_variant_get("event", "$.name", "string").alias("name"), F.try_variant_get("event", "$.ts", "bigint").alias("ts"))
    return events.groupBy("name").agg(F.count("*").alias("n"), F.sum("event_index").alias("places"), F.sum("ts").alias("ts"))


def _manifest_rows(s: Spine):
    rows = s.table("part").select(F.col("p_brand").alias("brand"), F.concat(F.lit("a]}"), F.col("p_partkey").cast("string")).alias("artifact_key"), F.col("p_partkey").alias("size_bytes"), F.col("p_name").alias("path"))
    return src.read_manifest(s.spark, _listed(rows, "artifacts", ["artifact_key"], "brand", "null")).select("artifact_key", "size_bytes", "path")


def _tree(s: Spine) -> str:
    """A folder with texts, JSON documents, and files that look like a database and like binary data."""
    path = scratch_path(s.spark, "tree")
    docs = s.table("documents")
    docs.select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(f"{path}/text")
    doc = docs.where("text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    doc.select(F.to_json(F.struct("n", "last")).alias("value"), "lang").repartition("lang").write.partitionBy("lang").text(f"{path}/json")
    for kind, head in (("database", "SQLite format 3\x00"), ("binary", "\x00")):
        docs.select("source", F.concat(F.lit(head), F.coalesce("text", F.lit(""))).alias("value")).repartition("source").write.partitionBy("source").text(f"{path}/{kind}")
    return path


def _inventory(s: Spine):
    files = src.file_inventory(s.spark, f"{_tree(s)}/text")
    return files.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "size", "sha256").where("source <> ''")


def _tree_kinds(s: Spine):
    rows = src.scan_tree(s.spark, _tree(s)).where(~F.col("path").contains("/_SUCCESS"))
    return rows.groupBy(F.regexp_extract("path", "/(text|json|database|binary)/[a-z]+=", 1).alias("folder"), "kind").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"))


def _agent_event_files(s: Spine):
    """Logs of calls, one file each; some lines are no JSON, some logs have no other ones."""
    path = scratch_path(s.spark, "calls")
    c = s.table("conversations").withColumn("call", F.col("conv_id") % 50)
    line = F.when((F.col("call") % 7 == 3) | (F.col("turn") == 1), F.concat(F.lit("no json "), "role")).otherwise(F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct(F.col("turn").alias("output_tokens")).alias("usage"))))
    c.select("call", "conv_id", "turn", line.alias("value")).repartition("call").sortWithinPartitions("call", "conv_id", "turn").select("call", "value").write.partitionBy("call").text(path)
    events = src.read_agent_events(s.spark, path)
    told = receipts.normalize_c(events).join(receipts.parsed_calls(events), "call_id")
    status = receipts.call_status(F.col("parsed"), F.col("is_error"), F.lit(0), F.col("api_error_status"), F.col("api_error_code"))
    return told.select(F.regexp_extract("call_id", "call=([0-9]+)", 1).cast("long").alias("call"), status.alias("status"), "num_turns", "output_tokens")


def _discovered(s: Spine):
    root = scratch_path(s.spark, "sources")
    for source in [r.source for r in s.table("documents").where("source IS NOT NULL").select("source").distinct().orderBy("source").collect()]:  # as many as there are sources
        s.spark.range(1).select(F.lit(source).alias("value")).coalesce(1).write.text(f"{root}/{source}/dataset")
    s.spark.range(1).select(F.lit("x").alias("value")).write.text(f"{root}/no_source/other")
    return src.discover_sources(s.spark, root, explicit=("/elsewhere/named/dataset",)).select("source", "reason")


QUERIES = {
    "S1_build_event_files": _events_from_files,
    "S2_exec_log_files": _execs_from_files,
    "S4_log_files": _logs_from_files,
    "S3_profile_rows": _profile_rows,
    "S5_agent_event_files": _agent_event_files,
    "S7_manifest_rows": _manifest_rows,
    "S8_file_inventory": _inventory,
    "S9_tree_kinds": _tree_kinds,
    "S12_discovered_sources": _discovered,
    "S13_S14_upserted_runs": _upserted,
    "S15_finalized_runs": _finalized,
    "S16_upgraded_dataset": _upgraded,
    "S17_projection_documents": _projected,
    "S18_redacted_mirror": _mirrored,
    "S19_retention_log": _logged,
    "W1_streamed_ingest": _streamed_runs,
    "W2_streamed_chapters": _streamed_chapters,
    "W3_streamed_hours": _streamed_hours,
}

_LBL = "concat('//b', l_partkey % 3, ':t')"
ORACLES = {
    "S1_build_event_files": f"""WITH e AS (SELECT {_LBL} AS label FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT {_LBL} FROM lineitem UNION ALL SELECT {_LBL} FROM lineitem WHERE l_linenumber % 3 = 0
 UNION ALL SELECT {_LBL} FROM lineitem UNION ALL SELECT NULL FROM orders UNION ALL SELECT NULL FROM orders) SELECT label, count(*) AS n, count(*) AS numbered FROM e GROUP BY 1""",
    "S2_exec_log_files": """SELECT CASE l_returnflag WHEN 'A' THEN 'remote_cache_hit' WHEN 'R' THEN 'cache_miss' ELSE 'action_cache_observed' END AS event_kind, CASE l_returnflag WHEN 'N' THEN 'low' ELSE 'high' END AS confidence, count(*) AS n FROM lineitem GROUP BY ALL""",
    "S4_log_files": """SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(replace(text, chr(10), '')))::BIGINT AS chars FROM documents GROUP BY 1""",
    "S3_profile_rows": """WITH r AS (SELECT concat('}{ ', l_linenumber) AS name, l_orderkey AS ts, 1 + row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem)
 SELECT name, count(*) AS n, sum(place)::BIGINT AS places, sum(ts)::BIGINT AS ts FROM r GROUP BY 1""",
    "S5_agent_event_files": """SELECT conv_id % 50 AS call, CASE WHEN conv_id % 50 % 7 = 3 THEN 'invalid_output' ELSE 'success' END AS status,
 nullif(count(*) FILTER (WHERE conv_id % 50 % 7 <> 3 AND turn <> 1), 0) AS num_turns, (sum(turn) FILTER (WHERE conv_id % 50 % 7 <> 3 AND turn <> 1))::BIGINT AS output_tokens FROM conversations GROUP BY 1, 2""",
    "S7_manifest_rows": "SELECT concat('a]}', p_partkey) AS artifact_key, p_partkey AS size_bytes, p_name AS path FROM part",
    "S8_file_inventory": """WITH t AS (SELECT source, string_agg(concat(text, chr(10)), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1) SELECT source, octet_length(encode(t)) AS size, sha256(t) AS sha256 FROM t""",
    "S9_tree_kinds": """WITH d AS (SELECT source, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY 1), j AS (SELECT lang, length(concat('{"n":', count(*), ',"last":', max(doc_id), '}')) + 1 AS chars FROM documents WHERE text IS NOT NULL GROUP BY 1)
 SELECT 'text' AS folder, 'text' AS kind, count(*) AS files, sum(chars)::BIGINT AS chars FROM d UNION ALL SELECT 'json', 'json', count(*), sum(chars)::BIGINT FROM j
 UNION ALL SELECT 'database', 'database', count(*), NULL FROM d UNION ALL SELECT 'binary', 'binary', count(*), NULL FROM d""",
    "S12_discovered_sources": "SELECT DISTINCT source, NULL::VARCHAR AS reason FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'named', NULL",
    "S13_S14_upserted_runs": """WITH r AS (SELECT concat('run:', o_custkey) AS stable_key, CAST(o_orderkey AS STRING) AS id, o_orderkey % 2 AS load, CAST(o_orderdate AS STRING) AS created_at FROM orders)
 SELECT stable_key, id, 'unknown' AS confidence, 0 AS refs FROM r QUALIFY row_number() OVER (PARTITION BY stable_key ORDER BY load, created_at, id) = 1""",
    "S15_finalized_runs": """SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN e IS NOT NULL THEN 'failed' ELSE 'completed' END AS status, e AS ended_at, CASE WHEN e IS NOT NULL THEN 't1' ELSE 't0' END AS updated_at
 FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS STRING) AS e FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1) x ON l_orderkey = o_orderkey""",
    "S16_upgraded_dataset": with_spine("runs", body="SELECT status, 'unknown' AS confidence, true AS no_scenario, count(*) AS n FROM runs GROUP BY 1"),
    "S17_projection_documents": with_spine("runs", "cache_events", body="SELECT run_group, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM runs r LEFT JOIN cache_events c ON c.run_id = r.id GROUP BY 1"),
    "S18_redacted_mirror": r"""SELECT concat(source, '/', doc_id) AS rel_path, sha256(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[REDACTED:email]', 'g')) AS sha256 FROM documents WHERE doc_id % 5 > 0""",
    "S19_retention_log": with_spine("runs", body="SELECT mode, 2 AS events, 2 * count(*) AS groups FROM runs GROUP BY 1"),
    "W1_streamed_ingest": "SELECT 'completed' AS status, count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS keys FROM orders",
    "W3_streamed_hours": with_spine("timeline", body="""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, kind, count(*) AS n FROM timeline
 WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM timeline) - INTERVAL 2 HOUR GROUP BY ALL"""),
}


def _chapters_sql() -> str:
    from evidmill.plans.timelines import _MEMBERS

    at = "strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS {c}".format
    return with_spine("timeline", body=_MEMBERS + f"SELECT lineage, {at(c='start_ts')}, {at(c='end_ts')}, open, events FROM chapters")


ORACLES["W2_streamed_chapters"] = _chapters_sql()
