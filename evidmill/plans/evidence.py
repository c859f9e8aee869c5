"""Evidence in its raw JSON form, derived from the driver tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidmill.plans.binding import Spine

# Event number of a line: unique within its order, four event types apart.
LINE_AT = "((l_partkey * 10 + l_linenumber) * 10000 + l_suppkey) * 4"
LABEL = "concat('//b', CAST(l_partkey % 3 AS STRING), ':t')"


def build_event_lines(s: Spine) -> DataFrame:
    """(run_id, event_index, line): JSON lines of build events, four kinds per order line, two per order."""
    l = s.lineitem
    conf = l.where("l_linenumber % 2 = 1").selectExpr(
        "l_orderkey AS run_id", f"{LINE_AT} + 1 AS event_index",
        f"concat('{{\"id\":{{\"targetConfigured\":{{\"label\":\"', {LABEL}, '\"}}}},\"configured\":{{\"targetKind\":\"kind ', CAST(l_linenumber AS STRING), '\"}}}}') AS line")
    act = l.selectExpr(
        "l_orderkey AS run_id", f"{LINE_AT} + 2 AS event_index",
        f"concat('{{\"id\":{{\"actionCompleted\":{{\"label\":\"', {LABEL}, '\",\"primaryOutput\":\"out/', CAST(l_suppkey % 4 AS STRING), '\"}}}},\"action\":{{',"
        " CASE l_returnflag WHEN 'A' THEN '\"success\":true,' WHEN 'R' THEN '\"success\":false,' ELSE '' END, '\"type\":\"M', CAST(l_linenumber AS STRING), '\"}}') AS line")
    test = l.where("l_linenumber % 3 = 0").selectExpr(
        "l_orderkey AS run_id", f"{LINE_AT} + 3 AS event_index",
        f"concat('{{\"id\":{{\"testResult\":{{\"label\":\"', {LABEL}, '\",\"run\":', CAST(l_linenumber AS STRING), ',\"shard\":1}}}},\"testResult\":{{\"status\":\"',"
        " CASE WHEN l_quantity < 25 THEN 'PASSED' ELSE 'FLAKY' END, '\",\"testActionOutput\":[{\"name\":\"test.log\",\"uri\":\"file:///ev/', CAST(l_suppkey AS STRING), '\",\"digest\":\"', sha2(CAST(l_partkey AS STRING), 256), '\",\"length\":\"', CAST(l_partkey AS STRING), '\"},{\"name\":\"group\"}]}}') AS line")
    done = l.selectExpr(
        "l_orderkey AS run_id", f"{LINE_AT} + 4 AS event_index",
        f"concat('{{\"id\":{{\"targetCompleted\":{{\"label\":\"', {LABEL}, '\"}}}},\"completed\":{{',"
        " CASE l_returnflag WHEN 'A' THEN '\"success\":true' WHEN 'R' THEN concat('\"success\":false', CASE WHEN l_linestatus = 'F' THEN concat(',\"failureDetail\":{\"message\":\"part ', CAST(l_partkey AS STRING), '\"}') ELSE '' END) ELSE '\"x\":1' END,"
        " CASE WHEN l_linenumber = 6 THEN ',\"outputGroup\":[{\"name\":\"default\",\"fileSets\":[{\"id\":\"1\"}],\"inlineFiles\":[{\"name\":\"inline.txt\",\"contents\":\"YWJj\"}]}]' ELSE '' END, '}}') AS line")
    o = s.table("orders")
    start = o.selectExpr(
        "o_orderkey AS run_id", "CAST(0 AS BIGINT) AS event_index",
        "concat('{\"id\":{\"started\":{}},\"started\":{', CASE o_orderkey % 4 WHEN 0 THEN concat('\"startTime\":\"', date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), 'Z\"')"
        " WHEN 1 THEN concat('\"startTimeMillis\":', CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) + 250 AS STRING)) WHEN 2 THEN concat('\"startTimeMillis\":\"', CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS STRING), '\"') ELSE '\"startTimeMillis\":true' END,"
        " CASE WHEN o_orderkey % 3 > 0 THEN concat(',\"buildToolVersion\":\"', CAST(6 + o_orderkey % 5 AS STRING), '.4.1\"') ELSE '' END,"
        " CASE o_orderkey % 7 WHEN 0 THEN ',\"optionsDescription\":\"--config=ci --digest_function=SHA-256\"' WHEN 1 THEN ',\"optionsDescription\":\"--digest-function blake3\"' WHEN 2 THEN ',\"optionsDescription\":\"--config=ci\"' ELSE '' END, '}}') AS line")
    end = o.selectExpr(
        "o_orderkey AS run_id", "CAST(4000000000000 AS BIGINT) AS event_index",
        "concat('{\"id\":{\"buildFinished\":{}},\"finished\":{\"exitCode\":{\"name\":\"', CASE o_orderstatus WHEN 'P' THEN 'BUILD_FAILURE' ELSE 'SUCCESS' END, '\",\"code\":', CASE o_orderstatus WHEN 'P' THEN '1' ELSE '0' END, '}}}') AS line")
    out = start
    for part in (conf, act, test, done, end):
        out = out.unionByName(part)
    return out


def build_events(s: Spine) -> DataFrame:
    return parsed(build_event_lines(s))


def exec_lines(s: Spine) -> DataFrame:
    """(run_id, event_index, line): spawn records, nested or flat, with and without a hit flag."""
    body = (
        "concat('{\"targetLabel\":\"', " + LABEL + ", '\",\"mnemonic\":\"M', CAST(l_linenumber % 2 AS STRING), '\",', CASE l_returnflag WHEN 'A' THEN '\"cacheHit\":true'"
        " WHEN 'R' THEN '\"runner\":\"Sandboxed\"' ELSE '\"runner\":\"other\"' END, CASE l_linenumber % 3 WHEN 0 THEN concat(',\"digest\":{\"hash\":\"h', CAST(l_partkey % 5 AS STRING), '\",\"sizeBytes\":', CAST(l_suppkey AS STRING), '}')"
        " WHEN 1 THEN concat(',\"digest\":\"d', CAST(l_partkey % 5 AS STRING), '\"') ELSE '' END, '}')"
    )
    return s.lineitem.selectExpr(
        "l_orderkey AS run_id", f"{LINE_AT} AS event_index",
        f"CASE l_linenumber % 2 WHEN 0 THEN concat('{{\"spawnExec\":', {body}, '}}') ELSE {body} END AS line")


def trace_lines(s: Spine) -> DataFrame:
    """(run_id, event_index, line): profile rows; those without a label are to be dropped."""
    return s.lineitem.selectExpr(
        "l_orderkey AS run_id", f"{LINE_AT} AS event_index",
        "concat('{\"name\":\"', CASE l_returnflag WHEN 'A' THEN 'Remote Cache Hit' ELSE 'action' END, '\",\"ts\":', CAST(l_suppkey AS STRING), ',\"args\":{', CASE WHEN l_linenumber < 6 THEN concat('\"target\":\"', " + LABEL + ", '\"') ELSE '\"x\":1' END, '}}') AS line")


def parsed(lines: DataFrame) -> DataFrame:
    """Parsed rows. As in the file readers the event comes out of a generator, so a
    filter on its fields is not pushed below the parse and does not repeat it."""
    return lines.select("run_id", "event_index", F.explode(F.array(F.parse_json("line"))).alias("event"))


def agent_results_a(s: Spine) -> DataFrame:
    """First result family: conversations with number 0 modulo 3."""
    calls = s.agent_blocks.where("run_id % 3 = 0")
    raw = _responses(s).join(calls.select("run_id", "turns"), "run_id")
    doc = F.to_json(F.struct(
        F.col("response").alias("result"),
        F.when(F.col("run_id") % 5 > 0, F.concat(F.lit("s"), F.col("run_id").cast("string"))).alias("session_id"),
        F.map_from_arrays(F.when(F.col("run_id") % 4 == 0, F.array(F.lit("m-b"), F.lit("m-a"))).otherwise(F.array(F.lit("m-a"))),
                          F.when(F.col("run_id") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("modelUsage"),
        F.struct((F.col("turns") * 10).alias("input_tokens"), F.col("turns").alias("output_tokens")).alias("usage"),
        F.col("turns").alias("num_turns"), (F.col("run_id") % 11 == 0).alias("is_error"),
        F.when(F.col("run_id") % 22 == 0, 529).alias("api_error_status")))
    return raw.select(F.col("run_id").alias("call_id"), F.parse_json(doc).alias("result"))


def _responses(s: Spine) -> DataFrame:
    bot = F.col("role") == "assistant"
    return s.table("conversations").groupBy(F.col("conv_id").alias("run_id")).agg(
        F.max_by("text", F.when(bot, F.col("turn"))).alias("response"))


def agent_results_b(s: Spine) -> DataFrame:
    """Second family: a token map per model, sometimes an error with a numeric or symbolic code."""
    rows = _responses(s).join(s.agent_blocks.select("run_id", "turns"), "run_id").where("run_id % 3 = 1")
    tokens = lambda p, c, k: F.struct(F.struct(p.alias("prompt"), c.alias("candidates"), k.alias("cached")).alias("tokens"))
    t, r = F.col("turns"), F.col("run_id")
    models = F.when(r % 4 == 0, F.create_map(
        F.lit("g-1"), tokens(t * 100, t, t * 30), F.lit("g-2"), tokens(t, t * 2, t * 5))).otherwise(
        F.create_map(F.lit("g-1"), tokens(t * 100, t, t * 30)))
    error = F.when(r % 10 == 0, '{"type":"ApiError","message":"m","code":429}').when(r % 10 == 1, '{"message":"m","code":"PERMISSION_DENIED"}')
    text = F.to_json(F.struct(F.col("response"), F.concat(F.lit("s"), r.cast("string")).alias("session_id"),
                              F.struct(models.alias("models")).alias("stats")))
    doc = F.when(error.isNull(), text).otherwise(F.concat(F.substring(text, 1, 1), F.lit('"error":'), error, F.lit(","), F.substr(text, F.lit(2))))
    return rows.select(r.alias("call_id"), F.parse_json(doc).alias("result"))


def agent_events_c(s: Spine) -> DataFrame:
    """Third family: one event per conversation turn, with thread start, turn end and failure events."""
    c = s.table("conversations").where("conv_id % 3 = 2")
    call, at = F.col("conv_id").alias("call_id"), F.col("turn") * 4
    start = c.where("turn = 0").select(call, at.alias("idx"), F.concat(F.lit('{"type":"thread.started","thread_id":"t'), F.col("conv_id").cast("string"), F.lit('"'),
        F.when(F.col("conv_id") % 2 == 0, ',"model":"x-1"').otherwise(""), F.lit("}")).alias("line"))
    bot = c.where("role = 'assistant'")
    said = bot.select(call, (at + 1).alias("idx"), F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(F.lit("agent_message").alias("type"), F.col("text")).alias("item"))).alias("line"))
    done = bot.select(call, (at + 2).alias("idx"), F.concat(F.lit('{"type":"turn.completed","usage":{"input_tokens":'), F.length("text").cast("string"),
        F.lit(',"cached_input_tokens":'), (F.col("turn") * 50).cast("string"), F.lit(',"output_tokens":'), F.col("turn").cast("string"), F.lit("}}")).alias("line"))
    bad = c.where("turn = 1 AND conv_id % 5 = 0").select(call, (at + 3).alias("idx"), F.lit('{"type":"turn.failed","error":{"message":"{\\"type\\":\\"error\\",\\"status\\":400,\\"error\\":{\\"type\\":\\"invalid_request_error\\"}}"}}').alias("line"))
    rows = start.unionByName(said).unionByName(done).unionByName(bad)
    return rows.select("call_id", "idx", F.parse_json("line").alias("event"))
