"""Agent call receipts: three result families, status, provenance, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions.digests import is_sha256_hex, json_string
from evidmill.functions import json_spans
from evidmill.operators.extract import boolean, is_object, raw, text

# Command names that count as live agent calls, one per result family.
LIVE_CLIS = ("claude", "gemini", "codex")
# Keys that must not occur anywhere in a receipt.
FORBIDDEN_KEYS = ("prompt", "raw_prompt", "prompt_text", "system_prompt")
SCHEMA_VERSION = "agent_receipt.v1"

# Columns of every normalised call.
CALL_COLUMNS = (
    "call_id", "response_text", "models", "session_id", "input_tokens", "output_tokens", "cache_creation_tokens",
    "cache_read_tokens", "num_turns", "result_subtype", "api_error_status", "api_error_code", "is_error",
)


def whole(v: Column | str, path: str) -> Column:
    """A JSON integer; text, booleans and fractions are NULL."""
    value = raw(v, path)
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def string(v: Column | str, path: str) -> Column:
    """A JSON string, NULL for any other type."""
    return F.when(F.schema_of_variant(raw(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def normalize_a(calls: DataFrame) -> DataFrame:
    """One model map and one usage object. ``calls``: call_id, result VARIANT."""
    r = "result"
    models = F.when(is_object(r, "$.modelUsage"), F.array_sort(F.map_keys(F.try_variant_get(r, "$.modelUsage", "map<string,variant>"))))
    return calls.select(
        "call_id", string(r, "$.result").alias("response_text"),
        F.coalesce(models, F.array().cast("array<string>")).alias("models"), text(r, "$.session_id").alias("session_id"),
        whole(r, "$.usage.input_tokens").alias("input_tokens"), whole(r, "$.usage.output_tokens").alias("output_tokens"),
        whole(r, "$.usage.cache_creation_input_tokens").alias("cache_creation_tokens"),
        whole(r, "$.usage.cache_read_input_tokens").alias("cache_read_tokens"), whole(r, "$.num_turns").alias("num_turns"),
        text(r, "$.subtype").alias("result_subtype"), whole(r, "$.api_error_status").alias("api_error_status"),
        F.lit(None).cast("string").alias("api_error_code"), F.coalesce(boolean(r, "$.is_error"), F.lit(False)).alias("is_error"),
    )


def _total(values: Column) -> Column:
    """Sum of the non-NULL values; NULL, not zero, when there is none."""
    known = F.array_compact(values)
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x))


def normalize_b(calls: DataFrame) -> DataFrame:
    """A token map per model; input is net of cache."""
    r = "result"
    table = F.when(is_object(r, "$.stats.models"), F.try_variant_get(r, "$.stats.models", "map<string,variant>"))
    rows = calls.withColumn("_m", F.coalesce(table, F.create_map().cast("map<string,variant>")))
    each = lambda fn: _total(F.transform(F.map_values("_m"), fn))
    net = lambda v: F.coalesce(
        F.greatest(whole(v, "$.tokens.input"), F.lit(0)) + F.nullif(whole(v, "$.tokens.input") * 0, F.lit(1)),
        F.greatest(whole(v, "$.tokens.prompt") - F.coalesce(whole(v, "$.tokens.cached"), F.lit(0)), F.lit(0))
        + whole(v, "$.tokens.prompt") * 0,
    )
    failed = is_object(r, "$.error")
    symbolic = F.nullif(string(r, "$.error.code"), F.lit(""))
    return rows.select(
        "call_id", string(r, "$.response").alias("response_text"), F.array_sort(F.map_keys("_m")).alias("models"),
        text(r, "$.session_id").alias("session_id"), each(net).alias("input_tokens"),
        each(lambda v: whole(v, "$.tokens.candidates")).alias("output_tokens"),
        F.lit(None).cast("bigint").alias("cache_creation_tokens"), each(lambda v: whole(v, "$.tokens.cached")).alias("cache_read_tokens"),
        F.lit(None).cast("bigint").alias("num_turns"),
        F.when(failed, F.coalesce(text(r, "$.error.type"), symbolic)).alias("result_subtype"),
        whole(r, "$.error.code").alias("api_error_status"), F.when(failed, symbolic).alias("api_error_code"), failed.alias("is_error"),
    )


def normalize_c(events: DataFrame) -> DataFrame:
    """An event list, one row per event: call_id, idx, event VARIANT.

    Everything is an aggregate over the events, so a call may have any number.
    """
    e = "event"
    kind, item = text(e, "$.type"), text(e, "$.item.type")
    turn = kind == "turn.completed"
    message = F.when(kind == "turn.failed", string(e, "$.error.message")).when(kind == "error", string(e, "$.message")).when(
        (kind == "item.completed") & (item == "error"), string(e, "$.item.message"))
    gross, cached = whole(e, "$.usage.input_tokens"), whole(e, "$.usage.cached_input_tokens")
    rows = events.select(
        "call_id", "idx", turn.alias("turn"),
        F.when(kind == "thread.started", F.nullif(string(e, "$.thread_id"), F.lit(""))).alias("thread"),
        F.when((kind == "item.completed") & (item == "agent_message"), string(e, "$.item.text")).alias("answer"),
        F.when(kind.isin("thread.started", "turn.started", "turn.completed"), F.nullif(string(e, "$.model"), F.lit(""))).alias("model"),
        F.when(turn & gross.isNotNull(), F.greatest(gross - F.coalesce(cached, F.lit(0)), F.lit(0))).alias("net"),
        F.when(turn, whole(e, "$.usage.output_tokens")).alias("out"), F.when(turn, cached).alias("cached"),
        message.alias("message"), F.when(kind == "turn.failed", 0).otherwise(1).alias("rank"),
        (kind.isin("turn.failed", "error") | ((kind == "item.completed") & (item == "error"))).alias("bad"),
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("idx"))
    calls = rows.groupBy("call_id").agg(
        F.min_by("thread", at("thread")).alias("session_id"), F.max_by("answer", at("answer")).alias("response_text"),
        F.array_sort(F.collect_set("model")).alias("models"),  # distinct models of a call, a handful
        F.sum("net").alias("input_tokens"), F.sum("out").alias("output_tokens"), F.sum("cached").alias("cache_read_tokens"),
        F.nullif(F.count_if("turn"), F.lit(0)).alias("num_turns"), F.bool_or(F.coalesce("bad", F.lit(False))).alias("bad"),
        F.min_by("message", F.when(F.col("message").isNotNull(), F.struct("rank", "idx"))).alias("message"),
    ).withColumn("_e", F.try_parse_json("message"))
    subtype = F.coalesce(string("_e", "$.error.type"), string("_e", "$.type"))
    return calls.select(
        "call_id", "response_text", "models", "session_id", "input_tokens", "output_tokens",
        F.lit(None).cast("bigint").alias("cache_creation_tokens"), "cache_read_tokens", "num_turns",
        F.when(is_object("_e", "$"), F.nullif(subtype, F.lit(""))).alias("result_subtype"),
        F.when(is_object("_e", "$"), whole("_e", "$.status")).alias("api_error_status"),
        F.lit(None).cast("string").alias("api_error_code"), F.col("bad").alias("is_error"),
    )


def parsed_calls(events: DataFrame) -> DataFrame:
    """``call_id, parsed``: whether any line of a call was an event."""
    return events.groupBy("call_id").agg(F.bool_or(F.col("event").isNotNull()).alias("parsed"))


# Result family by name; a new family is one more entry.
FAMILIES = {"claude": normalize_a, "gemini": normalize_b, "codex": normalize_c}


def family_of(cli_name: Column) -> Column:
    """Result family of a command name; an unknown name reads like the first family."""
    lowered = F.lower(F.coalesce(cli_name, F.lit("")))
    return F.when(lowered.contains("gemini"), "gemini").when(lowered.contains("codex"), "codex").otherwise("claude")


def call_status(parsed: Column, is_error: Column, exit_code: Column, api_status: Column, api_code: Column) -> Column:
    """Outcome of one call."""
    bad = is_error | (F.coalesce(exit_code, F.lit(0)) != 0)
    signalled = F.coalesce(api_status != 0, F.lit(False)) | F.coalesce(api_code != "", F.lit(False))
    return F.when(~parsed, "invalid_output").when(bad & signalled, "api_error").when(bad, "cli_error").otherwise("success")


def build_receipts(calls: DataFrame) -> DataFrame:
    """Receipts. ``calls``: CALL_COLUMNS with cli_name, cli_version, requested_model,
    prompt_sha256, captured_at, status and command (array)."""
    response = F.when(F.col("response_text").isNotNull(), F.sha2("response_text", 256))
    resolved = F.when(F.size("models") == 1, F.get("models", F.lit(0)))
    rows = calls.withColumns({"response_sha256": response, "model_resolved": F.nullif(resolved, F.lit(""))})
    missing = F.array_compact(F.array(
        F.when(F.col("response_sha256").isNull(), "response"), F.when(F.col("model_resolved").isNull(), "model.resolved"),
        F.when(F.col("session_id").isNull(), "session_id"),
    ))
    short = (F.col("status") == "success") & (F.size(missing) > 0)
    rows = rows.withColumns({
        "detail": F.when(short, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        "status": F.when(short, "invalid_output").otherwise(F.col("status")),
    })
    live = F.col("cli_name").isin(*LIVE_CLIS) & (F.col("status") == "success")
    collected = live | (F.col("status") != "success")
    ref = lambda tag, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(tag), F.col(c)))
    refs = F.array_compact(F.array(
        ref("prompt:sha256:", "prompt_sha256"), ref("cli:", "cli_name"), ref("response:sha256:", "response_sha256"), ref("session:", "session_id")
    ))
    return rows.withColumns({
        "live": live, "response_chars": F.length("response_text"),
        "source_kind": F.when(collected, "collectable_v1").otherwise("simulated_v1"),
        "confidence": F.when(collected, "high").otherwise("medium"),
        "evidence_refs": refs, "redaction_state": F.lit("redacted"),
    }).drop("response_text")


def _json(value) -> Column:
    """JSON text with sorted keys and a blank after each separator, for content hashes."""
    if isinstance(value, dict):
        parts = []
        for i, name in enumerate(sorted(value)):
            parts += [F.lit((", " if i else "") + f'"{name}": '), _json(value[name])]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    kind, col = value
    body = {
        "s": lambda: json_string(col), "n": lambda: col.cast("string"), "b": lambda: F.when(col, "true").otherwise("false"),
        "l": lambda: F.concat(F.lit("["), F.array_join(F.transform(col, json_string), ", "), F.lit("]")),
    }[kind]()
    return F.coalesce(body, F.lit("null"))


def receipt_json(schema_version: str = SCHEMA_VERSION) -> Column:
    """The receipt document as sorted-key JSON text."""
    s, n, l = (lambda c: ("s", F.col(c))), (lambda c: ("n", F.col(c))), (lambda c: ("l", F.col(c)))
    base = {
        "schema_version": ("s", F.lit(schema_version)), "captured_at": s("captured_at"), "status": s("status"),
        "cli": {"name": s("cli_name"), "version": s("cli_version"), "command": l("command")},
        "prompt_sha256": s("prompt_sha256"), "response_sha256": s("response_sha256"), "response_chars": n("response_chars"),
        "model": {"requested": s("requested_model"), "resolved": s("model_resolved"), "resolved_all": l("models")},
        "session_id": s("session_id"),
        "usage": {"input_tokens": n("input_tokens"), "output_tokens": n("output_tokens"),
                  "cache_creation_input_tokens": n("cache_creation_tokens"), "cache_read_input_tokens": n("cache_read_tokens")},
        "num_turns": n("num_turns"), "duration_ms": ("n", F.lit(None)), "duration_api_ms": ("n", F.lit(None)),
        "total_cost_usd": ("n", F.lit(None)), "result_subtype": s("result_subtype"), "api_error_status": n("api_error_status"),
        "api_error_code": s("api_error_code"), "source_kind": s("source_kind"), "confidence": s("confidence"),
        "evidence_refs": l("evidence_refs"), "redaction_state": s("redaction_state"),
    }
    with_detail = _json({**base, "detail": s("detail")})
    return F.when(F.col("detail").isNotNull(), with_detail).otherwise(_json(base))


def receipt_summary(receipts: DataFrame) -> DataFrame:
    """The compact summary with a stable content hash."""
    return receipts.withColumn("receipt_sha256", F.sha2(receipt_json(), 256)).select(
        "call_id", "status", "captured_at", "session_id", "model_resolved", "requested_model", "prompt_sha256",
        "response_sha256", "receipt_sha256", "input_tokens", "output_tokens", "num_turns", "cli_name", "cli_version", "live",
    )


def provenance_class(has_receipt: Column, live: Column, imported: Column) -> Column:
    """Verified, stub, asserted; an imported receipt is never more than imported."""
    return (
        F.when(imported, "receipt_imported_v1").when(~has_receipt, "operator_asserted_v1")
        .when(live, "receipt_verified_v1").otherwise("stub_receipt_v1")
    )


def provenance_blocks(sidecars: DataFrame, summaries: DataFrame, applied: DataFrame) -> DataFrame:
    """Provenance rows. ``sidecars``: run_id, call_id, agent_name, operator_model, scenario, prompt_sha256;
    ``applied`` is V6 per run."""
    names = [c for c in summaries.columns if c not in ("call_id", "prompt_sha256")]
    receipts = summaries.select("call_id", *[F.col(c).alias(f"r_{c}") for c in names], F.lit(True).alias("has_receipt"))
    rows = sidecars.join(receipts, "call_id", "left").join(applied.select("run_id", "patch_applied"), "run_id", "left")
    has, live = F.coalesce("has_receipt", F.lit(False)), F.coalesce("r_live", F.lit(False))
    stub = has & ~live
    refs = F.array_compact(F.array(
        F.concat(F.lit("scenario:"), "scenario"), F.concat(F.lit("agent:"), "agent_name"),
        F.concat(F.lit("run:"), F.col("run_id").cast("string")), F.concat(F.lit("prompt:sha256:"), "prompt_sha256"),
        F.when(has, F.lit("artifact:agent-receipt.json")), F.when(has, F.concat(F.lit("receipt:sha256:"), "r_receipt_sha256")),
        F.when(has & F.col("r_session_id").isNotNull(), F.concat(F.lit("session:"), "r_session_id")),
    ))
    return rows.select(
        "run_id", "call_id", "agent_name",
        F.when(live, F.coalesce("r_model_resolved", "operator_model")).otherwise(F.col("operator_model")).alias("model"),
        "operator_model", "prompt_sha256", provenance_class(has, live, F.lit(False)).alias("provenance_class"),
        F.coalesce("patch_applied", F.lit(False)).alias("patch_applied"), refs.alias("evidence_refs"),
        F.when(stub, "simulated_v1").otherwise("collectable_v1").alias("source_kind"),
        F.when(stub, "medium").otherwise("high").alias("confidence"), F.lit("safe").alias("redaction_state"),
    )


def import_receipts(summaries: DataFrame, wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Receipts attached to the latest run of the named group. ``wanted``: call_id, run_group."""
    last = runs.groupBy("run_group").agg(
        F.max_by("id", F.struct(F.struct(F.col("started_at").isNotNull().alias("h"), F.col("started_at").alias("v")), "created_at", "id")).alias("run_id")
    )
    return wanted.join(last, "run_group").join(summaries.drop("live"), "call_id").select(
        "run_id", "run_group", "call_id", "status", "receipt_sha256", F.lit(False).alias("live"),
        F.lit("receipt_imported_v1").alias("provenance_class"), F.lit("medium").alias("confidence"),
    )


def run_key_conflicts(incoming: DataFrame, runs: DataFrame) -> DataFrame:
    """Incoming run keys that already belong to another group."""
    known = runs.select("stable_key", F.col("run_group").alias("known_group"))
    return incoming.join(known, "stable_key").where(~F.col("run_group").eqNullSafe(F.col("known_group"))).select(
        "stable_key", "run_group", "known_group")


def violations(receipts: DataFrame) -> DataFrame:
    """What makes a receipt invalid; an empty list is a valid one."""
    ok = F.col("status") == "success"
    none = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("")) == ""
    checks = {
        "captured_at": none("captured_at"), "status": none("status"), "prompt_sha256": ~is_sha256_hex(F.col("prompt_sha256")),
        "cli.name": none("cli_name"), "response_sha256": ok & ~is_sha256_hex(F.col("response_sha256")),
        "session_id": ok & none("session_id"), "model.resolved": ok & none("model_resolved"),
    }
    return receipts.select("call_id", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()])).alias("violations"))


def forbidden_keys(docs: DataFrame, key: str, json_text: str) -> DataFrame:
    """Forbidden keys at any depth with their path. Text that is no JSON gives one row without ``name``.

    Only documents that may hold one (an escape may hide a name), and those that don't parse, are read key by key.
    """
    named = F.col(json_text).rlike('"(?:' + "|".join(FORBIDDEN_KEYS) + r')"\s*:') | F.col(json_text).contains("\\u")
    rows = json_spans.tokens(docs.where(named | F.try_parse_json(json_text).isNull()), key, json_text)
    keys = rows.where(F.col("location") == "key").where(F.col("text").isin(*FORBIDDEN_KEYS)).select(key, F.regexp_replace("path", "<key>$", "").alias("path"), F.col("text").alias("name"))
    return keys.unionByName(rows.where(F.col("location") == "text").select(key, "path", F.lit(None).cast("string").alias("name")))
