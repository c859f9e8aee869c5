"""Evidence extraction: build events, execution logs, profiles and worker logs to spine rows.

Event rows are ``(run_id, event_index, event VARIANT)`` with a 1-based index in file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions import digests

# Tested major versions, and the message formats of failures.
TESTED_MAJORS = (7, 9)
TARGET_FAILED = "%s completed unsuccessfully"
BUILD_FAILED = "Bazel finished with %s (exit code %s)"
# Services a worker configuration must offer.
REQUIRED_SERVICES = ("ac", "capabilities", "cas", "execution", "worker_api")
# Run outcome, worst last.
OUTCOMES = ("completed", "failed", "timeout", "configuration_blocker", "environment_blocker")


def text(v: Column | str, path: str) -> Column:
    """A value as text; empty text is NULL."""
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def raw(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def boolean(v: Column | str, path: str) -> Column:
    """A JSON boolean, NULL for any other type (text ``"true"`` is not one)."""
    value = raw(v, path)
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(v, path, "boolean"))


def is_object(v: Column | str, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(raw(v, path)).startswith("OBJECT"), F.lit(False))


def items(v: Column | str, path: str) -> Column:
    """A list as ``ARRAY<VARIANT>``; a single object is a list of one, absence an empty list."""
    kind = F.schema_of_variant(raw(v, path))
    many = F.try_variant_get(v, path, "array<variant>")
    return F.when(kind.startswith("ARRAY"), many).when(kind.startswith("OBJECT"), F.array(raw(v, path))).otherwise(
        F.array().cast("array<variant>")
    )


def bep_label(event: str = "event") -> Column:
    """Label from the id, then from the payload."""
    ids = ("targetConfigured", "targetCompleted", "testResult", "actionCompleted")
    payloads = ("configured", "completed", "testResult", "action")
    return F.coalesce(*[text(event, f"$.id.{k}.label") for k in ids], *[text(event, f"$.{k}.label") for k in payloads])


def once(df: DataFrame, *keep: str, **values: Column) -> DataFrame:
    """``keep`` and ``values``, each value computed once per row: filters on them don't bring the lookups back."""
    bound = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_v")
    return df.select(*keep, bound).select(*keep, *[F.col(f"_v.{n}").alias(n) for n in values])


def fields(v: Column, *names: str) -> Column:
    """The named members of an object as VARIANT columns of a struct, found in one pass."""
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"{n}:variant" for n in names) + ">")


def labelled(events: DataFrame) -> DataFrame:
    return once(events, *events.columns, label=bep_label())


def extract_targets(events: DataFrame) -> DataFrame:
    """One row per (run, label), folded in event order by aggregates."""
    e = once(
        events, "run_id", "event_index", label=bep_label(), is_conf=raw("event", "$.configured").isNotNull(),
        is_test=raw("event", "$.testResult").isNotNull(), is_done=raw("event", "$.completed").isNotNull(),
        conf_kind=text("event", "$.configured.targetKind"), done_kind=text("event", "$.completed.targetKind"),
        test_status=text("event", "$.testResult.status"), ok=boolean("event", "$.completed.success"),
    ).where("label IS NOT NULL AND (is_conf OR is_test OR is_done)")
    i = F.col("event_index")
    sets_kind = F.col("is_conf") | F.col("done_kind").isNotNull()
    kind = F.struct(F.coalesce("done_kind", "conf_kind").alias("k"))
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    hard = failed | F.col("is_test")
    status = F.when(failed, "FAILED").otherwise(F.coalesce("test_status", F.lit("UNKNOWN")))
    folded = e.groupBy("run_id", "label").agg(
        F.max_by(kind, F.when(sets_kind, i)).alias("kind"),
        F.max_by(status, F.when(hard, i)).alias("hard"),
        F.bool_or(F.coalesce("ok", F.lit(False))).alias("passed"), F.bool_or("is_conf").alias("configured"),
    )
    soft = F.when(F.col("passed"), "PASSED").when(F.col("configured"), "CONFIGURED")
    return folded.select("run_id", "label", F.col("kind.k").alias("target_kind"), F.coalesce("hard", soft).alias("status"))


def extract_actions(events: DataFrame) -> DataFrame:
    """Actions and test attempts; a later event with the same key replaces an earlier one."""
    i, label = F.col("event_index"), F.col("label")
    key = F.coalesce(text("event", "$.id.actionCompleted.id"), text("event", "$.id.actionCompleted.primaryOutput"), i.cast("string"))
    part = lambda n: F.concat(F.lit(f":{n}="), F.coalesce(text("event", f"$.id.testResult.{n}"), F.lit("1")))
    has = lambda name: raw("event", f"$.{name}").isNotNull()
    # An event may be both: it is read once and gives up to two rows.
    e = once(
        events, "run_id", "event_index", label=F.when(has("action") | has("testResult"), bep_label()),
        action=F.when(has("action"), F.struct(
            key.alias("key"), F.coalesce(text("event", "$.action.type"), text("event", "$.action.mnemonic")).alias("mnemonic"),
            boolean("event", "$.action.success").alias("ok"))),
        test=F.when(has("testResult"), F.struct(
            F.concat(part("run"), part("shard"), part("attempt")).alias("key"), F.coalesce(text("event", "$.testResult.status"), F.lit("UNKNOWN")).alias("status"))),
    ).where("label IS NOT NULL")
    plain = F.when(F.col("action").isNotNull(), F.struct(
        F.concat(label, F.lit(":action:"), F.col("action.key")).alias("action_key"), F.col("action.mnemonic").alias("mnemonic"),
        F.when(F.col("action.ok"), "SUCCESS").when(~F.col("action.ok"), "FAILED").alias("status")))
    tests = F.when(F.col("test").isNotNull(), F.struct(
        F.concat(label, F.lit(":test"), F.col("test.key")).alias("action_key"), F.lit("BazelTest").alias("mnemonic"), F.col("test.status").alias("status")))
    rows = e.select("run_id", "event_index", "label", F.explode(F.array_compact(F.array(plain, tests))).alias("r"))
    return rows.groupBy("run_id", F.col("r.action_key").alias("action_key")).agg(
        F.max_by(F.struct(F.col("label").alias("target_label"), F.col("r.mnemonic").alias("mnemonic"), F.col("r.status").alias("status")), i).alias("a")
    ).select("run_id", "action_key", "a.*")


def extract_failures(events: DataFrame) -> DataFrame:
    """Failed targets and failed builds."""
    e = labelled(events)
    i = F.col("event_index").cast("string")
    detail = F.coalesce(
        text("event", "$.completed.failureDetail.message"),
        F.when(F.schema_of_variant(raw("event", "$.completed.failureDetail")) == "STRING", text("event", "$.completed.failureDetail")),
        F.format_string(TARGET_FAILED, F.col("label")),
    )
    targets = e.where(F.col("label").isNotNull() & ~boolean("event", "$.completed.success")).select(
        "run_id", "event_index", F.concat("label", F.lit(":target_completed:"), i).alias("failure_key"),
        F.lit("target_completed").alias("failure_kind"), detail.alias("message"),
    )
    name = F.coalesce(text("event", "$.finished.exitCode.name"), F.lit("UNKNOWN"))
    code = text("event", "$.finished.exitCode.code")
    builds = e.where(raw("event", "$.finished").isNotNull()).where((name != "SUCCESS") | (F.coalesce(code, F.lit("0")) != "0")).select(
        "run_id", "event_index", F.concat(F.lit("build_finished:"), i, F.lit(":"), name).alias("failure_key"),
        F.lit("build_finished").alias("failure_kind"),
        F.format_string(BUILD_FAILED, name, F.coalesce(code, F.lit("None"))).alias("message"),
    )
    return targets.unionByName(builds)


# Keys that tell a file from an output group.
FILE_KEYS = ("uri", "name", "digest", "pathPrefix", "symlinkTargetPath", "contents")
FILE_SIGNALS = ("uri", "digest", "pathPrefix", "length", "symlinkTargetPath", "contents")


def _is_file(v: Column) -> Column:
    has = lambda k: raw(v, f"$.{k}").isNotNull()
    either = lambda keys: F.greatest(*[has(k) for k in keys])
    group = has("fileSets") | (has("name") & ~either(FILE_SIGNALS))
    return either(FILE_KEYS) & ~group


def extract_references(events: DataFrame) -> DataFrame:
    """E5: files named by events; output groups are rejected, the first observation wins."""
    inline = F.flatten(F.transform(items("event", "$.completed.outputGroup"), lambda g: items(g, "$.inlineFiles")))
    files = F.filter(
        F.concat(items("event", "$.namedSetOfFiles.files"), items("event", "$.testResult.testActionOutput"),
                 items("event", "$.completed.importantOutput"), inline),
        _is_file,
    )
    rows = labelled(events).select("run_id", "event_index", "label", F.posexplode(files).alias("slot", "file"))
    rows = rows.select(
        "run_id", "event_index", "slot", "label", text("file", "$.name").alias("name"), text("file", "$.uri").alias("uri"),
        text("file", "$.symlinkTargetPath").alias("symlink_target"), text("file", "$.contents").alias("contents"),
        digests.declared_digest(F.col("file")).alias("declared_digest"), digests.declared_size(F.col("file")).alias("declared_size"),
    ).where("coalesce(name, uri, symlink_target, contents) IS NOT NULL")
    number = (F.col("event_index") * 1000 + F.col("slot")).cast("string")
    key = F.concat(F.coalesce("label", F.lit("build")), F.lit(":artifact:"), F.coalesce("name", "uri", number))
    rest = F.struct("label", "name", "uri", "symlink_target", "contents", "declared_digest", "declared_size")
    return rows.groupBy("run_id", key.alias("reference_key")).agg(
        F.min_by(rest, F.struct("event_index", "slot")).alias("r")
    ).select("run_id", "reference_key", "r.*")


def spawn_of(event: str = "event") -> Column:
    """The spawn payload: nested, or the event itself when it looks like one."""
    flat = F.greatest(*[raw(event, f"$.{k}").isNotNull() for k in ("mnemonic", "targetLabel", "cacheHit", "runner")])
    return F.when(is_object(event, "$.spawnExec"), raw(event, "$.spawnExec")).when(
        is_object(event, "$.spawn"), raw(event, "$.spawn")).when(flat, F.col(event))


# Members of a spawn that are read.
DIGEST_FIELDS = ("digest", "actionDigest", "listedOutputs", "actualOutputs")
HIT_FIELDS = ("cacheHit", "remoteCacheHit", "remote_cache_hit")
SPAWN_FIELDS = (*HIT_FIELDS, *DIGEST_FIELDS, "runner", "targetLabel", "target_label", "label", "mnemonic")


def digest_of(payload: str) -> Column:
    """Digest text, ``hash/size``, hash, or the first output; ``payload`` is a struct with DIGEST_FIELDS."""
    def one(key: str) -> Column:
        at = F.col(f"{payload}.{key}")
        h = F.coalesce(text(at, "$.hash"), text(at, "$.sha256"))
        size = F.coalesce(F.nullif(text(at, "$.sizeBytes"), F.lit("0")), F.nullif(text(at, "$.size_bytes"), F.lit("0")))
        return F.when(F.schema_of_variant(at) == "STRING", text(at, "$")).when(F.schema_of_variant(at).startswith("OBJECT"), F.when(h.isNotNull(), F.concat_ws("/", h, size)))

    first = lambda key: F.try_element_at(items(F.col(f"{payload}.{key}"), "$"), F.lit(1))
    out = F.coalesce(first("listedOutputs"), first("actualOutputs"))
    return F.coalesce(one("digest"), one("actionDigest"), F.try_variant_get(out, "$", "string"))


def cache_hit_of(payload: str) -> Column:
    """Hit flag from the boolean keys, else from the runner text; ``payload`` is a struct with SPAWN_FIELDS."""
    runner = F.lower(F.coalesce(text(F.col(f"{payload}.runner"), "$"), F.lit("")))
    return F.coalesce(
        *[boolean(F.col(f"{payload}.{k}"), "$") for k in HIT_FIELDS],
        F.when(runner.contains("cache hit"), True).when(
            runner.isin("local", "sandboxed", "worker") | runner.contains("cache miss"), False),
    )


def cache_kind(hit: Column) -> Column:
    return F.when(hit, "remote_cache_hit").when(~hit, "cache_miss").otherwise("action_cache_observed")


def extract_cache_events(execs: DataFrame, source_kind: str = "collectable_v1") -> DataFrame:
    """Cache events of an execution log; an unknown hit is derived and low."""
    spawns = once(once(execs, "run_id", "event_index", payload=spawn_of()).where("payload IS NOT NULL"),
                  "run_id", "event_index", s=fields(F.col("payload"), *SPAWN_FIELDS))
    of = lambda k: text(F.col(f"s.{k}"), "$")
    rows = once(
        spawns, "run_id", "event_index", hit=cache_hit_of("s"), digest=digest_of("s"),
        target_label=F.coalesce(of("targetLabel"), of("target_label"), of("label")), mnemonic=F.coalesce(of("mnemonic"), F.lit("Spawn")),
    )
    unknown = F.col("hit").isNull()
    key = F.concat_ws(":", F.coalesce("target_label", F.lit("unknown-target")), "mnemonic",
                      F.coalesce("digest", F.col("event_index").cast("string")))
    return rows.select(
        "run_id", "event_index", key.alias("event_key"), cache_kind(F.col("hit")).alias("event_kind"), "hit", "digest",
        "target_label", F.when(unknown, "derived_v1").otherwise(source_kind).alias("source_kind"),
        F.when(unknown, "low").otherwise("high").alias("confidence"),
    )


def extract_profile_events(trace: DataFrame) -> DataFrame:
    """Cache events of a profile; only labelled rows, always derived."""
    rows = once(
        trace, "run_id", "event_index", args=fields(raw("event", "$.args"), "label", "target", "targetLabel", "mnemonic", *DIGEST_FIELDS),
        name=F.lower(F.coalesce(text("event", "$.name"), F.lit(""))), ts=text("event", "$.ts"))
    of = lambda k: text(F.col(f"args.{k}"), "$")
    rows = once(
        rows, "run_id", "event_index", "name", "ts", target_label=F.coalesce(of("label"), of("target"), of("targetLabel")),
        mnemonic=F.coalesce(of("mnemonic"), F.lit("Action")), digest=digest_of("args"), hit=F.when(F.col("name").contains("cache hit"), True),
    ).where("target_label IS NOT NULL")
    key = F.concat_ws(":", F.lit("profile"), "target_label", "mnemonic", F.coalesce("digest", "ts", F.col("event_index").cast("string")))
    return rows.select(
        "run_id", "event_index", key.alias("event_key"), cache_kind(F.col("hit")).alias("event_kind"), "hit", "digest", "target_label",
        F.lit("derived_v1").alias("source_kind"), F.when(F.col("hit"), "medium").otherwise("low").alias("confidence"),
    )


def utc_micros(ts: Column) -> Column:
    """a timestamp as UTC ISO text with six decimals."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def start_of(event: str = "event") -> Column:
    """Start of one event: ISO text first, else epoch milliseconds; never a guess."""
    iso = F.try_to_timestamp(text(event, "$.started.startTime"))
    kind = F.schema_of_variant(raw(event, "$.started.startTimeMillis"))
    number = F.trim(text(event, "$.started.startTimeMillis"))
    millis = F.when((kind != "BOOLEAN") & number.rlike(r"^-*\d+(\.\d+)?$"), F.floor(number.try_cast("decimal(38,6)")).cast("bigint"))
    return F.coalesce(utc_micros(iso), utc_micros(F.timestamp_millis(millis)))


def extract_build_facts(events: DataFrame) -> DataFrame:
    """E9, E10, E11 in one pass: start, tool version, digest function of each run."""
    events = once(events, "run_id", "event_index", event=F.when(
        raw("event", "$.started").isNotNull() | raw("event", "$.optionsParsed").isNotNull(), F.col("event")))
    listed = lambda key: F.transform(items("event", f"$.optionsParsed.{key}"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    options = F.array_compact(F.concat(
        F.array(F.when(F.schema_of_variant(raw("event", "$.started.optionsDescription")) == "STRING",
                       F.try_variant_get("event", "$.started.optionsDescription", "string"))),
        *[listed(k) for k in ("cmdLine", "explicitCmdLine", "startupOptions", "explicitStartupOptions")],
    ))
    flags = F.filter(F.transform(options, lambda s: F.regexp_extract(s, r"--digest[_-]?function[=\s]+([A-Za-z0-9_.-]+)", 1)), lambda s: s != "")
    rows = events.select(
        "run_id", "event_index", start_of().alias("start"), F.nullif(F.trim(text("event", "$.started.buildToolVersion")), F.lit("")).alias("version"),
        F.try_element_at(flags, F.lit(1)).alias("flag"), (F.size(options) > 0).alias("visible"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_index")))
    out = rows.groupBy("run_id").agg(
        first("start").alias("started_at"), first("version").alias("tool_version"), first("flag").alias("fn_raw"),
        F.bool_or("visible").alias("options_seen"),
    )
    return out.withColumn("fn_name", digests.function_name(F.col("fn_raw"))).withColumn(
        "version_out_of_range", version_out_of_range(F.col("tool_version"))
    )


def version_out_of_range(version: Column) -> Column:
    """True only for a readable version outside the tested majors."""
    major = F.regexp_extract(version, r"(\d+)\.(\d+)\.(\d+)", 1).try_cast("int")
    return F.coalesce(~major.isin(*TESTED_MAJORS), F.lit(False))


def release_of(version_output: Column) -> Column:
    """Release string in the output of a version command."""
    return F.nullif(F.regexp_extract(version_output, r"(?m)^[ \t]*Build label:[ \t]*(\S+)", 1), F.lit(""))


def extract_workers(logs: DataFrame, keys: list[str]) -> DataFrame:
    """Worker names in log lines; one row per (line, name)."""
    found = F.array(
        F.regexp_extract("line", r"(?i)Worker\s+(\S+)\s+started", 1), F.regexp_extract("line", r"(?i)worker_name=(\S+)", 1)
    )
    names = F.array_distinct(F.filter(found, lambda s: s != ""))
    return logs.select(*keys, "line_no", F.explode(names).alias("worker_name"))


def readiness(configs: DataFrame) -> DataFrame:
    """Readiness of a worker configuration.

    ``configs``: run_id, config VARIANT (NULL when unreadable), config_error,
    expected_workers, phase, public_open, worker_open.
    """
    servers = items("config", "$.servers")
    names = F.flatten(F.transform(servers, lambda v: F.coalesce(
        F.map_keys(F.try_variant_get(v, "$.services", "map<string,variant>")), F.array().cast("array<string>"))))
    schedulers = F.array_compact(F.transform(items("config", "$.schedulers"), lambda v: text(v, "$.name")))
    kind = F.schema_of_variant(raw("config", "$.workers"))
    workers = F.when(kind.startswith("ARRAY"), F.size(F.try_variant_get("config", "$.workers", "array<variant>"))).otherwise(0)
    rows = configs.select("*", F.array_sort(F.array_distinct(names)).alias("services"), schedulers.alias("schedulers"), F.coalesce(workers, F.lit(0)).alias("configured_workers"))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(s) for s in REQUIRED_SERVICES]), F.coalesce("services", F.array().cast("array<string>"))))
    few = F.col("configured_workers") < F.col("expected_workers")
    rows = rows.withColumn("missing_services", missing).withColumn("problems", F.array_compact(F.array(
        F.col("config_error"),
        F.when(few, F.format_string("configured worker count %d below expected %d", F.col("configured_workers"), F.col("expected_workers"))),
        F.when(F.size("missing_services") > 0, F.concat(F.lit("missing services: "), F.array_join("missing_services", ", "))),
        F.when(F.coalesce(F.size("schedulers"), F.lit(0)) <= 0, "missing scheduler"),
    )))
    shut = F.array_compact(F.array(
        F.when(~F.col("public_open"), "public endpoint port did not open"),
        F.when(~F.col("worker_open"), "worker API endpoint port did not open"),
    ))
    blocked = F.size("problems") > 0
    status = (
        F.when(blocked, "configuration_blocker").when(F.col("phase") == "preflight", "configuration_ready")
        .when(F.size(shut) == 0, "worker_endpoints_ready").otherwise("endpoint_blocker")
    )
    reasons = F.when(blocked, F.col("problems")).when(F.col("phase") == "preflight", F.array().cast("array<string>")).otherwise(shut)
    return rows.select("run_id", "configured_workers", "expected_workers", status.alias("status"), reasons.alias("reasons"))


def first_code_block(value: Column) -> Column:
    """Body of the first fenced block."""
    return F.nullif(F.regexp_extract(value, r"(?s)```(?:python)?[ \t]*\n(.*?)```", 1), F.lit(""))


def worker_blocks(worker_events: DataFrame) -> DataFrame:
    """One identity block per run. Names are counted, not listed, so a run may hold any number."""
    named = worker_events.groupBy("run_id", "worker_name").agg(F.count("*").alias("n"))
    out = named.groupBy("run_id").agg(F.sum("n").alias("lines"), F.count("*").alias("workers"))
    return out.select(
        "run_id", F.lit("worker-admin-identity").alias("block_key"), F.lit("worker_admin_identity_v1").alias("block_kind"),
        F.to_json(F.struct(F.lit("high").alias("confidence"), "lines", F.lit("safe").alias("redaction_state"), "workers")).alias("payload"),
    )


def tool_blocks(facts: DataFrame) -> DataFrame:
    """One tool block per run that declares a version."""
    payload = F.struct(F.lit("bazel").alias("build_tool"), F.col("tool_version").alias("build_tool_version"),
                       F.lit("started.buildToolVersion").alias("field"))
    return facts.where("tool_version IS NOT NULL").select(
        "run_id", F.lit("build-tool-identity").alias("block_key"), F.lit("build_tool_identity_v1").alias("block_kind"),
        F.to_json(payload).alias("payload"),
    )


def readiness_blocks(states: DataFrame) -> DataFrame:
    """One readiness boundary block per run."""
    payload = F.struct("configured_workers", "expected_workers", "reasons", "status")
    return states.select(
        "run_id", F.lit("worker-readiness").alias("block_key"), F.lit("worker_readiness_boundary").alias("block_kind"),
        F.to_json(payload).alias("payload"),
    )


def terminal_status(results: DataFrame) -> DataFrame:
    """Worst outcome of a run's commands."""
    state = F.col("status")
    rank = F.when(state == "environment_blocker", 4).when(state == "configuration_blocker", 3).when(state == "timeout", 2).when(
        F.coalesce(F.col("exit_code"), F.lit(0)) != 0, 1).otherwise(0)
    worst = results.groupBy("run_id").agg(F.max(rank).alias("rank"))
    return worst.select("run_id", F.get(F.lit(list(OUTCOMES)), F.col("rank")).alias("status"))


def command_failures(results: DataFrame) -> DataFrame:
    """One failure row per command that ended with a non-zero code."""
    return results.where("exit_code IS NOT NULL AND exit_code <> 0").select(
        "run_id", F.col("id").alias("command"), F.lit("command_exit").alias("failure_kind"),
        F.coalesce("detail", F.format_string("command exited with code %d", F.col("exit_code"))).alias("message"),
    )
