"""Rule-based verdicts per run group (D family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions.truth import quad_partials, weakest_confidence
from evidmill.operators.grouping import per_group
from evidmill.operators.redact import scan
from evidmill.operators.rollup import PRESENCE_COUNTERS, cache_metrics

# Signatures of a build that died before it evaluated anything.
TOOLCHAIN_SIGNATURES = (
    "Bazel compatibility check failed",
    "is not compatible with module",
    "Error computing the main repository mapping",
    "The command is only supported from within a workspace",
    "Error downloading",
    "command not found",
    "FATAL: bazel exited",
)
# Next steps in precedence order, failure markers, and home folders.
STEPS = ("record_environment_blocker", "rerun_validation", "dispatch_fix_with_evidence", "attach_missing_evidence", "none_complete")
FAILURE_MARKERS = ("FAIL", "Error", "error:")
HOME_PATHS = r"""(/Users/[^\s"')(]+|/home/[^\s"')(]+|/private/var/[^\s"')(]*)"""
EXCERPT_LINES = 80
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
LOG_NAMES = ("bazel.stderr.txt", "bazel.stdout.txt")


def classify_logs(logs: DataFrame, key: str, target: Column | None = None) -> DataFrame:
    """Classification of each group's logs. ``logs``: key, log_name, text (one row per log).

    Every log is tested where it is; only flags are combined, never the texts.
    """
    marks = [F.bool_or(F.contains("text", F.lit(s))).alias(f"s{i}") for i, s in enumerate(TOOLCHAIN_SIGNATURES)]
    seen = F.lit(None).cast("boolean") if target is None else F.bool_or(F.contains("text", target))
    flags = logs.groupBy(key).agg(*marks, seen.alias("referenced"))
    matched = F.array_compact(F.array(*[F.when(F.col(f"s{i}"), F.lit(s)) for i, s in enumerate(TOOLCHAIN_SIGNATURES)]))
    kind = (
        F.when(F.size("matched_signatures") > 0, "toolchain_failure")
        .when(F.coalesce("referenced", F.lit(False)), "scenario_validation_failure")
        .otherwise("unattributed_failure")
    )
    return flags.select(key, matched.alias("matched_signatures"), "referenced").withColumn("classification", kind)


def log_excerpts(logs: DataFrame, max_lines: int = EXCERPT_LINES) -> DataFrame:
    """The failure region of each log with home folders masked; logs without a marker drop out.

    ``lines_total`` and ``truncated`` tell whether the region is longer than the ``max_lines`` shown.
    """
    lines = F.split("text", LINE_BREAK)
    hit = lambda line: reduce(lambda a, b: a | b, [line.contains(m) for m in FAILURE_MARKERS])
    first = F.array_position(F.transform(F.col("_lines"), hit), F.lit(True)).cast("int")
    rows = logs.withColumn("_lines", lines).withColumn("first_line", first).where("first_line > 0")
    # A final line break ends the last line; it is no line of its own.
    cut = F.slice("_lines", F.col("first_line"), F.lit(max_lines))
    at_end = (F.col("first_line") + F.size(cut) - 1 == F.size("_lines")) & (F.element_at("_lines", -1) == "")
    body = F.when(at_end, F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)
    text = F.regexp_replace(F.array_join(body, "\n"), HOME_PATHS, "<redacted-path>")
    return rows.withColumn("section", F.concat(F.lit("[artifact: "), "log_name", F.lit("]\n"), text)).withColumns({
        "lines_total": F.size("_lines") - F.col("first_line") + 1 - (F.element_at("_lines", -1) == "").cast("int"),
    }).withColumn("truncated", F.col("lines_total") > max_lines).drop("_lines", "text")


def failure_excerpts(logs: DataFrame, key: str) -> DataFrame:
    """One redacted excerpt per group from its two logs, and the hash of the final text."""
    per_log = log_excerpts(logs.where(F.col("log_name").isin(*LOG_NAMES)))
    wide = per_log.groupBy(key).agg(*[F.max(F.when(F.col("log_name") == n, F.col("section"))).alias(f"l{i}") for i, n in enumerate(LOG_NAMES)])
    joined = wide.withColumn("excerpt", F.concat(F.concat_ws("\n\n", "l0", "l1"), F.lit("\n")))
    done = scan(joined.select(key, "excerpt"), "excerpt")
    return done.select(key, F.col("redacted").alias("excerpt"), F.sha2("redacted", 256).alias("excerpt_sha256"))


def next_steps(failed: Column, classification: Column, has_excerpt: Column, logs_seen: Column, pending: Column) -> Column:
    """The steps that apply, in precedence order (array)."""
    missing = (~logs_seen) | (~has_excerpt) | (classification == "unattributed_failure")
    when = {
        "record_environment_blocker": classification == "toolchain_failure",
        "rerun_validation": pending,
        "dispatch_fix_with_evidence": failed & (classification == "scenario_validation_failure") & has_excerpt,
        "attach_missing_evidence": failed & missing,
        "none_complete": ~failed,
    }
    return F.array_compact(F.array(*[F.when(when[s], F.lit(s)) for s in STEPS]))


def consulted(tables: list[DataFrame]) -> DataFrame:
    """The label columns of every consulted child table, stacked."""
    cols = ("run_id", "source_kind", "confidence", "redaction_state")
    return reduce(lambda a, b: a.unionByName(b), [t.select(*cols) for t in tables])


def verdicts(
    runs: DataFrame, failures: DataFrame, cache_events: DataFrame, others: list[DataFrame],
    classified: DataFrame, excerpts: DataFrame, pending: DataFrame,
) -> DataFrame:
    """One verdict row per run group.

    ``others``: further consulted child tables; ``classified`` (D1), ``excerpts`` (D2)
    and ``pending`` (V8) are keyed by run_group.
    """
    own = runs.withColumn("run_id", F.col("id"))
    labels = per_group(runs, consulted([own, failures, cache_events, *others]), quad_partials())
    counts = per_group(runs, failures, {"failure_count": ("sum", F.lit(1))})
    waiting = pending.groupBy("run_group").agg(F.count("*").alias("pending_paths"))
    rows = (
        cache_metrics(runs, cache_events).join(counts, "run_group").join(labels, "run_group")
        .join(classified, "run_group", "left").join(excerpts.select("run_group", "excerpt_sha256"), "run_group", "left")
        .join(waiting, "run_group", "left")
    )
    failed = F.col("failure_count") > 0
    logs_seen = F.col("classification").isNotNull()
    kind = F.when(~failed, "first_pass_success").when(logs_seen, F.col("classification")).otherwise("unclassified")
    rows = rows.withColumns({
        "failed": failed, "logs_seen": logs_seen, "kind": kind,
        "excerpt_hash": F.when(failed & logs_seen, F.col("excerpt_sha256")),
        "pending_paths": F.coalesce("pending_paths", F.lit(0)),
    })
    steps = next_steps(F.col("failed"), F.col("kind"), F.col("excerpt_hash").isNotNull(), F.col("logs_seen"), F.col("pending_paths") > 0)
    return rows.select(
        "run_group", F.when(F.col("failed"), "failed").otherwise("ok").alias("status"), "failure_count", F.col("kind").alias("classification"),
        F.col("excerpt_hash").alias("excerpt_sha256"), "hits", "misses", "hit_rate", "pending_paths", steps.alias("next_steps"),
        F.lit("derived_v1").alias("source_kind"), weakest_confidence().alias("confidence"), F.lit("safe").alias("redaction_state"),
    )


def failure_rows(runs: DataFrame, failures: DataFrame, targets: DataFrame) -> DataFrame:
    """D3: the failures of each group; ``attributed`` counts the group's failed labels (``attributed_targets``).

    Every failure of a group is attributed to the same labels, so these are rows of their own and not repeated per failure.
    """
    labels = attributed_targets(runs, targets).groupBy("run_group").agg(F.count("*").alias("attributed"))
    met = failures.join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")
    return met.join(labels, "run_group", "left").withColumn("attributed", F.coalesce("attributed", F.lit(0)))


def attributed_targets(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """D3: distinct labels of failed targets per group."""
    failed = targets.where(F.upper("status") == "FAILED").select("run_id", "label").distinct()
    return failed.join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id").select("run_group", "label").distinct()


def verdict_refs(runs: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Distinct evidence refs of the consulted tables per group and where each was first seen; the group itself comes first.

    ``tables``: in reading order, with ``run_id, created_at, id, evidence_refs``.
    """
    flat = [t.select("run_id", F.lit(i).alias("place"), "created_at", "id", F.posexplode("evidence_refs").alias("slot", "ref")) for i, t in enumerate(tables)]
    per_run = reduce(lambda a, b: a.unionByName(b), flat).groupBy("run_id", "ref").agg(F.min(F.struct("place", "created_at", "id", "slot")).alias("first_seen"))
    met = per_run.join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id").groupBy("run_group", "ref").agg(F.min("first_seen").alias("first_seen"))
    own = F.struct(F.lit(-1).alias("place"), F.lit("").alias("created_at"), F.lit("").alias("id"), F.lit(0).alias("slot"))
    groups = runs.select("run_group").distinct()
    return groups.select("run_group", F.concat(F.lit("run-group:"), F.col("run_group").cast("string")).alias("ref"), own.alias("first_seen")).unionByName(met)


def whole_verdicts(
    verdict: DataFrame, runs: DataFrame, classified: DataFrame, logs: DataFrame, references: DataFrame, agent_blocks: DataFrame, changes: DataFrame,
) -> DataFrame:
    """D3: verdicts with signatures, artifact verification, provenance classes, log refs and changed paths.

    ``verdict``: rows of ``verdicts``; ``classified`` (D1) and ``logs`` (``log_name``) are keyed by run_group, the others by
    ``run_id``. ``artifact_verification`` and ``provenance`` are JSON over fixed vocabularies; failures, labels and refs, of
    which a group can have any number, are the rows of ``failure_rows``, ``attributed_targets`` and ``verdict_refs``.
    """
    counters = {"total": ("sum", F.lit(1)), **{n: ("sum", (F.col("presence") == p).cast("int")) for p, n in PRESENCE_COUNTERS.items()}}
    verified = per_group(runs, references, counters).select("run_group", F.to_json(F.struct(*counters)).alias("artifact_verification"))
    kind = F.coalesce(F.nullif("provenance_class", F.lit("")), F.lit("unknown")).alias("k")
    classes = agent_blocks.groupBy("run_id", kind).agg(F.count("*").alias("n")).join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")
    classes = classes.groupBy("run_group", "k").agg(F.sum("n").alias("n")).groupBy("run_group").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("provenance"))
    paths = changes.where("path <> ''").select("run_id", "path").distinct().join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")
    paths = paths.select("run_group", "path").distinct().groupBy("run_group").agg(F.count("*").alias("changed_paths"))
    found = logs.groupBy("run_group").agg(*[F.bool_or(F.col("log_name") == n).alias(f"l{i}") for i, n in enumerate(LOG_NAMES)])
    found = found.select("run_group", F.array_compact(F.array(*[F.when(F.col(f"l{i}"), F.lit(f"artifact:{n}")) for i, n in enumerate(LOG_NAMES)])).alias("_refs"))
    rows = verdict
    for df in (verified, classes, paths, found, classified.select("run_group", F.col("matched_signatures").alias("_signatures"))):
        rows = rows.join(df, "run_group", "left")
    none = F.array().cast("array<string>")
    failed = F.col("status") == "failed"
    honest = F.when(F.col("classification").isin("toolchain_failure", "unattributed_failure"), False).when(F.col("classification") == "scenario_validation_failure", True)
    return rows.withColumns({
        "honest_scenario_failure": honest, "matched_signatures": F.when(failed, F.coalesce("_signatures", none)).otherwise(none),
        "failure_refs": F.when(F.col("excerpt_sha256").isNotNull(), F.col("_refs")).otherwise(none),
        "provenance": F.coalesce("provenance", F.lit("{}")), "changed_paths": F.coalesce("changed_paths", F.lit(0)),
    }).drop("_signatures", "_refs")


def exit_codes(verdict: DataFrame) -> DataFrame:
    """1 unless nothing is outstanding."""
    first = F.try_element_at("next_steps", F.lit(1))
    return verdict.select("run_group", F.when(first == "none_complete", 0).otherwise(1).alias("exit_code"))


def verdict_blocks(verdict: DataFrame, generated_at: Column) -> DataFrame:
    """Verdicts as stored blocks, ready for the idempotent append."""
    doc = F.to_json(F.struct(
        F.struct("classification").alias("classification"), generated_at.alias("generated_at"),
        F.transform("next_steps", lambda s: F.struct(s.alias("action"))).alias("next_steps"),
        F.col("run_group").cast("string").alias("run_group"), F.struct("failure_count", "status").alias("status"),
    ))
    return verdict.select(
        "run_group", F.concat(F.lit("evaluation:"), F.col("run_group").cast("string")).alias("stable_key"),
        F.lit("evaluation").alias("block_kind"), doc.alias("payload"), "source_kind", "confidence", "redaction_state",
    )


def one_line(verdict: DataFrame) -> DataFrame:
    """M3: verdict in one line and as a short text."""
    first = F.coalesce(F.try_element_at("next_steps", F.lit(1)), F.lit("none"))
    line = F.concat(F.lit("status="), "status", F.lit(" · classification="), "classification", F.lit(" · next="), first)
    steps = F.array_join(F.transform("next_steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". `"), s, F.lit("`"))), "\n")
    text = F.concat_ws(
        "\n", F.concat(F.lit("## Verdict `"), F.col("run_group").cast("string"), F.lit("`")), F.lit(""),
        F.format_string("- status: %s (%d failure(s))", "status", "failure_count"), F.concat(F.lit("- classification: "), "classification"),
        F.format_string("- cache: %d hit(s) / %d miss(es)", "hits", "misses"), F.lit(""), steps,
    )
    return verdict.select("run_group", line.alias("line"), text.alias("text"))
