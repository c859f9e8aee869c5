"""Change evidence, receipts, verdict steps, retention guards, and a slice of the oracle check."""

import json

import pytest
from pyspark.sql import functions as F

from evidmill.operators import receipts, retention, verdict, verify

PATHS = [("edited", "a", "b"), ("appeared", None, "b"), ("deleted", "a", None), ("never", None, None), ("same", "a", "a"), ("pinned", "a", "a"), ("forged", "a", "a")]


def test_change_evidence_cases(spark):
    paths = spark.createDataFrame([(1, p, b, a) for p, b, a in PATHS], "run_id int, path string, before_hash string, after_hash string")
    claims = spark.createDataFrame([(1, "pinned", "c1", "pinned", "z"), (1, "forged", "c1", "forged", "x")], "run_id int, path string, commit string, object_path string, baseline_sha256 string")
    objects = spark.createDataFrame([("c1", "pinned", "z"), ("c1", "forged", "y")], "commit string, object_path string, object_sha256 string")
    base = verify.verify_baselines(claims, objects, objects)
    got = {r.path: (r.changed, r.changed_basis, r.note) for r in verify.change_evidence(paths, base).collect()}
    assert got["edited"][0] and got["appeared"][0] and got["deleted"][0]
    assert got["never"][:2] == (False, "recorder_window") and got["never"][2] == "never on disk"
    assert got["same"][0] is False and got["pinned"] == (True, "git_baseline", None)
    assert got["forged"] == (False, "recorder_window", "baseline mismatch")


def test_receipt_hash_equals_python_json(spark):
    import hashlib

    row = dict(call_id=1, response_text="é \"x\"", models=["m"], session_id="s", input_tokens=3, output_tokens=None, cache_creation_tokens=None,
               cache_read_tokens=0, num_turns=2, result_subtype=None, api_error_status=None, api_error_code=None, cli_name="claude", cli_version=None,
               requested_model="m", captured_at="2026", command=["a", "b"], status="success", prompt_sha256="0" * 64, is_error=False)
    schema = ("call_id int, response_text string, models array<string>, session_id string, input_tokens bigint, output_tokens bigint, cache_creation_tokens bigint, "
              "cache_read_tokens bigint, num_turns bigint, result_subtype string, api_error_status bigint, api_error_code string, cli_name string, cli_version string, "
              "requested_model string, captured_at string, command array<string>, status string, prompt_sha256 string, is_error boolean")
    df = receipts.build_receipts(spark.createDataFrame([row], schema)).withColumn("doc", receipts.receipt_json())
    out = df.first()
    assert json.dumps(json.loads(out.doc), sort_keys=True) == out.doc and out.live
    assert receipts.receipt_summary(df.drop("doc")).first().receipt_sha256 == hashlib.sha256(out.doc.encode()).hexdigest()


def _one(fn, doc, spark):
    df = spark.createDataFrame([(1, json.dumps(doc))], "call_id int, j string").select("call_id", F.parse_json("j").alias("result"))
    return fn(df).first()


def test_family_b_net_input_and_codes(spark):
    ok = _one(receipts.normalize_b, {"response": "r", "session_id": "s", "stats": {"models": {
        "x": {"tokens": {"prompt": 10, "cached": 4, "candidates": 1}}, "y": {"tokens": {"prompt": 2, "cached": 5, "input": 7}}}}}, spark)
    assert (ok.input_tokens, ok.output_tokens, ok.cache_read_tokens, ok.models) == (13, 1, 9, ["x", "y"])
    none = _one(receipts.normalize_b, {"response": "r", "stats": {"models": {"x": {"tokens": {}}}}}, spark)
    assert none.input_tokens is None and none.output_tokens is None
    bad = _one(receipts.normalize_b, {"error": {"message": "m", "code": "DENIED"}}, spark)
    assert (bad.is_error, bad.result_subtype, bad.api_error_status, bad.api_error_code) == (True, "DENIED", None, "DENIED")


def test_step_precedence(spark):
    df = spark.createDataFrame([
        (True, "toolchain_failure", False, True, True), (True, "scenario_validation_failure", True, True, False),
        (True, "unattributed_failure", True, True, False), (True, "unclassified", False, False, False), (False, "first_pass_success", False, False, True)],
        "f boolean, c string, e boolean, l boolean, p boolean")
    got = [r[0] for r in df.select(verdict.next_steps(*[F.col(c) for c in "fcelp"])).collect()]
    assert got == [["record_environment_blocker", "rerun_validation", "attach_missing_evidence"], ["dispatch_fix_with_evidence"],
                   ["attach_missing_evidence"], ["attach_missing_evidence"], ["rerun_validation", "none_complete"]]


def test_excerpt_is_capped_and_masked(spark):
    text = "start\nFAIL: at /home/me/x (y)\n" + "\n".join(f"l{i}" for i in range(200)) + "\n"
    df = spark.createDataFrame([(1, verdict.LOG_NAMES[0], text), (1, verdict.LOG_NAMES[1], "quiet\n"), (2, verdict.LOG_NAMES[1], "Error last\n")], "g int, log_name string, text string")
    rows = {r.g: r.section.split("\n") for r in verdict.log_excerpts(df).collect()}
    assert len(rows[1]) == 81 and rows[1][1] == "FAIL: at <redacted-path> (y)" and rows[2] == ["[artifact: bazel.stdout.txt]", "Error last"]


def test_retention_modes(spark):
    for bad in ({}, {"keep_last": 1, "keep_days": 1}, {"keep_last": 0}, {"keep_days": -1}):
        with pytest.raises(ValueError):
            retention.check_selection(**bad)
    index = spark.createDataFrame([("a", 1, "2024-01-01"), ("b", 1, "2025-01-01"), (None, 1, "2023-01-01"), ("u", 1, None), ("x", 1, "junk")], "run_group string, run_count int, last_started_at string")
    last = {r.run_group: r.disposition for r in retention.keep_last(index, 2).collect()}
    assert last == {"x": "keep", "b": "keep", "a": "delete", None: "delete", "u": "unknown"}
    days = {r.run_group: r.disposition for r in retention.keep_days(index, 10, F.lit("2025-01-05").cast("timestamp")).collect()}
    assert days == {"a": "delete", "b": "keep", None: "delete", "u": "unknown", "x": "unknown"}


SLICE = ("A2_cache_metrics", "A4_cold_warm", "A12_run_history", "T3_chapter_members", "C5_J6_status_deltas", "V1_V2_V3_V4_J7_J8_verdicts", "E1_E2_targets",
         "E17_E18_receipts", "R8_json_findings", "D3_D4_verdicts", "K5_totals", "S13_S14_upserted_runs", "G3_G4_run_attribution", "G5_card_partition")


@pytest.mark.parametrize("name", SLICE)
def test_oracle_slice(spark, name):
    import duckdb

    from evidmill.plans import registry
    from tests.oracle_check import TABLES, compare

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    good, note = compare(spark, con, name, registry.queries()[name], registry.oracles().get(name), folder)
    assert good, note
