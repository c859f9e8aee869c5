"""File shapes, guarded reads, first write wins, upgrade."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from evidmill.operators import extract
from evidmill.sources import evidence as src, spine

EVENTS = [{"id": {"targetConfigured": {"label": "//a"}}, "configured": {"targetKind": "k {x} {\"y} {"}}, {"finished": {"exitCode": {"name": "SUCCESS", "code": 0}}}]


@pytest.mark.parametrize("shape", ["lines", "array", "envelope", "glued", "pretty", "gzip", "mixed"])
def test_build_event_shapes(spark, tmp_path, shape):
    text = {
        "lines": "\n".join(json.dumps(e) for e in EVENTS) + "\n", "array": json.dumps(EVENTS, indent=1), "envelope": json.dumps({"events": EVENTS}),
        "glued": "".join(json.dumps(e) for e in EVENTS), "pretty": "\n".join(json.dumps(e, indent=2) for e in EVENTS),
        "gzip": "\n".join(json.dumps(e) for e in EVENTS), "mixed": "[1, 2]\n" + "\n".join(json.dumps(e) for e in EVENTS) + "\n3\n",
    }[shape]
    path = tmp_path / ("e.json.gz" if shape == "gzip" else "e.json")
    path.write_bytes(gzip.compress(text.encode()) if shape == "gzip" else text.encode())
    rows = src.read_build_events(spark, str(path)).orderBy("event_index").select("event_index", F.to_json("event").alias("e")).collect()
    assert [(r.event_index, json.loads(r.e)) for r in rows] == list(enumerate(EVENTS, 1))


def test_index_runs_through_file_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(json.dumps({"n": i, "pad": "x" * 40}) + "\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = src.read_build_events(spark, str(path)).select("event_index", F.try_variant_get("event", "$.n", "int").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.event_index, r.n) for r in rows) == [(i + 1, i) for i in range(400)]


def test_empty_file_has_no_events(spark, tmp_path):
    (tmp_path / "e.json").write_text("")
    assert src.read_build_events(spark, str(tmp_path / "e.json")).count() == 0


def test_profile_logs_manifest_metadata(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"traceEvents": [{"name": "x", "args": {"label": "//a"}}, 3]}))
    assert [r.event_index for r in src.read_profile(spark, str(tmp_path / "p.json")).collect()] == [1]
    (tmp_path / "l.txt").write_text("one\r\ntwo Worker W1 started worker_name=W1\n")
    logs = src.read_logs(spark, str(tmp_path / "l.txt"))
    assert [(r.line_no, r.line) for r in logs.orderBy("line_no").collect()] == [(1, "one"), (2, "two Worker W1 started worker_name=W1")]
    assert [r.worker_name for r in extract.extract_workers(logs, ["source_file"]).collect()] == ["W1"]
    (tmp_path / "m.json").write_text(json.dumps({"artifacts": [{"artifact_key": "a", "size_bytes": 3}]}))
    assert src.read_manifest(spark, str(tmp_path / "m.json")).select("artifact_key", "size_bytes").first() == ("a", 3)
    for name, text in (("r1", '{"run_group": "g"}'), ("r2", "[]"), ("r3", "oops")):
        os.makedirs(tmp_path / "runs" / name / "artifacts")
        (tmp_path / "runs" / name / "artifacts" / "run.json").write_text(text)
    assert [r.run_group for r in src.read_run_metadata(spark, str(tmp_path)).collect()] == ["g"]


def test_agent_results(spark, tmp_path):
    (tmp_path / "a.json").write_text("{bad")
    assert src.read_agent_results(spark, str(tmp_path / "a.json")).first().result is None
    (tmp_path / "c.jsonl").write_text('{"type": "thread.started", "thread_id": "t"}\nnoise\n{"type": "turn.completed"}\n')
    assert src.read_agent_events(spark, str(tmp_path / "c.jsonl")).count() == 2


def test_tree_scan_and_inventory(spark, tmp_path):
    import hashlib

    (tmp_path / "d.sqlite").write_bytes(b"SQLite format 3\x00rest")
    (tmp_path / "b.bin").write_bytes(b"ab\x00c")
    (tmp_path / "j.json").write_text('{"a": 1}')
    (tmp_path / "t.txt").write_text("plain")
    kinds = {os.path.basename(r.path): r.kind for r in src.scan_tree(spark, str(tmp_path)).collect()}
    assert kinds == {"d.sqlite": "database", "b.bin": "binary", "j.json": "json", "t.txt": "text"}
    forced = {os.path.basename(r.path): r.kind for r in src.scan_tree(spark, str(tmp_path), "text").collect()}
    assert forced["d.sqlite"] == "database" and forced["j.json"] == "text"
    inv = {os.path.basename(r.path): r.sha256 for r in src.file_inventory(spark, str(tmp_path)).collect()}
    assert inv["t.txt"] == hashlib.sha256(b"plain").hexdigest()


def test_discovery_lists_links_with_a_reason(spark, tmp_path):
    for name in ("a", "b"):
        os.makedirs(tmp_path / "root" / name / "dataset")
    os.makedirs(tmp_path / "root" / "c")
    os.symlink(tmp_path / "root" / "a", tmp_path / "root" / "z")
    rows = src.discover_sources(spark, str(tmp_path / "root"), (str(tmp_path / "root" / "a" / "dataset"),)).collect()
    assert [(r.source, r.reason) for r in rows] == [("a", None), ("b", None), ("z", "symlinked_entry")]


def test_upsert_first_write_wins_and_repeats_are_no_ops(spark, tmp_path):
    root = str(tmp_path / "ds")
    assert spine.open_or_reason(spark, root) == (None, "missing")
    spine.create(spark, root)
    first = spark.createDataFrame([("k1", "a", "1"), ("k1", "b", "2"), ("k2", "c", "1")], "stable_key string, status string, created_at string")
    for df in (first, first, spark.createDataFrame([("k2", "late", "0"), ("k3", "d", "5")], "stable_key string, status string, created_at string")):
        spine.upsert(df, root, "runs")
    tables, reason = spine.open_or_reason(spark, root)
    assert reason is None
    assert sorted((r.stable_key, r.status) for r in tables["runs"].collect()) == [("k1", "a"), ("k2", "c"), ("k3", "d")]
    with pytest.raises(ValueError, match="unknown columns"):
        spine.upsert(first.withColumn("nope", F.lit(1)), root, "runs")


def test_upgrade_keeps_rows_and_refuses_newer(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.createDataFrame([("1", "k")], "id string, stable_key string").write.parquet(old + "/runs")
    spark.createDataFrame([(2,)], "version int").write.json(old + "/_meta")
    assert spine.open_or_reason(spark, old)[1] == "schema_v2"
    spine.upgrade(spark, old, new)
    tables, _ = spine.open_or_reason(spark, new)
    assert tables["runs"].select("id", "confidence").first() == ("1", "unknown") and tables["artifact_references"].count() == 0
    spark.createDataFrame([(9,)], "version int").write.mode("overwrite").json(old + "/_meta")
    with pytest.raises(ValueError, match="newer"):
        spine.upgrade(spark, old, new)
