"""Labels, indexes and ordering helpers against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from evidmill.functions import labels
from evidmill.functions.digests import stable_id
from evidmill.functions.truth import quad_columns, quad_partials
from evidmill.operators import grouping, rollup


def _kind(rows):
    order = {"collectable_v1": 0, "derived_v1": 1, "simulated_v1": 2, "future": 3, "unknown": 4}
    kinds = [r[1] for r in rows if r[1]]
    return "future" if not rows else "derived_v1" if not kinds else min(kinds, key=lambda k: order.get(k, 99))


def _conf(rows):
    values = {r[2] for r in rows}
    return "unknown" if not rows else "high" if values == {"high"} else "low" if "low" in values else "medium"


def _red(rows):
    values = {r[3] for r in rows}
    return next((s for s in ("blocked", "redacted") if s in values), "safe" if values == {"safe"} else "unknown")


def test_label_rollups_match_rules(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 40), rnd.choice(["collectable_v1", "derived_v1", "simulated_v1", "future", None]),
             rnd.choice(["high", "high", "high", "low", "medium", "unknown"]), rnd.choice(["safe", "safe", "safe", "redacted", "blocked", None]))
            for _ in range(150)]
    df = spark.createDataFrame(rows, "run_id int, source_kind string, confidence string, redaction_state string")
    got = {r.run_id: tuple(r)[1:] for r in grouping.roll_up(df, ["run_id"], quad_partials()).select("run_id", *quad_columns()).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        assert got[key] == (_kind(mine), _conf(mine), _red(mine))


def test_global_index_is_dense_with_ties(spark):
    df = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(40)], "k int, id int").repartition(5)
    rows = grouping.global_index(df, [F.asc("k"), F.asc("id")]).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(340))
    assert [(r.k, r.id) for r in rows] == sorted((r.k, r.id) for r in rows)


@pytest.mark.parametrize("block", [3, 1000])
def test_block_windows_equal_plain_scan(spark, block):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), i if rnd.random() < 0.2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "index int, g string, v int")
    run = {r["index"]: r.out for r in grouping.carry_forward(df, ["g"], "index", F.col("v"), "out", block).collect()}
    nxt = {r["index"]: r.out for r in grouping.next_value(df, "index", F.col("v"), "out", block).collect()}
    for i, g, _ in rows:
        assert run[i] == max((v for j, h, v in rows if h == g and j <= i and v is not None), default=None)
        assert nxt[i] == min((v for j, _, v in rows if j > i and v is not None), default=None)


def test_index_puts_unknown_start_last(spark):
    df = spark.createDataFrame([("a", None), ("b", "2024"), ("c", "2025")], "run_group string, started_at string")
    assert [r.run_group for r in rollup.newest_first(rollup.run_group_index(df)).collect()] == ["c", "b", "a"]


def test_stable_id_escapes_like_json(spark):
    import hashlib
    import json

    texts = ["plain", 'q"\\', "é\n\t", "😀 \x7f", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", stable_id("Proof blocks", F.col("t")).alias("id"))
    for row in df.collect():
        payload = json.dumps(("Proof blocks", row.t), separators=(",", ":"))
        assert row.id == "proof_blocks_" + hashlib.sha256(payload.encode()).hexdigest()[:24]


@pytest.mark.parametrize("text,tone", [
    ("FAILED", "fail"), ("not ok", "neutral"), ("exit 0", "pass"), ("exit code 2", "fail"), ("0", "pass"), ("-1", "fail"),
    ("completed", "pass"), ("running", "neutral"), ("", "neutral"), ("timed out", "fail"), ("passed with errors", "fail")])
def test_status_tone(spark, text, tone):
    assert spark.range(1).select(labels.status_tone(F.lit(text))).first()[0] == tone


def test_duration_labels(spark):
    df = spark.createDataFrame([(5.44,), (0.0,), (123.4,), (90.0,), (-1.0,)], "s double")
    assert [r[0] for r in df.select(labels.duration_label(F.col("s"))).collect()] == ["5.4s", "0.0s", "2m 3s", "1m 30s", None]


def test_targets_by_label(spark):
    rows = spark.createDataFrame([(1, "//a"), (1, "//b"), (2, "//a"), (1, None), (None, "//a")], "run_id int, label string")
    targets = spark.createDataFrame([("t2", 1, "//a"), ("t1", 1, "//a"), ("t3", 2, "//c"), ("t4", 1, None)], "id string, run_id int, label string")
    got = {(r.run_id, r.label): r.target_id for r in rollup.resolve_targets(rows, targets).collect()}
    assert got == {(1, "//a"): "t1", (1, "//b"): None, (2, "//a"): None, (1, None): None, (None, "//a"): None}


def test_groups_of_one_name_in_two_sources(spark):
    from evidmill.operators import compare

    fact = "source string, run_group string, runs int, hits int, misses int, unknown int, hit_rate double, worker_seen boolean, agent_blocks int"
    facts = spark.createDataFrame([("x", "g", 1, 5, 0, 0, 1.0, True, 0), ("y", "g", 3, 2, 0, 0, 1.0, False, 2)], fact)
    pairs = spark.createDataFrame([("x", "g", "y", "g"), ("x", "g", "y", "none")], "left_source string, left_group string, right_source string, right_group string")
    got = [r.asDict() for r in compare.compare_sources(pairs, facts).collect()]
    assert len(got) == 1 and (got[0]["left_source"], got[0]["right_source"], got[0]["delta_runs"], got[0]["delta_hits"], got[0]["worker_changed"], got[0]["agent_presence_changed"]) == ("x", "y", 2, -3, True, True)
