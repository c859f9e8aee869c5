"""What keeps queries within time and disk on large tables: plans without quadratic frames, rows shuffled once, results as before."""

import os

import pytest
from pyspark.sql import functions as F

from evidmill import session
from evidmill.operators import graph, grouping, packet


def _plan(df):
    return df._jdf.queryExecution().toString().lower()


def test_next_value_reads_backwards(spark):
    values = {i: i if i % 7 == 3 else None for i in range(50)}
    df = spark.createDataFrame(list(values.items()), "index int, v int")
    out = grouping.next_value(df, "index", F.col("v"), "out", 16)
    # A frame that ends at the last row is built anew for every row.
    assert "unboundedfollowing" not in _plan(out)
    want = {i: min((v for j, v in values.items() if j > i and v is not None), default=None) for i in values}
    assert {r["index"]: r.out for r in out.collect()} == want


def _tree(n):
    """Runs, a way of three nodes below each, edges from a start that is no node, and a cycle."""
    nodes, edges = [("x", "action"), ("y", "action")], [("x", "y", "e"), ("y", "x", "e")]
    for i in range(n):
        nodes += [(f"run:{i}", "run"), (f"t{i}", "target"), (f"a{i}", "action"), (f"c{i}", "cache_event"), (f"o{i}", "artifact")]
        edges += [(f"run:{i}", f"t{i}", "evaluated_target"), (f"t{i}", f"a{i}", "produced_action"), (f"a{i}", f"c{i}", "observed_cache_event"),
                  (f"gone{i}", f"a{i}", "authored_change"), (f"gone{i}", f"o{i}", "recorded_artifact"), (f"t{i}", f"none{i}", "e")]
    return nodes, edges


@pytest.mark.parametrize("rows", [10, 1 << 24])
def test_walks_in_steps_equal_walks_at_once(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "STEP_ROWS", rows)
    nodes, edges = _tree(6)
    n, e = spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(edges, "from string, to string, kind string")
    parent = graph.parents(n, e, spark.createDataFrame([("o1", "t1")], "id string, owner string"))
    want = {"x": "y", "y": "x", "o1": "t1"} | {f"{b}{i}": f"{a}{i}" for i in range(6) for a, b in (("run:", "t"), ("t", "a"), ("a", "c"))}
    assert {r.id: r.parent for r in parent.collect()} == want
    got = {r.id: (r.run, r.depth) for r in graph.run_attribution(n, parent).collect()}
    assert len(got) == len(nodes) and all(got[f"c{i}"] == (f"run:{i}", 5) and got[f"t{i}"] == (f"run:{i}", 3) for i in range(6))
    assert got["o1"] == ("run:1", 4) and got["o2"] == (None, 3) and got["x"][0] is None
    part = {r.id: (r.owner, r.reason) for r in graph.card_partition(n, parent).collect()}
    assert len(part) == len(nodes) and part["c3"] == ("run:3", None) and part["o2"] == (None, None) and part["y"] == (None, "unreached")
    assert {(r["from"], r["to"]) for r in graph.connected_edges(n, e).collect()} == {(a, b) for a, b, _ in edges if not a.startswith("gone") and not b.startswith("none")}


def test_walks_remove_what_they_have_read(spark):
    top = session.shared_dir(spark).removeprefix("file:") + "/evidmill"
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    nodes, edges = _tree(20)
    n, e = spark.createDataFrame(nodes, "id string, kind string"), spark.createDataFrame(edges, "from string, to string, kind string")
    done = graph.run_attribution(n, graph.parents(n, e))
    assert done.count() == len(nodes)
    left = set(os.listdir(top)) - before
    assert {x.split("-")[0] for x in left} >= {"starts", "parents"} and not any(x.startswith("edges-") for x in left)
    assert not any(os.path.exists(f"{top}/{x}/ended=false") for x in left if x.startswith("starts-"))


@pytest.mark.parametrize("rows", [5, 1 << 24])
def test_block_refs_in_steps(spark, monkeypatch, rows):
    monkeypatch.setattr(session, "STEP_ROWS", rows)
    runs = spark.createDataFrame([(i, f"g{i % 3}" if i < 8 else None) for i in range(9)], "id int, run_group string")
    rows = {p: [(i, f"2024-{i % 5}", f"{p}{i}", [f"r{i % 4}", "all", None]) for i in range(n)] for p, n in (("cache_events", 9), ("targets", 5), ("failures", 7))}
    parts = {p: spark.createDataFrame(r, "run_id int, created_at string, id string, evidence_refs array<string>") for p, r in rows.items()}
    out = packet.block_refs(runs, parts)
    # A ref is shuffled for its part, not again for each block, and nothing is left to be shuffled.
    assert "exchange" not in _plan(out)
    want = {}
    for block, place, part in (("cache", 0, "cache_events"), ("cache_economics", 0, "cache_events"), ("validation", 0, "targets"), ("validation", 2, "failures")):
        for i, day, name, refs in rows[part]:
            for slot, ref in enumerate(refs):
                key = (f"g{i % 3}" if i < 8 else None, block, ref)
                want[key] = min(want.get(key, (9,)), (place, day, name, slot))
    assert {(r.run_group, r.block_id, r.ref): tuple(r.first_seen) for r in out.collect()} == want


def test_packet_facts_settle_their_parts(spark):
    quad = "source_kind string, confidence string, redaction_state string"
    of = lambda more="": spark.createDataFrame([], f"id string, run_id int, created_at string, {quad}{more}")
    runs = spark.createDataFrame([(1, "g", "cold-cache", "local", "ok", None, None, "t", "future", "low", "safe")],
                                 f"id int, run_group string, scenario string, mode string, status string, started_at string, ended_at string, created_at string, {quad}")
    parts = {p: of() for p in ("targets", "actions", "failures", "artifacts")} | {
        "invocations": of(", command array<string>, status string, started_at string, ended_at string"), "cache_events": of(", hit boolean"), "references": of(", presence string")}
    workers, stored = spark.createDataFrame([], "run_id int, worker_name string"), spark.createDataFrame([], "run_id int, id string, created_at string, block_kind string, payload string")
    facts = packet.packet_facts(runs, parts, runs, workers, stored)
    # What is left reads the settled parts: one row a group.
    assert _plan(facts).count("generate") == 0 and len(set(facts.inputFiles())) > 0
    assert [(r.run_group, r.runs, r.legs, r.targets) for r in facts.collect()] == [("g", 1, 0, 0)]
