"""Walks, partition invariant, explicit nodes and dangling edges on a small graph."""

from pyspark.sql import functions as F

from evidmill.operators import graph


def _graph(spark):
    nodes = [("run:1", "run"), ("t1", "target"), ("a1", "action"), ("c1", "cache_event"), ("f1", "failure"), ("art", "artifact"),
             ("inv", "invocation"), ("lost", "action"), ("x", "cache_event"), ("y", "cache_event")]
    edges = [("run:1", "t1"), ("t1", "a1"), ("a1", "c1"), ("run:1", "f1"), ("run:1", "inv"), ("x", "y"), ("y", "x"), ("gone", "lost")]
    return (spark.createDataFrame([(i, k, 1) for i, k in nodes], "id string, kind string, run_id int"),
            spark.createDataFrame([(a, b, "e") for a, b in edges], "from string, to string, kind string"))


def test_attribution_depth_cycles_and_override(spark):
    nodes, edges = _graph(spark)
    refs = spark.createDataFrame([("art", ["x:1", "invocation:inv"]), ("t1", ["invocation:nowhere"])], "id string, evidence_refs array<string>")
    parent = graph.parents(nodes, edges, graph.producing_invocations(refs, nodes))
    got = {r.id: (r.run, r.depth) for r in graph.run_attribution(nodes, parent).collect()}
    assert got["c1"] == ("run:1", 5) and got["art"] == ("run:1", 4) and got["t1"] == ("run:1", 3) and got["run:1"] == ("run:1", 2)
    assert got["lost"][0] is None and got["x"] == (None, 6) and len(got) == 10
    counts = {r.run: r.artifacts for r in graph.artifact_attribution(graph.run_attribution(nodes, parent)).collect()}
    assert counts == {"run:1": 1}


def test_every_node_is_card_or_member(spark):
    nodes, edges = _graph(spark)
    parent = graph.parents(nodes, edges)
    closed = {r.id: r.owner for r in graph.card_partition(nodes, parent).collect()}
    assert len(closed) == nodes.count()
    assert closed["c1"] == closed["t1"] == "run:1" and closed["f1"] is None and closed["art"] is None
    opened = spark.createDataFrame([("run:1",)], "id string")
    part = {r.id: r.owner for r in graph.card_partition(nodes, parent, opened).collect()}
    assert part["t1"] is None and part["a1"] == part["c1"] == "t1" and len(part) == nodes.count()
    assert {r.id for r in graph.card_partition(nodes, parent).where("reason = 'unreached'").collect()} == {"x", "y"}
    labels = {r.owner: r.label for r in graph.cluster_composition(graph.card_partition(nodes, parent)).collect()}
    assert labels == {"run:1": "1 invocation · 1 target · 1 action · 1 cache event"}


def test_deep_chain_orphan_and_cycle_keep_every_node(spark):
    chain = [(f"n{k:03}", "action") for k in range(100)]
    nodes = [("run:1", "run"), *chain, ("orphan", "target"), *[(f"c{k}", "action") for k in range(5)], ("into", "action")]
    edges = [("run:1", "n000"), *[(f"n{k:03}", f"n{k + 1:03}") for k in range(99)], ("gone", "orphan"), *[(f"c{k}", f"c{(k + 1) % 5}") for k in range(5)], ("c0", "into")]
    n = spark.createDataFrame(nodes, "id string, kind string")
    e = spark.createDataFrame([(*x, "e") for x in edges], "from string, to string, kind string")
    parent = graph.parents(n, e)
    runs = {r.id: (r.run, r.depth) for r in graph.run_attribution(n, parent).collect()}
    assert len(runs) == len(nodes) and all(runs[f"n{k:03}"] == ("run:1", k + 3) for k in range(100))
    assert runs["orphan"][0] is None and runs["c0"][0] is None and runs["into"][0] is None
    for opened, owner in (([], {f"n{k:03}": "run:1" for k in range(100)}), (["run:1", "n000"], {f"n{k:03}": "n001" for k in range(2, 100)})):
        part = graph.card_partition(n, parent, spark.createDataFrame([(o,) for o in opened], "id string")).collect()
        assert len(part) == len(nodes) and {r.id: r.owner for r in part if r.owner} == owner
        assert {r.id for r in part if r.reason} == {"into", *[f"c{k}" for k in range(5)]}


def test_first_edge_wins_and_dangling_edges_dont_count(spark):
    nodes = spark.createDataFrame([("run:1", "run"), ("run:2", "run"), ("a0", "action")], "id string, kind string")
    edges = spark.createDataFrame([("aaa-missing", "a0", "e", 0), ("run:2", "a0", "e", 1), ("run:1", "a0", "e", 2)], "from string, to string, kind string, ordinal int")
    assert graph.parents(nodes, edges).collect()[0].parent == "run:2"


def test_explicit_rows_and_scrubbed_labels(spark):
    rows = spark.createDataFrame([("n1", 1, "k1", None, None, "/tmp/a/b.txt", "high", None, "safe"), ("n2", 1, "k2", "note", "at /tmp/a/b.txt", "{}", None, "future", "blocked")],
                                 "id string, run_id int, node_key string, node_kind string, label string, payload string, confidence string, source_kind string, redaction_state string")
    got = {r.id: (r.kind, r.label, r.redaction_state, r.source_kind, r.confidence) for r in graph.explicit_nodes(rows).collect()}
    assert got["n1"] == ("graph_node", "k1", "redacted", "unknown", "high")
    assert got["n2"] == ("note", "at [REDACTED:abs_path]/b.txt", "blocked", "future", "unknown")
    edges = spark.createDataFrame([("e", None, "n1", "k", "n2", "link")], "id string, from_node_id string, from_node_key string, to_node_id string, to_node_key string, edge_kind string")
    assert graph.explicit_edges(edges).select("from", "to", "kind").first() == ("n1", "k", "link")


def test_search_ranks_name_then_keyword_then_scattered(spark):
    rows = spark.createDataFrame([("1", "a run here", "x"), ("2", "zzz", "running"), ("3", "r-u-n", "x"), ("4", "none", "x")], "id string, label string, kind string")
    assert [(r.id, r.score) for r in graph.ranked_search(rows, " run ").collect()] == [("1", 998), ("2", 500), ("3", 200)]
    assert graph.focus_counts(rows.withColumn("source_kind", F.lit("derived_v1")), ["kind"]).count() == 2
