"""Action graph: nodes, edges, attribution to runs, card and cluster partition (G family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions.endpoints import (
    EXECUTOR_FLAG, endpoint_is_open, endpoint_label, fingerprint, remote_endpoints, sanitize_args,
)
from evidmill.functions.paths import scrub_local_paths
from evidmill.functions.truth import truth_quad
from evidmill.session import broadcast_if_small, give_up, in_step, kept, steps_of

# Kinds that may fold into a cluster, in label order; the order in which edges are recorded; the greatest
# depth that is drawn for a node without a run.
GROUPABLE = ("invocation", "artifact", "target", "action", "cache_event")
EDGE_KINDS = (
    "authored_change", "validated_by", "recorded_invocation", "configured_remote_execution", "observed_worker_identity",
    "recorded_artifact", "evaluated_target", "produced_action", "observed_cache_event", "observed_failure",
)
MAX_DEPTH = 6
VISIBLE_NODES = 8
CHANGE_CLUSTER_MIN = 4
# Columns that are identity, label or bookkeeping and never part of a payload.
PAYLOAD_EXCLUDED = (
    "id", "stable_key", "source_kind", "confidence", "evidence_refs", "redaction_state", "created_at", "updated_at",
)


def payload_json(df: DataFrame, keep_stable_key: bool = False) -> Column:
    """The non-null own columns as JSON, endpoint arguments sanitised."""
    skip = [c for c in PAYLOAD_EXCLUDED if not (keep_stable_key and c == "stable_key")]
    cols = []
    for name in sorted(df.columns):
        if name in skip:
            continue
        cols.append(sanitize_args(F.col(name)).alias(name) if name == "command" else F.col(name))
    return F.to_json(F.struct(*cols)) if cols else F.lit("{}")


def relabel(value: Column, state: Column) -> tuple[Column, Column]:
    """Scrubbed text, and the state raised to redacted when something was scrubbed."""
    clean = scrub_local_paths(value)
    upgraded = F.when((clean != value) & state.isin("safe", "unknown"), "redacted").otherwise(state)
    return clean, upgraded


def nodes_of(df: DataFrame, kind: str | Column, node_id: Column, run: Column, label: Column, status: Column) -> DataFrame:
    """G1: one table as nodes."""
    payload = payload_json(df)
    named = F.lit(kind) if isinstance(kind, str) else kind
    out = df.select(
        node_id.alias("id"), run.alias("run_id"), named.alias("kind"), label.cast("string").alias("raw_label"),
        status.cast("string").alias("status"), payload.alias("raw_payload"), *truth_quad(refs=False),
    )
    return scrub_nodes(out)


def scrub_nodes(raw: DataFrame) -> DataFrame:
    label, state = relabel(F.col("raw_label"), F.col("redaction_state"))
    out = raw.withColumn("label", label).withColumn("redaction_state", state)
    payload, state = relabel(F.col("raw_payload"), F.col("redaction_state"))
    return out.withColumn("payload", payload).withColumn("redaction_state", state).drop("raw_label", "raw_payload")


def edge(kind: str, start: Column, end: Column) -> list[Column]:
    """Edge columns; the id names kind and both ends."""
    return [
        F.concat(F.lit(kind + ":"), start, F.lit(":"), end).alias("id"), start.alias("from"), end.alias("to"),
        F.lit(kind).alias("kind"),
    ]


def remote_configs(invocations: DataFrame) -> DataFrame:
    """A17, A18, J4 input: invocations that name a remote executor, and their last endpoint."""
    named = F.exists("command", lambda arg: arg.startswith(EXECUTOR_FLAG))  # cheap test before the fold
    rows = invocations.where(named).withColumn("endpoints", remote_endpoints(F.col("command"))).where(
        F.size("endpoints") > 0
    )
    last = F.element_at("endpoints", -1)
    return rows.select(
        "id", "run_id", "created_at", "source_kind", "confidence", "redaction_state", last.alias("endpoint"),
        endpoint_label(last).alias("endpoint_label"), fingerprint(last).alias("fingerprint"),
        (~endpoint_is_open(last)).alias("redacted"), F.size("endpoints").alias("endpoint_args"),
    )


def run_node(run_id: Column) -> Column:
    return F.concat(F.lit("run:"), run_id.cast("string"))


def build_graph(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all runs at once."""
    run, none = F.col("run_id"), F.lit(None).cast("string")
    col = F.col
    agents = t["agent_blocks"]
    configs = remote_configs(t["invocations"])
    config_id = F.concat(F.lit("remote_execution_config:"), col("id"))
    seen = t["worker_events"].select("run_id").distinct().withColumn("worker_seen", F.lit(True))
    config_rows = configs.join(seen, "run_id", "left").select(
        "id", "run_id", "endpoint_label", "fingerprint", "redacted", "endpoint_args",
        F.coalesce("worker_seen", F.lit(False)).alias("worker_seen"),
        F.lit("derived_v1").alias("source_kind"), F.lit("high").alias("confidence"), "redaction_state",
    )
    workers = configs.select("id", "run_id", "redaction_state").join(t["worker_events"], "run_id")
    worker_id = F.concat(F.lit("worker:"), col("id"), F.lit(":"), col("worker_name"))
    worker_rows = workers.select(
        "id", "run_id", "worker_name", "line_number", F.lit("collectable_v1").alias("source_kind"),
        F.lit("high").alias("confidence"), "redaction_state",
    )
    runs = t["runs"]
    nodes = [
        nodes_of(runs, "run", run_node(col("id")), col("id"), F.coalesce("scenario", "stable_key"), col("status")),
        nodes_of(agents, "agent", col("id"), run, F.coalesce("model", F.lit("agent")), none),
        nodes_of(t["changes"], "change", col("id"), run, F.coalesce("path", "id"), none),
        nodes_of(t["invocations"], "invocation", col("id"), run, col("invocation_kind"), col("exit_code")),
        nodes_of(config_rows, "remote_execution_config", config_id, run, col("endpoint_label"), F.lit("configured")),
        nodes_of(worker_rows, "worker", worker_id, run, col("worker_name"), F.lit("observed")),
        nodes_of(t["artifacts"], "artifact", col("id"), run, col("artifact_key"), none),
        nodes_of(t["targets"], "target", col("id"), run, F.coalesce("label", "id"), col("status")),
        nodes_of(t["actions"], "action", col("id"), run, F.coalesce("mnemonic", "id"), col("status")),
        nodes_of(t["cache_events"], "cache_event", col("id"), run, F.coalesce("event_kind", "id"), none),
        nodes_of(t["failures"], "failure", col("id"), run, F.coalesce("failure_kind", F.lit("failure")), none),
    ]
    # The last agent block of a run authored its changes.
    author = agents.groupBy("run_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("agent"))
    at_run = run_node(run)
    edges = [
        t["changes"].join(author, "run_id").select(*edge("authored_change", col("agent"), col("id"))),
        t["changes"].select(*edge("validated_by", col("id"), at_run)),
        t["invocations"].select(*edge("recorded_invocation", at_run, col("id"))),
        config_rows.select(*edge("configured_remote_execution", col("id"), config_id)),
        worker_rows.select(*edge("observed_worker_identity", config_id, worker_id)),
        t["artifacts"].select(*edge("recorded_artifact", at_run, col("id"))),
        t["targets"].select(*edge("evaluated_target", at_run, col("id"))),
        # The parent is the nearest recorded owner.
        t["actions"].select(*edge("produced_action", F.coalesce("target_id", at_run), col("id"))),
        t["cache_events"].select(*edge("observed_cache_event", F.coalesce("action_id", "target_id", at_run), col("id"))),
        t["failures"].select(*edge("observed_failure", at_run, col("id"))),
    ]
    return _union(nodes), _union(edges)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def explicit_nodes(graph_nodes: DataFrame) -> DataFrame:
    """G1: stored nodes, with their label fallbacks."""
    return nodes_of(
        graph_nodes, F.coalesce("node_kind", F.lit("graph_node")), F.col("id"), F.col("run_id"),
        F.coalesce("label", "node_key", "id"), F.lit(None).cast("string"),
    )


def explicit_edges(graph_edges: DataFrame) -> DataFrame:
    """Stored edges; an end without an id falls back to its key."""
    return graph_edges.select(
        "id", F.coalesce("from_node_id", "from_node_key").alias("from"),
        F.coalesce("to_node_id", "to_node_key").alias("to"), F.col("edge_kind").alias("kind"),
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node and edge kind."""
    n = nodes.groupBy(F.lit("node").alias("part"), "kind").agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.lit("edge").alias("part"), "kind").agg(F.count("*").alias("n")))


def connected_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends exist.

    The ends that are no node are found by one grouping of all names, in steps. They are few as a rule, so the edges themselves are not shuffled.
    """
    ends = edges.where("from IS NOT NULL AND to IS NOT NULL")
    flag = lambda df, name, node: df.select(F.col(name).alias("id"), F.lit(node).alias("node"))
    named = kept(flag(nodes, "id", 1).unionByName(flag(ends, "from", 0)).unionByName(flag(ends, "to", 0)), "names")
    steps = steps_of(named.count())
    lost = kept((in_step(named, "id", k, steps).groupBy("id").agg(F.max("node").alias("node")).where("node = 0").select("id") for k in steps), "lost")
    give_up(named)
    for side in ("from", "to"):
        ends = ends.join(broadcast_if_small(lost.withColumnRenamed("id", side)), side, "left_anti")
    return ends.select("from", "to", *[c for c in edges.columns if c not in ("from", "to")])


def producing_invocations(artifacts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Artifact and the invocation its evidence names, where that node exists."""
    ref = kept(artifacts.select("id", F.posexplode("evidence_refs").alias("slot", "ref")).where(
        F.col("ref").rlike("^invocation:.+$")
    ).select("id", "slot", F.substr("ref", F.lit(12)).alias("owner")), "refs")
    owners = ref.select("owner").distinct()
    known = nodes.select(F.col("id").alias("owner")).join(broadcast_if_small(owners), "owner", "left_semi").distinct()
    return ref.join(known, "owner", "left_semi").groupBy("id").agg(F.max_by("owner", "slot").alias("owner"))


def parents(nodes: DataFrame, edges: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Parent of each node: the first edge into it, replaced by the J15 override; edges with a missing end don't count.

    First by the edges' ``ordinal`` where they have one, then by the recorded order of their kinds, then by ``from``. One grouping
    by name, in steps, tells the first edge into a node and which starts of edges are no node; only nodes with an edge from such a
    start are looked at again.
    """
    place = F.array_position(F.array(*[F.lit(k) for k in EDGE_KINDS]), F.col("kind"))
    late = F.when(place > 0, place).otherwise(len(EDGE_KINDS) + 1)
    ordinal = F.col("ordinal") if "ordinal" in edges.columns else F.lit(0)
    ends = kept(edges.where("from IS NOT NULL AND to IS NOT NULL").select("from", "to", ordinal.alias("o"), late.alias("k")), "edges")
    at = F.struct("o", "k", F.col("from").alias("f"))
    steps = steps_of(3 * ends.count())
    owned = None if override is None else kept(override.select("id", "owner"), "owners")

    def told(k: int) -> DataFrame:
        into = in_step(ends, "to", k, steps).select(F.col("to").alias("id"), F.lit(0).alias("node"), F.lit(0).alias("asked"), at.alias("at"), F.lit(None).cast("string").alias("owner"))
        none = F.lit(None).cast(into.schema["at"].dataType)
        rows = [
            into, in_step(nodes, "id", k, steps).select("id", F.lit(1).alias("node"), F.lit(0).alias("asked"), none.alias("at"), F.lit(None).cast("string").alias("owner")),
            in_step(ends, "from", k, steps).select(F.col("from").alias("id"), F.lit(0).alias("node"), F.lit(1).alias("asked"), none.alias("at"), F.lit(None).cast("string").alias("owner"))]
        if owned is not None:
            rows.append(in_step(owned, "id", k, steps).select("id", F.lit(0).alias("node"), F.lit(0).alias("asked"), none.alias("at"), "owner"))
        met = reduce(DataFrame.unionByName, rows).where("id IS NOT NULL").groupBy("id").agg(
            F.max("node").alias("node"), F.max("asked").alias("asked"), F.min("at").alias("at"), F.max("owner").alias("owner"))
        lost = (F.col("asked") == 1) & (F.col("node") == 0)
        first = F.when(F.col("node") == 1, F.col("at.f"))
        return met.select("id", first.alias("first"), "owner", lost.alias("lost")).where("lost OR first IS NOT NULL OR owner IS NOT NULL")

    met = kept((told(k) for k in steps), "parents")
    lost = met.where("lost").select(F.col("id").alias("from"))
    own = met.where("first IS NOT NULL OR owner IS NOT NULL")
    if lost.isEmpty():
        give_up(ends)
        return own.select("id", F.coalesce("owner", "first").alias("parent"))
    lost = broadcast_if_small(lost)
    hit = kept(ends.join(lost, "from", "left_semi").select(F.col("to").alias("id")).distinct(), "hit")
    again = ends.join(broadcast_if_small(hit.withColumnRenamed("id", "to")), "to", "left_semi").join(lost, "from", "left_anti")
    second = kept(again.groupBy(F.col("to").alias("id")).agg(F.min(at).alias("at")).select("id", F.col("at.f").alias("second")), "second")
    seen = hit.join(second, "id", "left").select("id", "second", F.lit(True).alias("hit"))
    mended = own.join(broadcast_if_small(kept(seen, "seen")), "id", "left")
    first = F.when(F.col("hit") & F.col("first").isNotNull(), F.col("second")).otherwise(F.col("first"))
    out = kept(mended.select("id", F.coalesce("owner", first).alias("parent")).where("parent IS NOT NULL"), "parents")
    give_up(ends)
    give_up(met)
    return out


def settled_ids(nodes: DataFrame) -> DataFrame:
    """``id, kind`` of all nodes, written once for the walks over them."""
    return kept(nodes.select("id", "kind"), "nodes")


def jumped(level: DataFrame, merge: dict[str, Column]) -> DataFrame:
    """Pointer doubling: ``level`` is ``id, target, ended, ...``, kept apart by ``ended``; every open row takes over where its target stands.

    ``merge`` gives the new value of each further column from its own (``x``) and the target's (``x_up``). The distance
    doubles from round to round, so the rounds are the logarithm of the longest way. Only open rows move and are written
    again, and their former files go; a row that has ended stays in the part of its round. A round that ends no further row has only ways into a cycle left; these stay open.
    A round over many rows goes in steps, by target.
    """
    columns = level.columns
    parts, going = [level.where("ended")], level.where("NOT ended")
    left, steps = going.count(), steps_of(level.count())
    while left:
        now = reduce(DataFrame.unionByName, parts, going).select("id", "target", "ended", *merge)
        up = now.select([F.col(c).alias(f"{c}_up") for c in now.columns])

        def moved(k: int) -> DataFrame:
            met = in_step(going, "target", k, steps).join(in_step(up, "id_up", k, steps), F.col("target") == F.col("id_up"))
            return met.select("id", F.col("target_up").alias("target"), F.col("ended_up").alias("ended"), *[
                c for c in columns if c not in ("id", "target", "ended", *merge)], *[value.alias(name) for name, value in merge.items()]).select(*columns)

        settled = kept((moved(k) for k in steps), "ways", "ended")
        give_up(level, "/ended=false")
        parts, going, before = [*parts, settled.where("ended")], settled.where("NOT ended"), left
        level, left = settled, going.count()
        if left == before:
            break
    return reduce(DataFrame.unionByName, parts, going)


def run_attribution(nodes: DataFrame, parent: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The run each node leads to and its depth, however far; run NULL when its way ends elsewhere or in a cycle.

    ``max_depth`` clips the depth of nodes without a run, which is for display only.
    """
    # An id is one node.
    steps = steps_of(2 * nodes.count())
    ways = kept((in_step(nodes, "id", k, steps).groupBy("id").agg(F.min("kind").alias("kind")).join(in_step(parent, "id", k, steps), "id", "left").select("id", "kind", "parent")
                 for k in steps), "ways")
    at_run = ways.where("kind = 'run'").select(F.col("id").alias("parent"), F.lit(True).alias("at_run")).distinct()
    led, bare = ways.where("kind <> 'run' AND parent IS NOT NULL"), ways.where("kind <> 'run' AND parent IS NULL")
    # A way ends at a run, or at a node that has no parent: then its target is NULL.
    row = lambda df, ended: df.select("id", F.col("parent").alias("target"), ended.alias("ended"), F.lit(1).cast("long").alias("hops"), "kind")
    start = [row(in_step(led, "parent", k, steps).join(in_step(at_run, "parent", k, steps), "parent", "left"), F.col("at_run").isNotNull()) for k in steps]
    begun = kept([*start, row(bare, F.lit(True))], "starts", "ended")
    give_up(ways)
    done = jumped(begun, {"hops": F.col("hops") + F.col("hops_up")})
    out = done.select("id", "kind", F.when(F.col("ended"), F.col("target")).alias("run"), (F.col("hops") + 2).alias("depth"))
    out = out.unionByName(nodes.where("kind = 'run'").select("id", "kind").distinct().select("id", "kind", F.col("id").alias("run"), F.lit(2).cast("long").alias("depth")))
    lost = F.when(F.col("run").isNull(), F.least("depth", F.lit(max_depth).cast("long"))).otherwise(F.col("depth"))
    depth = F.when(F.col("kind") == "agent", 0).when(F.col("kind") == "change", 1).otherwise(lost)
    return out.withColumn("depth", depth.cast("int"))


def artifact_attribution(attributed: DataFrame) -> DataFrame:
    """Artifacts per run, with the unattributed ones as their own row."""
    return attributed.where("kind = 'artifact'").groupBy(
        F.coalesce("run", F.lit("unattributed")).alias("run")
    ).agg(F.count("*").alias("artifacts"))


def card_partition(nodes: DataFrame, parent: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Every node is either a card or a member of one cluster (``owner`` set); none is left out.

    Kinds outside GROUPABLE, and nodes without a parent, are cards. A groupable child of a card is a card only when that
    card is expanded, otherwise it and its groupable descendants fold into the card's cluster: the owner is the topmost
    node above that isn't expanded. Nodes whose way up never ends are cards with the ``reason`` ``unreached``.
    """
    opened = (nodes.select("id").limit(0) if expanded is None else expanded.select("id")).distinct().select(F.col("id").alias("parent"), F.lit(True).alias("open"))
    steps = steps_of(2 * nodes.count())
    base = kept((in_step(nodes, "id", k, steps).select("id", "kind").distinct().join(in_step(parent, "id", k, steps), "id", "left").select("id", "kind", "parent") for k in steps), "cards")
    inner = F.coalesce(F.col("kind").isin(*GROUPABLE) & F.col("parent").isNotNull(), F.lit(False))
    known = base.groupBy(F.col("id").alias("parent")).agg(F.max(F.col("kind").isin(*GROUPABLE) & F.col("parent").isNotNull()).alias("on"))
    none = F.lit(None).cast("string")

    def begun(k: int) -> DataFrame:
        """``owner``: the topmost closed node on the way so far; ``ended`` is NULL for what stands below no node."""
        met = in_step(base.where(inner), "parent", k, steps).join(in_step(known, "parent", k, steps), "parent", "left").join(in_step(opened, "parent", k, steps), "parent", "left")
        return met.select("id", F.col("parent").alias("target"), (~F.col("on")).alias("ended"), F.when(F.col("open"), none).otherwise(F.col("parent")).alias("owner"), "kind")

    start = kept((begun(k) for k in steps), "folds", "ended")
    done = jumped(start, {"owner": F.coalesce("owner_up", "owner")})
    alone = base.where(~inner).select("id", "kind").unionByName(start.where("ended IS NULL").select("id", "kind"))
    return done.select("id", "kind", F.when(F.col("ended"), F.col("owner")).alias("owner"), F.when(~F.col("ended"), "unreached").alias("reason")).unionByName(
        alone.select("id", "kind", none.alias("owner"), none.alias("reason")))


def change_cluster(nodes: DataFrame, least: int = CHANGE_CLUSTER_MIN) -> DataFrame:
    """Runs of a graph with enough changes fold them into one stack."""
    return nodes.where("kind = 'change'").groupBy("run_id").agg(F.count("*").alias("changes")).withColumn(
        "folded", F.col("changes") >= least
    )


def cluster_composition(partition: DataFrame) -> DataFrame:
    """Members per kind in fixed order, the label text and the dominant kind."""
    wide = partition.where("owner IS NOT NULL").groupBy("owner").agg(
        F.count("*").alias("members"), *[F.count_if(F.col("kind") == k).alias(k) for k in GROUPABLE]
    )
    parts = [
        F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(" " + k.replace("_", " ")), F.when(F.col(k) == 1, "").otherwise("s")))
        for k in GROUPABLE
    ]
    best = F.greatest(*GROUPABLE)
    dominant = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in GROUPABLE])
    return wide.select("owner", "members", F.concat_ws(" · ", *parts).alias("label"), dominant.alias("dominant"))


def visible_hint(nodes: DataFrame, visible: int = VISIBLE_NODES) -> DataFrame:
    """L4: nodes of a run beyond the visible number."""
    return nodes.groupBy("run_id").agg(F.count("*").alias("nodes")).select(
        "run_id", F.least("nodes", F.lit(visible)).alias("visible"),
        F.greatest(F.col("nodes") - visible, F.lit(0)).alias("overflow"),
    )


# What each focus shows.
FOCUS = {
    "cache": ("cache_event",), "failures": ("failure",),
    "remote": ("remote_execution_config", "worker_readiness"), "agent": ("agent", "change"),
}


def focus_counts(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Honest match counts per focus; ``remote_highlight`` falls back to all nodes."""
    counts = [F.count("*").alias("all")] + [
        F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in FOCUS.items()
    ] + [F.count_if(F.col("source_kind") == "derived_v1").alias("derived")]
    out = nodes.groupBy(*keys).agg(*counts)
    return out.withColumn("remote_highlight", F.when(F.col("remote") > 0, F.col("remote")).otherwise(F.col("all")))


def evidence_tone(nodes: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Collectable, simulated, mixed or none, from the sources of a group's nodes."""
    out = nodes.groupBy(*keys).agg(
        F.count_if(F.col("source_kind") == "collectable_v1").alias("c"),
        F.count_if(F.col("source_kind") == "simulated_v1").alias("s"),
    )
    c, s = F.col("c"), F.col("s")
    tone = (
        F.when((F.col(group).cast("string") == "latest") | (s > c), "simulated")
        .when((s > 0) & (c > 0), "mixed")
        .when(c > 0, "collectable")
        .otherwise("none")
    )
    return out.select(*keys, c.alias("collectable"), s.alias("simulated"), tone.alias("tone"))


def ranked_search(nodes: DataFrame, query: str, keywords: str = "kind") -> DataFrame:
    """Nodes ranked by where ``query`` occurs in the label, then in the keyword."""
    import re

    text = query.strip().lower()
    label, word = F.lower("label"), F.lower(F.col(keywords))
    scattered = ".*".join(re.escape(ch) for ch in text)
    score = (
        F.when(F.instr(label, text) > 0, 1001 - F.instr(label, text))
        .when(F.instr(word, text) > 0, 501 - F.instr(word, text))
        .when(label.rlike("(?s)" + scattered), 200)
        .when(word.rlike("(?s)" + scattered), 100)
    )
    return nodes.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "id")
