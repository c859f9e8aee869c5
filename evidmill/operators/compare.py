"""Comparison of run groups, for any number of pairs at once (C family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidmill.functions.labels import hash_prefix
from evidmill.operators.grouping import global_index, per_group
from evidmill.operators.rollup import cache_metrics, run_group_index, status_counts, status_key


def group_facts(
    runs: DataFrame, cache_events: DataFrame, worker_events: DataFrame, agent_blocks: DataFrame
) -> DataFrame:
    """What a comparison needs of each group, computed once for all groups."""
    workers = per_group(runs, worker_events, {"worker_rows": ("sum", F.lit(1))})
    agents = per_group(runs, agent_blocks, {"agent_blocks": ("sum", F.lit(1))})
    return (
        runs.groupBy("run_group").agg(F.count("*").alias("runs"))
        .join(cache_metrics(runs, cache_events), "run_group")
        .join(workers, "run_group")
        .join(agents, "run_group")
        .select("run_group", "runs", "hits", "misses", "unknown", "hit_rate",
                (F.col("worker_rows") > 0).alias("worker_seen"), "agent_blocks")
    )


def adjacent_pairs(runs: DataFrame) -> DataFrame:
    """Each group with the next newer one; group order by last start, then name."""
    index = run_group_index(runs).select("run_group", "last_started_at")
    placed = global_index(index, [F.asc_nulls_first("last_started_at"), F.desc("run_group")], "place")
    left = placed.select((F.col("place") + 1).alias("place"), F.col("run_group").alias("left_group"))
    return left.join(placed.select("place", F.col("run_group").alias("right_group")), "place").drop("place")


def missing_sides(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Requested groups that hold no run; the caller refuses when any is returned."""
    asked = pairs.select(F.lit("left").alias("side"), F.col("left_group").alias("run_group")).unionByName(
        pairs.select(F.lit("right").alias("side"), F.col("right_group").alias("run_group"))
    ).distinct()
    return asked.join(runs.select("run_group").distinct(), "run_group", "left_anti")


def _signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def compare_groups(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Run counts, cache metrics, worker identity and agent presence per pair."""
    names = [c for c in facts.columns if c != "run_group"]
    side = lambda s: facts.select(
        F.col("run_group").alias(f"{s}_group"), *[F.col(c).alias(f"{s}_{c}") for c in names]
    )
    both = pairs.join(side("left"), "left_group").join(side("right"), "right_group")
    delta = lambda c: F.col(f"right_{c}") - F.col(f"left_{c}")
    changed = ~F.col("left_worker_seen").eqNullSafe(F.col("right_worker_seen"))
    return both.select(
        "left_group", "right_group",
        "left_runs", "right_runs", delta("runs").alias("delta_runs"),
        "left_hits", "right_hits", delta("hits").alias("delta_hits"),
        "left_misses", "right_misses", delta("misses").alias("delta_misses"),
        "left_hit_rate", "right_hit_rate", delta("hit_rate").alias("delta_hit_rate"),
        "left_worker_seen", "right_worker_seen", changed.alias("worker_changed"),
        F.when(F.col("left_worker_seen") | F.col("right_worker_seen"), "high").otherwise("medium").alias("worker_confidence"),
        "left_agent_blocks", "right_agent_blocks", delta("agent_blocks").alias("delta_agent_blocks"),
        ((F.col("left_agent_blocks") > 0) != (F.col("right_agent_blocks") > 0)).alias("agent_presence_changed"),
    )


def facts_of_sources(sources: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """``group_facts`` of several datasets, one below the other, with the ``source`` each group is from."""
    names = ("runs", "cache_events", "worker_events", "agent_blocks")
    parts = [group_facts(*[tables[n] for n in names]).withColumn("source", F.lit(source)) for source, tables in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def compare_sources(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Group A of source X against group B of source Y.

    ``pairs``: left_source, left_group, right_source, right_group; ``facts``: those of ``facts_of_sources``. Groups of one name in
    two sources are two groups.
    """
    name = lambda source, group: F.struct(F.col(source).alias("source"), F.col(group).alias("run_group"))
    keyed = facts.withColumn("run_group", name("source", "run_group")).drop("source")
    asked = pairs.select(name("left_source", "left_group").alias("left_group"), name("right_source", "right_group").alias("right_group"))
    out = compare_groups(asked, keyed)
    sides = [F.col(f"{side}_group.{field}").alias(f"{side}_{label}") for side in ("left", "right") for field, label in (("source", "source"), ("run_group", "group"))]
    return out.select(*sides, *[c for c in out.columns if c not in ("left_group", "right_group")])


def agent_summaries(runs: DataFrame, agent_blocks: DataFrame) -> DataFrame:
    """C4: hash-level summary rows of the agent blocks of each group."""
    return agent_blocks.join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id").select(
        "run_group", F.col("id").alias("block_id"), "model", hash_prefix(F.col("prompt_sha256")).alias("prompt_prefix"),
        "provenance_class", F.coalesce("live", F.lit(False)).alias("receipt_verified"),
    )


def status_deltas(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per pair and status the two counts and their delta, missing as zero.

    Both sides are stacked and summed: one shuffle instead of a full outer join.
    """
    counts = status_counts(runs, None, status_key())
    side = lambda s, sign: pairs.join(counts.withColumnRenamed("run_group", f"{s}_group"), f"{s}_group").select(
        "left_group", "right_group", "status",
        F.when(F.lit(s == "left"), F.col("n")).otherwise(0).alias("l"),
        F.when(F.lit(s == "right"), F.col("n")).otherwise(0).alias("r"),
    )
    return (
        side("left", -1).unionByName(side("right", 1))
        .groupBy("left_group", "right_group", "status")
        .agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n"))
        .withColumn("delta", F.col("right_n") - F.col("left_n"))
    )


def headlines(compared: DataFrame) -> DataFrame:
    """Value, delta text and tone of each dimension of a pair."""
    tone = lambda d: F.when(d > 0, "increase").when(d < 0, "decrease").otherwise("flat")
    text = lambda c: F.col(c).cast("string")
    runs = F.struct(
        F.lit("run_counts").alias("dimension"), text("left_runs").alias("left_value"), text("right_runs").alias("right_value"),
        F.concat(F.lit("Δ "), _signed(F.col("delta_runs"))).alias("delta_text"), tone(F.col("delta_runs")).alias("tone"),
    )
    ratio = lambda s: F.concat_ws("/", text(f"{s}_hits"), text(f"{s}_misses"))
    cache = F.struct(
        F.lit("cache_metrics").alias("dimension"), ratio("left").alias("left_value"), ratio("right").alias("right_value"),
        F.concat(F.lit("Δ "), _signed(F.col("delta_hits"))).alias("delta_text"), tone(F.col("delta_hits")).alias("tone"),
    )
    seen = lambda s: F.when(F.col(f"{s}_worker_seen"), "observed").otherwise("not observed")
    match = F.when(F.col("worker_changed"), "differs").otherwise("match")
    worker = F.struct(
        F.lit("worker_identity").alias("dimension"), seen("left").alias("left_value"), seen("right").alias("right_value"),
        match.alias("delta_text"), match.alias("tone"),
    )
    return compared.select("left_group", "right_group", F.explode(F.array(runs, cache, worker)).alias("h")).select(
        "left_group", "right_group", "h.*"
    )


def named_groups(documents: DataFrame) -> DataFrame:
    """Distinct run groups named by comparison documents, first count wins, name order.

    ``documents``: (ordinal, left_run_group, right_run_group, left_runs, right_runs, refs).
    """
    sides = documents.select("ordinal", F.explode(F.array(
        F.struct(F.lit(0).alias("slot"), F.col("left_run_group").alias("run_group"), F.col("left_runs").alias("n")),
        F.struct(F.lit(1).alias("slot"), F.col("right_run_group").alias("run_group"), F.col("right_runs").alias("n")),
    )).alias("s")).select("ordinal", "s.*")
    refs = documents.select("ordinal", F.posexplode("refs").alias("slot", "ref")).where(
        F.col("ref").startswith("run_group:")
    ).select("ordinal", (F.col("slot") + 2).alias("slot"), F.substr("ref", F.lit(11)).alias("run_group"),
             F.lit(None).cast("bigint").alias("n"))
    return sides.unionByName(refs).where("run_group IS NOT NULL AND run_group <> ''").groupBy("run_group").agg(
        F.min_by(F.struct("n"), F.struct("ordinal", "slot")).alias("first")
    ).select("run_group", F.col("first.n").alias("run_count")).orderBy("run_group")
