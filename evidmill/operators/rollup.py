"""Roll-ups per run group: statuses, cache economics, labels, history (A family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from evidmill.functions.truth import quad_columns, quad_partials
from evidmill.operators.grouping import latest, per_group, roll_up

# Presence states and the names of their counters, in report order.
PRESENCE_COUNTERS = {
    "local_verified": "verified_count",
    "local_present": "present_unverified",
    "local_mismatch": "mismatched",
    "missing": "missing",
    "unverified_remote_reference": "unverified_remote",
    "remote_verified": "remote_verified",
    "remote_present": "remote_present",
    "remote_mismatch": "remote_mismatch",
    "remote_missing": "remote_missing",
}


def _count(cond: Column) -> tuple[str, Column]:
    return ("sum", F.when(cond, 1).otherwise(0))


def rate(hits: Column, misses: Column) -> Column:
    return F.try_divide(hits, hits + misses)


def scan_of_runs(child: DataFrame, runs: DataFrame) -> DataFrame:
    """Child rows whose run is in ``runs`` (semi join, never an id list)."""
    return child.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")


def in_scan_order(df: DataFrame) -> DataFrame:
    """The reading order of child rows."""
    return df.orderBy(F.asc_nulls_first("created_at"), F.asc_nulls_first("id"))


def run_scan(runs: DataFrame, run_group) -> DataFrame:
    """The runs of one group, unknown start first."""
    return runs.where(F.col("run_group") == F.lit(run_group)).orderBy(
        F.asc_nulls_first("started_at"), F.asc_nulls_first("created_at"), F.asc_nulls_first("id")
    )


def status_key(status: str | None = "status", kind: str | None = None) -> Column:
    """A1: the key a row is counted under."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in (status, kind) if c]
    return F.coalesce(*parts, F.lit("unknown"))


def status_counts(runs: DataFrame, child: DataFrame | None, key: Column) -> DataFrame:
    """A1: ``(run_group, status, n)``; children are combined per run before the join."""
    if child is None:
        return runs.groupBy("run_group", key.alias("status")).agg(F.count("*").alias("n"))
    per_run = child.groupBy("run_id", key.alias("status")).agg(F.count("*").alias("n"))
    joined = per_run.join(runs.select(F.col("id").alias("run_id"), "run_group"), "run_id")
    return joined.groupBy("run_group", "status").agg(F.sum("n").alias("n"))


def cache_partials() -> dict:
    hit = F.col("hit")
    return {"hits": _count(hit), "misses": _count(~hit), "unknown": _count(hit.isNull())}


def cache_metrics(runs: DataFrame, cache_events: DataFrame) -> DataFrame:
    """A2: hits, misses, unknown and hit rate per run group."""
    out = per_group(runs, cache_events, cache_partials())
    return out.withColumn("hit_rate", rate(F.col("hits"), F.col("misses")))


def seconds_between(start: Column, end: Column) -> Column:
    """seconds from ISO text to ISO text; NULL when unparseable or negative.

    Text without a zone is read as UTC (the session zone).
    """
    begin, finish = F.try_to_timestamp(start), F.try_to_timestamp(end)
    gap = (F.unix_micros(finish) - F.unix_micros(begin)) / F.lit(1e6)
    return F.when(gap >= 0, gap)


def run_durations(runs: DataFrame, invocations: DataFrame) -> DataFrame:
    """A5: ``(run_id, duration_seconds)``; own span first, else the longest invocation."""
    longest = invocations.groupBy("run_id").agg(
        F.max(seconds_between(F.col("started_at"), F.col("ended_at"))).alias("inv_seconds")
    )
    own = runs.select(
        F.col("id").alias("run_id"),
        seconds_between(F.col("started_at"), F.col("ended_at")).alias("own_seconds"),
    )
    return own.join(longest, "run_id", "left").select(
        "run_id", F.coalesce("own_seconds", "inv_seconds").alias("duration_seconds")
    )


def cache_legs(runs: DataFrame, invocations: DataFrame, cache_events: DataFrame) -> DataFrame:
    """A3: one leg per run, for groups that hold at least two runs."""
    per_run = roll_up(cache_events, ["run_id"], cache_partials())
    # The group size comes from an aggregate: a window would gather a whole group.
    sizes = runs.groupBy("run_group").agg(F.count("*").alias("n")).where("n >= 2").select("run_group")
    legs = runs.join(sizes, "run_group", "left_semi").select(
        F.col("id").alias("run_id"), "run_group", "scenario", "mode", "status", "started_at", "created_at"
    )
    legs = legs.join(run_durations(runs, invocations), "run_id", "left").join(per_run, "run_id", "left")
    for name in ("hits", "misses", "unknown"):
        legs = legs.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return legs.withColumn("hit_rate", rate(F.col("hits"), F.col("misses")))


def cold_warm(legs: DataFrame, cold: str = "cold-cache", warm: str = "warm-cache") -> DataFrame:
    """Last cold leg against last warm leg of each group, without a self join."""
    last = latest(
        legs.where(F.col("scenario").isin(cold, warm)).select(
            "run_group", "scenario", "hit_rate", "duration_seconds", "started_at", "created_at", "run_id"
        ),
        ["run_group", "scenario"],
        [F.col("started_at"), F.col("created_at"), F.col("run_id")],
    )
    side = {cold: "cold", warm: "warm"}
    wide = last.groupBy("run_group").agg(
        *[
            F.max(F.when(F.col("scenario") == scenario, F.col(value))).alias(f"{name}_{value}")
            for scenario, name in side.items()
            for value in ("hit_rate", "duration_seconds")
        ],
        F.count("*").alias("sides"),
    )
    cr, wr = F.col("cold_hit_rate"), F.col("warm_hit_rate")
    cd, wd = F.col("cold_duration_seconds"), F.col("warm_duration_seconds")
    return wide.where("sides = 2").select(
        "run_group", cr, wr, cd, wd,
        F.coalesce(wr > cr, F.lit(False)).alias("warm_hit_rate_higher"),
        F.coalesce(wd < cd, F.lit(False)).alias("warm_duration_lower"),
        (wr - cr).alias("hit_rate_delta"),
        (wd - cd).alias("duration_delta_seconds"),
    )


def label_rollup(runs: DataFrame, child: DataFrame) -> DataFrame:
    """A6, A8, A9 of a child table per run group."""
    out = per_group(runs, child, quad_partials())
    return out.select("run_group", *quad_columns())


def evidence_mix(rows: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """Share of each source kind and the dominant one by count.

    Kinds outside ``order`` count as unknown, and ties go to the earlier kind.
    """
    kind = F.when(F.col("source_kind").isin(*order), F.col("source_kind")).otherwise("unknown")
    counts = rows.groupBy(*keys, kind.alias("kind")).agg(F.count("*").alias("n"))
    rank = F.array_position(F.lit(list(order)), F.col("kind"))
    # At most one row per kind and key from here on.
    total = Window.partitionBy(*keys)
    best = F.max_by("kind", F.struct(F.col("n"), -rank)).over(total)
    return counts.select(
        *keys, "kind", "n", (F.col("n") / F.sum("n").over(total)).alias("fraction"), best.alias("dominant")
    )


def ordered_refs(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct evidence refs with the place they were first seen.

    Long form (one row per ref): sort by ``first_seen`` for first-occurrence order.
    """
    flat = rows.select(*keys, *order, F.posexplode("evidence_refs").alias("slot", "ref"))
    place = F.struct(*[F.col(c) for c in order], "slot")
    return flat.groupBy(*keys, "ref").agg(F.min(place).alias("first_seen"))


def run_group_index(runs: DataFrame) -> DataFrame:
    """One row per group with its run count and first and last start."""
    return runs.groupBy("run_group").agg(
        F.count("*").alias("run_count"),
        F.min("started_at").alias("first_started_at"),
        F.max("started_at").alias("last_started_at"),
    )


def newest_first(index: DataFrame) -> DataFrame:
    return index.orderBy(F.desc_nulls_last("last_started_at"), F.asc_nulls_first("run_group"))


def newest_groups(index: DataFrame, n: int) -> DataFrame:
    """L1: the newest ``n`` groups; a top-k plan, no full sort."""
    return newest_first(index).limit(n)


def packet_counts(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table and group, all groups kept, zero where a table is empty."""
    out = runs.groupBy("run_group").agg(F.count("*").alias("runs"))
    for name, child in tables.items():
        counts = per_group(runs, child, {name: ("sum", F.lit(1))})
        out = out.join(counts, "run_group", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def presence_rollup(references: DataFrame, keys: list[str]) -> DataFrame:
    """Total and one counter per presence state."""
    counters = {n: _count(F.col("presence") == p) for p, n in PRESENCE_COUNTERS.items()}
    return roll_up(references, keys, {"total": ("sum", F.lit(1)), **counters})


def run_history(
    runs: DataFrame, tables: dict[str, DataFrame], cache_events: DataFrame, agent_blocks: DataFrame | None = None
) -> DataFrame:
    """Index, latest scenario and mode, packet counts, cache metrics, agent flags."""
    last = latest(
        runs.select("run_group", "scenario", "mode", "started_at", "created_at", "id"),
        ["run_group"],
        [F.col("started_at"), F.col("created_at"), F.col("id")],
    ).select("run_group", "scenario", "mode")
    statuses = status_counts(runs, None, status_key())
    listing = statuses.groupBy("run_group").agg(
        F.concat_ws(
            ",", F.array_sort(F.collect_list(F.concat_ws("=", "status", F.col("n").cast("string"))))
        ).alias("status_counts")
    )
    out = (
        run_group_index(runs)
        .join(last, "run_group")
        .join(listing, "run_group")
        .join(packet_counts(runs, tables).drop("runs"), "run_group")
        .join(cache_metrics(runs, cache_events), "run_group")
    )
    if agent_blocks is None:
        return out.withColumn("agent_blocks", F.lit(0))
    agents = per_group(runs, agent_blocks, {"agent_blocks": ("sum", F.lit(1))})
    return out.join(agents, "run_group", "left").withColumn(
        "agent_blocks", F.coalesce(F.col("agent_blocks"), F.lit(0))
    )


def history_totals(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("run_groups"), F.sum("run_count").alias("total_runs"))


def block_mix(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Proof blocks by source kind; the buckets sum to the total."""
    kind = F.col("source_kind")
    buckets = {
        "recorded": kind == "collectable_v1",
        "computed": kind == "derived_v1",
        "simulated": kind == "simulated_v1",
        "not_collected": kind == "future",
    }
    known = F.coalesce(kind.isin("collectable_v1", "derived_v1", "simulated_v1", "future"), F.lit(False))
    return roll_up(
        blocks, keys,
        {"total": ("sum", F.lit(1)), **{n: _count(c) for n, c in buckets.items()}, "unknown": _count(~known)},
    )


def lane_counts(nodes: DataFrame, keys: list[str], lanes: tuple[str, ...]) -> DataFrame:
    """Rows per lane over a fixed lane domain; empty lanes stay with zero."""
    wide = roll_up(nodes, keys, {lane: _count(F.col("kind") == lane) for lane in lanes})
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("n")) for n in lanes]))
    return wide.select(*keys, pairs.alias("p")).select(*keys, "p.lane", "p.n")


def counts_per_table(runs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``(run_group, table_name, n)`` with a total row per group from a roll-up."""
    parts = None
    for name, child in tables.items():
        if name == "runs":
            one = runs.groupBy("run_group").agg(F.count("*").alias("n"))
        else:
            one = per_group(runs, child, {"n": ("sum", F.lit(1))}).where("n > 0")
        one = one.withColumn("table_name", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts.rollup("run_group", "table_name").agg(F.sum("n").alias("n"))


def source_ledger(listing: DataFrame) -> DataFrame:
    """How many sources are readable, unreadable or empty, and their runs."""
    return listing.agg(
        F.count("*").alias("sources"),
        F.count_if(F.col("reason").isNull() & (F.col("runs") > 0)).alias("readable"),
        F.count_if(F.col("reason").isNotNull()).alias("unreadable"),
        F.count_if(F.col("reason").isNull() & (F.col("runs") == 0)).alias("empty"),
    )


def listing_order(listing: DataFrame) -> DataFrame:
    """Readable sources newest first, then empty ones, then unreadable ones."""
    rank = F.when(F.col("reason").isNotNull(), 2).when(F.col("runs") == 0, 1).otherwise(0)
    return listing.withColumn("class", rank).orderBy("class", F.desc_nulls_last("newest"), "source")


def runway(
    runs: DataFrame, tables: dict[str, tuple[DataFrame, Column, Column]], lane_of
) -> DataFrame:
    """The tables as lane events; sort by ``(started_at, id)`` for reading order.

    ``tables`` maps a name to (rows, raw lane, label); ``lane_of`` is P4.
    """
    parts = None
    for rows, lane, label in tables.values():
        start = F.col("started_at") if "started_at" in rows.columns else F.lit(None).cast("string")
        status = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
        if "event_kind" in rows.columns:
            status = F.coalesce(status, F.col("event_kind"))
        one = rows.select(
            F.col("id").cast("string").alias("id"),
            F.col("run_id"),
            lane_of(lane).alias("lane"),
            label.cast("string").alias("label"),
            status.alias("status"),
            F.coalesce(start, F.col("created_at")).alias("started_at"),
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def run_ordinal(runs: DataFrame, prefix: int = 16) -> DataFrame:
    """``#1`` for the first run of a group, and so on.

    Runs are cut by the first ``prefix`` characters of their start (16: a minute) and the counts of earlier cuts carried
    in, so a window holds one minute of one group; undated runs are cut by their creation instead.
    """
    day = F.struct(F.col("started_at").isNotNull().alias("dated"), F.coalesce(F.substring("started_at", 1, prefix), F.substring("created_at", 1, prefix), F.lit("")).alias("at"))
    cut = runs.withColumn("_day", day)
    per_day = cut.groupBy("run_group", "_day").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("run_group").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    base = per_day.select("run_group", "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("run_group", "_day").orderBy(
        F.asc_nulls_first("started_at"), F.asc_nulls_first("created_at"), F.asc_nulls_first("id")
    )
    return (
        cut.withColumn("_at", F.row_number().over(inside))
        .join(base, ["run_group", "_day"])
        .select("run_group", "id", (F.col("_base") + F.col("_at")).alias("ordinal"))
    )


def resolve_targets(rows: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``target_id`` by (run_id, label); NULL where there is no label or no such target.

    Rows without a label stay out of the join, so they are no hot key. Of targets with one label the smallest id counts.
    """
    known = targets.where("label IS NOT NULL").groupBy("run_id", F.col("label").alias("_label")).agg(F.min("id").alias("target_id"))
    named = rows.where(F.col(label).isNotNull()).withColumn("_label", F.col(label)).join(known, ["run_id", "_label"], "left").select(rows.columns + ["target_id"])
    bare = rows.where(F.col(label).isNull()).withColumn("target_id", F.lit(None).cast(known.schema["target_id"].dataType))
    return named.unionByName(bare)


def bundle_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """``run_id, list, n``: records per run and extracted list, repeats counted; a list that has none for a run gives no row."""
    parts = [df.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(name).alias("list"), "n") for name, df in lists.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
