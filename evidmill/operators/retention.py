"""Retention: which run groups to delete, guards, plan and apply (K family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidmill.operators.grouping import per_group
from evidmill.operators.rollup import newest_groups
from evidmill.session import broadcast_if_small
from evidmill.sources import spine


def check_selection(keep_last: int | None = None, keep_days: int | None = None, run_groups: list | None = None) -> str:
    """K4: exactly one mode with a legal value; returns the mode."""
    modes = [n for n, v in (("keep_last", keep_last), ("keep_days", keep_days), ("run_groups", run_groups or None)) if v is not None]
    if len(modes) != 1:
        raise ValueError("choose exactly one of keep_last, keep_days, run_groups")
    if keep_last is not None and keep_last < 1:
        raise ValueError("keep_last must be at least 1")
    if keep_days is not None and keep_days < 0:
        raise ValueError("keep_days must not be negative")
    return modes[0]


def keep_last(index: DataFrame, n: int) -> DataFrame:
    """K1: the newest ``n`` groups stay, other dated groups go, undated ones are never selected.

    The newest groups come from a top-n plan and are matched by name, so no global
    ranking of all groups is needed.
    """
    newest = newest_groups(index.where("last_started_at IS NOT NULL"), n).select(
        F.col("run_group").alias("_group"), F.lit(True).alias("newest"))
    joined = index.join(broadcast_if_small(newest), F.col("run_group").eqNullSafe(F.col("_group")), "left").drop("_group")
    state = F.when(F.col("last_started_at").isNull(), "unknown").when(F.col("newest"), "keep").otherwise("delete")
    return joined.withColumn("disposition", state).drop("newest")


def keep_days(index: DataFrame, days: int, now: Column) -> DataFrame:
    """K2: groups whose newest run is older than ``days`` go; unreadable starts are unknown."""
    start = F.try_to_timestamp(F.col("last_started_at"))
    cutoff = now - F.make_dt_interval(F.lit(days))
    return index.withColumn("disposition", F.when(start.isNull(), "unknown").when(start < cutoff, "delete").otherwise("keep"))


def named(index: DataFrame, names: DataFrame) -> DataFrame:
    """Exactly the named groups go, even undated ones."""
    marked = names.select("run_group").distinct().withColumn("named", F.lit(True))
    return index.join(marked, "run_group", "left").withColumn(
        "disposition", F.when(F.col("named"), "delete").otherwise("keep")).drop("named")


def missing_names(index: DataFrame, names: DataFrame) -> DataFrame:
    """K3: named groups that are not there; the caller refuses when any is returned."""
    return names.select("run_group").distinct().join(index.select("run_group"), "run_group", "left_anti")


def would_empty(plan: DataFrame) -> DataFrame:
    """K4: one row that says whether nothing would remain."""
    return plan.agg(
        ((F.count_if(F.col("disposition") == "delete") > 0) & (F.count_if(F.col("disposition") != "delete") == 0)).alias("would_empty"))


def outside_root(plan: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """K4: groups to delete that refer to an absolute path outside ``root``. ``paths``: run_group, path."""
    base = root.rstrip("/")
    inside = (F.col("path") == base) | F.col("path").startswith(base + "/")
    stray = paths.where(F.col("path").startswith("/") & (~inside | F.col("path").rlike(r"(^|/)\.\.(/|$)")))
    bad = stray.groupBy("run_group").agg(F.count("*").alias("stray_paths"))
    return plan.where("disposition = 'delete'").select("run_group").join(bad, "run_group")


def survivors(table: DataFrame, doomed_runs: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows that stay when the runs of deleted groups go."""
    return table.join(doomed_runs.select(F.col("id").alias(key)), key, "left_anti")


def apply_plan(plan: DataFrame, runs: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """K5: every table without the deleted groups; nothing is written here."""
    doomed = runs.join(plan.where("disposition = 'delete'").select("run_group"), "run_group", "left_semi").select("id")
    return {"runs": survivors(runs, doomed, "id"), **{n: survivors(t, doomed) for n, t in tables.items()}}


def apply_to_dataset(spark: SparkSession, root: str, plan: DataFrame) -> str:
    """K5: the dataset at ``root`` without the deleted groups, all twelve tables in one step (``spine.commit_tables``)."""
    tables, reason = spine.open_or_reason(spark, root)
    if tables is None:
        raise ValueError(f"no dataset to apply the plan to: {reason}")
    left = apply_plan(plan, tables["runs"], {n: t for n, t in tables.items() if n != "runs"})
    return spine.commit_tables(spark, root, left)


def report(plan: DataFrame, runs: DataFrame, tables: dict[str, DataFrame], dirs: DataFrame | None = None) -> DataFrame:
    """Per group disposition, rows to go per table, files and bytes.

    ``dirs``: run_group, files, bytes per run folder.
    """
    out = plan
    for name, child in tables.items():
        counts = per_group(runs, child, {name: ("sum", F.lit(1))})
        out = out.join(counts, "run_group", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    total = reduce(lambda a, b: a + b, [F.col("run_count"), *[F.col(n) for n in tables]])
    out = out.withColumn("rows", total)
    if dirs is None:
        return out.withColumns({"files": F.lit(0), "bytes": F.lit(0)})
    sizes = dirs.groupBy("run_group").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    return out.join(sizes, "run_group", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("files", "bytes")})


def totals(reported: DataFrame) -> DataFrame:
    """K5: totals per disposition."""
    return reported.groupBy("disposition").agg(
        F.count("*").alias("groups"), F.sum("run_count").alias("runs"), F.sum("rows").alias("rows"),
        F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
