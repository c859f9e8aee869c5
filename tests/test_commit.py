"""Retention applied to a stored dataset: all twelve tables change together or not at all."""

import pytest
from pyspark.sql import functions as F

from evidmill.operators import retention
from evidmill.sources import key_index, spine


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small data needs few files."""
    monkeypatch.setattr(key_index, "BUCKETS", 4)


@pytest.fixture
def dataset(spark, tmp_path):
    root = str(tmp_path / "spine")
    spine.create(spark, root)
    runs = spark.createDataFrame([(f"r{k}", f"r{k}", f"g{k % 2}", "ok", f"t{k}") for k in range(6)], "stable_key string, id string, run_group string, status string, created_at string")
    spine.upsert(runs, root, "runs")
    for table in spine.SCHEMAS:
        if table != "runs":
            rows = runs.select(F.concat(F.lit(f"{table}-"), "id").alias("stable_key"), F.col("id").alias("run_id"), "created_at")
            spine.conform(rows, table).write.mode("append").parquet(f"{root}/{table}")
    return root


def counts(spark, root):
    tables, reason = spine.open_or_reason(spark, root)
    assert reason is None
    return {name: df.count() for name, df in tables.items()}


def test_all_tables_lose_the_group_and_go_on(spark, dataset):
    plan = spark.createDataFrame([("g0", "delete"), ("g1", "keep")], "run_group string, disposition string")
    retention.apply_to_dataset(spark, dataset, plan)
    assert counts(spark, dataset) == {name: 3 for name in spine.SCHEMAS}
    # The next batch goes to the new generation, and a deleted key may come again.
    spine.upsert(spark.createDataFrame([("r0", "r0", "g9", "ok", "t9"), ("r1", "x", "g9", "ok", "t9")], "stable_key string, id string, run_group string, status string, created_at string"), dataset, "runs")
    left = {r.id: r.run_group for r in spine.open_or_reason(spark, dataset)[0]["runs"].collect()}
    assert left == {"r0": "g9", "r1": "g1", "r3": "g1", "r5": "g1"}


def test_a_stop_between_tables_leaves_the_old_ones(spark, dataset, monkeypatch):
    before, real, seen = counts(spark, dataset), spine.conform, []

    def stops(df, table):
        seen.append(table)
        if len(seen) == 7:
            raise RuntimeError("stopped")
        return real(df, table)

    monkeypatch.setattr(spine, "conform", stops)
    plan = spark.createDataFrame([("g0", "delete")], "run_group string, disposition string")
    with pytest.raises(RuntimeError):
        retention.apply_to_dataset(spark, dataset, plan)
    monkeypatch.setattr(spine, "conform", real)
    assert counts(spark, dataset) == before
    retention.apply_to_dataset(spark, dataset, plan)
    assert set(counts(spark, dataset).values()) == {3}


def test_an_incomplete_set_of_tables_is_refused(spark, dataset):
    tables, _ = spine.open_or_reason(spark, dataset)
    with pytest.raises(ValueError):
        spine.commit_tables(spark, dataset, {k: v for k, v in tables.items() if k != "actions"})
