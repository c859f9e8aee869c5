"""First write wins over many batches, after lost batches too, without reading the table."""

import random

import pytest
from pyspark.sql import functions as F

from evidmill.sources import key_index, spine
from evidmill.sources.key_index import KeyIndex


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    """Small data needs few files."""
    monkeypatch.setattr(key_index, "BUCKETS", 4)


def load(spark, root, rows):
    return spine.upsert(spark.createDataFrame(rows, "stable_key string, id string, status string, created_at string"), root, "runs")


def stored(spark, root):
    return sorted((r.stable_key, r.id) for r in spine.open_or_reason(spark, root)[0]["runs"].collect())


def test_batches_equal_a_plain_first_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "COMPACT", 3)
    root, rng, want = str(tmp_path / "spine"), random.Random(3), {}
    spine.create(spark, root)
    for batch in range(3):
        rows = [(f"k{rng.randrange(60)}", f"{batch}-{n:03}", "ok", "t") for n in range(30)]
        load(spark, root, rows)
        for key, name, *_ in sorted(rows, key=lambda r: r[1]):
            want.setdefault(key, name)
        load(spark, root, rows[:3])
        assert stored(spark, root) == sorted(want.items())


def test_new_keys_read_no_keys_and_replays_only_their_buckets(spark, tmp_path):
    root = str(tmp_path / "spine")
    spine.create(spark, root)
    load(spark, root, [(f"a{k}", str(k), "ok", "t") for k in range(3000)])
    new = load(spark, root, [(f"b{k}", str(k), "ok", "t") for k in range(300)])
    assert new.asked < 15 and len(stored(spark, root)) == 3300
    again = load(spark, root, [("a7", "x", "ok", "t")])
    assert again.asked == 1 and len(again.buckets) == 1 and len(stored(spark, root)) == 3300


def test_a_lost_batch_is_found_by_the_log(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "spine")
    spine.create(spark, root)
    load(spark, root, [("k1", "1", "ok", "t")])
    extend = KeyIndex._extend
    monkeypatch.setattr(KeyIndex, "_extend", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        load(spark, root, [("k2", "2", "ok", "t")])
    monkeypatch.setattr(KeyIndex, "_extend", extend)
    load(spark, root, [("k2", "3", "ok", "t"), ("k3", "4", "ok", "t")])
    assert stored(spark, root) == [("k1", "1"), ("k2", "2"), ("k3", "4")]


def test_filters_grow_and_lose_no_key():
    import numpy as np
    import pandas as pd

    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 30_000)
    none = pd.DataFrame(columns=["bucket", "slice", "room", "held", "bits"])
    filters = none
    for k in range(0, 30_000, 5_000):
        filters = key_index._grow((3,), pd.DataFrame({"h": hashes[k : k + 5_000]}), filters)
    assert filters["held"].sum() == 30_000 and (filters["held"] <= filters["room"]).all() and len(filters) <= 4
    assert len(key_index._probe((3,), pd.DataFrame({"h": hashes}), filters)) == 30_000
    others = np.random.default_rng(2).integers(-(2**63), 2**63, 30_000)
    assert len(key_index._probe((3,), pd.DataFrame({"h": others}), filters)) < 1_500
