import itertools
import random
import re

import pytest

from evidmill.llm.chat import INSERT, MERGE, NAME_UNKNOWN, RELABEL, format_turns, repair, role_of

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(roles):
    """Least cost over all labellings, with the automaton written as a pattern."""
    best = float("inf")
    for labels in itertools.product("sua", repeat=len(roles)):
        cost = sum(0 if (role_of(r) or " ")[0] == q else RELABEL if role_of(r) else NAME_UNKNOWN for r, q in zip(roles, labels))
        # Between two turns: nothing, or an empty turn that makes the sequence legal; equal neighbours may merge.
        options = [("", 0.0)]
        for k, q in enumerate(labels):
            grown = []
            for word, c in options:
                if word.endswith(q):
                    grown.append((word, c + MERGE))
                grown += [(word + q, c), (word + "u" + q, c + INSERT), (word + "a" + q, c + INSERT)]
            options = [(w, c) for w, c in grown if re.fullmatch(r"s?(ua)*u?", w)]
        best = min([best, *[cost + c for _, c in options]])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_cost_like_brute_force(seed):
    rng = random.Random(seed)
    roles = [rng.choice(["user", "assistant", "system", None, "Human", "tool"]) for _ in range(rng.randint(1, 5))]
    assert sum(r[3] for r in repair(roles, ["t"] * len(roles))) == pytest.approx(cheapest(roles))


def rendered(rows):
    return "".join(r.chunk for r in sorted(rows, key=lambda r: (r.turn is None, r.turn or 0, r.role or "", r.chunk)))


def legal(text):
    roles = re.findall(r"<\|im_start\|>(\w+)\n", text)
    return re.fullmatch(r"(system )?(user assistant )*(user )?", "".join(r + " " for r in roles)) and text.count("<|im_end|>\n") == len(roles)


@pytest.mark.parametrize("segment", [2, 3, 512])
def test_segments_give_the_same_cost(spark, segment, monkeypatch):
    import evidmill.llm.chat as chat

    monkeypatch.setattr(chat, "SEGMENT", 3)
    rng = random.Random(segment)
    rows, want = [], {}
    for conv in range(30):
        n = rng.choice([1, 2, 9, 40])
        roles = [rng.choice(["user", "assistant", "user", "assistant", "system", None]) for _ in range(n)]
        want[conv] = sum(r[3] for r in repair(roles, [""] * n))
        rows += [(conv, t, r, f"c{conv} t{t} <|im_end|>") for t, r in enumerate(roles)]
    rng.shuffle(rows)
    got = {}
    for r in format_turns(spark.createDataFrame(rows, SCHEMA), segment).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for conv, turns in got.items():
        assert sum(t.cost for t in turns) == pytest.approx(want[conv])
        text = rendered(turns)
        assert legal(text) and re.findall(r"t\d+ <", text) == [f"t{k} <" for k in range(len(turns))]


def test_nulls_ties_clashing_columns_and_empty_table(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, None, "assistant", "z", "x"), (2, None, "user", "last", "x"), (2, 5, "system", "s" * 100_000, "x")]
    out = format_turns(spark.createDataFrame(rows, SCHEMA + ", chunk string"))
    got = out.collect()
    assert len(got) == 6 and out.columns == ["conv_id", "turn", "role", "repaired_role", "action", "inserted", "cost", "chunk"]
    for conv in (1, 2, None):
        assert legal(rendered([r for r in got if r.conv_id == conv]))
    lone = next(r for r in got if r.conv_id is None)
    assert (lone.repaired_role, lone.action, lone.inserted) == ("assistant", "insert", 1)
    assert format_turns(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("row", [("CAST(NULL AS BIGINT) AS conv_id", "id % 20 AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text"),
                                 ("7L AS conv_id", "CAST(NULL AS BIGINT) AS turn", "'user' AS role", "'same' AS text")])
def test_rows_without_own_ids_are_spread(spark, row):
    from pyspark.sql import functions as F

    few = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], SCHEMA)
    turns = spark.range(40_000).selectExpr(*row)
    # Small neighbouring partitions would be read by one task.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = format_turns(turns.unionByName(few)).withColumn("part", F.spark_partition_id())
        out = out.select("conv_id", "turn", "repaired_role", "cost", "part").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 40_002 and out.groupby("part").size().max() < 25_000
    data = sorted(((r.turn, r.role, r.text) for r in turns.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    assert out["cost"].sum() == pytest.approx(sum(r[3] for r in repair([r for _, r, _ in data], [t for _, _, t in data])))


def test_rendering_by_hand():
    chunks = [r[4] for r in repair(["system", "user", "user", "assistant"], ["s", "a", "b", None])]
    assert "".join(chunks) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na\n\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
