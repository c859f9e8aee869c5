import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from evidmill.llm.spotsigs import ANCHORS, edited_likeness, near_pairs, signatures


def spots(text, chain=2):
    """The same sets as tuples of words."""
    text = text or ""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [(k, w) for k, w in enumerate(words) if w not in ANCHORS]
    out = set()
    for j in range(-1, len(content)):
        last = content[j][0] if j >= 0 else -1
        end = content[j + 1][0] if j + 1 < len(content) else len(words)
        if end - last > 1 and j + chain < len(content):
            out.add((words[end - 1], *[w for _, w in content[j + 1 : j + 1 + chain]]))
    if not out:
        units = [w for _, w in content]
        if words and words[0] in ANCHORS:
            units = ["", *units]
        out = {tuple(units[j : j + chain + 1]) for j in range(len(units) - chain)}
    if not out and text:
        out = {("all", " ".join(words))} if words else {("raw", text)}
    return out


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def corpus(seed, n):
    rng = random.Random(seed)
    base = [f"wort{k}" for k in range(60)] + ["é1x", "Üb"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 1, 3])):
                words[rng.randrange(len(words))] = rng.choice(base)
        else:
            words = [rng.choice(ANCHORS).capitalize() if rng.random() < 0.4 else rng.choice(base) for _ in range(rng.choice([1, 2, 3, 7, 40, 120]))]
        rows.append((i * 7, " ".join(words)))
    return rows


@pytest.mark.parametrize("bits", [3, 11])
def test_like_brute_force(spark, bits):
    rows = corpus(1, 150) + [(5000, None), (5001, ""), (5002, "%%% ***"), (5003, "the of"), (5004, "one"), (-3, "The last of all is here, and stays."), (9000, "the pot boils over " * 9000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, sigs string, n_chars int")
    got = {r.doc_id: r for r in edited_likeness(docs, bits=bits).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(jaccard(spots(text), spots(edited))), (i, text[:80], edited[:80])
        assert got[i].near_next == pytest.approx(jaccard(spots(text), spots(after)))
        assert got[i].n_signatures == len(spots(text))
    by_set = {}
    for i, text in rows:
        by_set.setdefault(got[i].fingerprint, set()).add(frozenset(spots(text)))
    assert all(len(v) == 1 for v in by_set.values()) and len(by_set) == len({frozenset(spots(t)) for _, t in rows})


def test_pairs_like_brute_force(spark):
    rows = corpus(2, 160)
    pairs, members = near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), 60)
    group = {r.doc_id: r.representative for r in members.collect()}
    got = {(r.a, r.b): r.likeness for r in pairs.collect()}
    sets = {i: spots(t) for i, t in rows}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x != y and x and y and 100 * len(x & y) >= 60 * len(x | y):
                want[tuple(sorted((group[a], group[b])))] = jaccard(x, y)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    assert all(sets[i] == sets[r] for i, r in group.items())


def test_ties_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z z z"), (1, "a")], "doc_id long, text string")
    got = edited_likeness(docs).collect()
    assert len(got) == 4 and {r.doc_id for r in got} == {1, None}
    one = edited_likeness(docs.where("doc_id IS NULL")).first()
    assert one.near_next == 1.0
    assert edited_likeness(docs.limit(0)).count() == 0
    assert docs.select(F.size(signatures(F.lit(None).cast("string"))).alias("n")).first().n == 0
