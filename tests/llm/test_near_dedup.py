import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidmill.llm.common import components, word_hashes
from evidmill.llm.near_dedup import near_dedup, shingle_set


def words_of(text):
    return (text or "").encode().lower().split()


def brute(rows, width, percent):
    """Components from all pairs of exact sets."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" for i in range(400)] + [f"t{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 5, 12])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 30, 90, 300]))]
            if kind > 0.75:
                words += passage
        texts.append(words)
        rows.append((i * 3 % n if n % 3 else i, rng.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("width,percent,sketch", [(4, 80, 64), (5, 80, 64), (2, 90, 64)])
def test_like_all_pairs(spark, width, percent, sketch):
    rows = corpus(width, 260) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two")]
    docs = spark.createDataFrame([(i, t, i, 0) for i, t in rows], "doc_id long, text string, node long, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs, width, percent, sketch).collect()}
    assert got == brute(rows, width, percent)
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup(docs, 4)
    assert out.where("component_id = 0").count() == 400 and out.where("kept").count() == 1


def test_repeated_rows_null_ids_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, t), (5, t), (2, t), (None, t), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup(docs).collect()), key=str)
    assert got == sorted([(5, 2, False), (5, 2, False), (2, 2, True), (None, None, True), (None, None, True)], key=str)
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_follow_words():
    text = "Aa b\tccc Aa\x0bé aA\x1cx  z " * 3
    words = text.encode().lower().split()
    hashes = word_hashes(text.encode().lower())
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
    assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    assert len(shingle_set("a b c", 4)) == 1 and len(shingle_set(None, 4)) == 0 and len(np.intersect1d(shingle_set("a b", 4), shingle_set("b a", 4))) == 0


def test_components_of_chain_star_and_cycle(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
