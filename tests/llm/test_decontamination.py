import random
import re

import pytest

from evidmill.llm.decontamination import contamination, near_contamination

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPLIT.findall((text or "").translate(LOWER))


def windows(text, width):
    w = words(text)
    return [w[i : i + width] for i in range(max(len(w) - width + 1, 1))] if w else []


def brute(docs, items, width):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, body in items:
            for win in windows(body, width):
                for i in range(len(w) - len(win) + 1):
                    if w[i : i + len(win)] == win:
                        hit |= set(range(i, i + len(win)))
                        names.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(names), sorted(names), bool(hit)))
    return sorted(out, key=repr)


def brute_near(docs, items, width, slack):
    out = []
    for doc_id, text in docs:
        w = words(text)
        names = set()
        for item, body in items:
            for win in windows(body, width):
                span = len(win) + slack
                if any(set(win) <= set(w[i : i + span]) for i in range(len(w))):
                    names.add("" if item is None else str(item))
        if names:
            out.append((doc_id, sorted(names)))
    return sorted(out, key=repr)


def tables(rng, docs, names):
    vocabulary = [rng.choice(["É", "straße", "x1", "The", "a", "b'c"]) + str(k) for k in range(names)]
    say = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.randint(1, 9))) for k in range(12)] + [(None, say(4)), (3, say(5)), (20, None), (21, " !? "), (22, vocabulary[0])]
    rows = []
    for k in range(docs):
        text = say(rng.randint(0, 25))
        for _ in range(rng.randint(0, 2)):
            text += rng.choice([" ", "!", "_"]) + (rng.choice(items)[1] or "").swapcase().replace("é", "É") + " " + say(rng.randint(0, 4))
        rows.append((k, text))
    return rows + [(None, None), (None, rows[0][1]), (5, rows[5][1]), (6, ""), (7, " ... ")], items


@pytest.mark.parametrize("seed", [0, 2])
def test_phrases_like_brute_force(spark, seed):
    docs, items = tables(random.Random(seed), 60, [4, 12, 60][seed])
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), width=4)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 4)


@pytest.mark.parametrize("slack", [0, 3])
def test_proximity_like_brute_force(spark, slack):
    docs, items = tables(random.Random(slack + 7), 40, 12)
    got = near_contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), slack, width=4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_near(docs, items, 4, slack)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three", 5)], DOCS + ", pos int").selectExpr("*", "'x' AS name", "1 AS row")
    items = spark.createDataFrame([(1, "two three", 2)], ITEMS + ", window int")
    assert tuple(contamination(docs, items).first()) == (1, 3, 2, 1, ["1"], True)
    assert contamination(docs.limit(0), items).count() == 0
    assert tuple(contamination(docs, items.limit(0)).first()) == (1, 3, 0, 0, [], False)


def test_long_text_overlapping_windows(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    docs = [(1, "x " * 50_000 + passage + " y" * 10 + " " + passage.upper())]
    items = [(9, passage), (10, "q " + passage), (11, "p29 y")]
    got = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).first()
    assert tuple(got) == (1, 50_070, 61, 3, ["10", "11", "9"], True)
