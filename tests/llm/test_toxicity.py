import math
import random

import numpy as np
import pytest

from evidmill.llm.toxicity import Model, Scorer, features, fit, score, train

BAD = ["vorgul", "krexish", "zonktum"]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(2, 9))) for _ in range(rng.choice([1, 4, 30]))]
        toxic = rng.random() < 0.25
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(BAD)}{rng.choice(['', 'en', 'ish'])} w1"
        docs.append((i, ". ".join(sentences).capitalize() + ".", "clash"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus(900, 1)
    return fit(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out_documents_and_sentences(spark, fitted):
    docs, labels = corpus(600, 2)
    got = {r.doc_id: r for r in score(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), fitted).select("doc_id", "text", "toxicity.*").collect()}
    right = sum((got[i].score >= 0.7) == bool(y) for i, _, y in labels)
    assert right >= 594
    for i, _, y in labels:
        if y and got[i].score >= 0.7:
            worst = got[i].text[got[i].sentence_start : got[i].sentence_start + got[i].sentence_length].lower()
            assert any(b in worst for b in BAD)


def test_noisy_or_by_hand():
    model = Model({"bad": 3.0, "awfu*": 4.0}, -5.0)
    sigma = lambda z: 1 / (1 + math.exp(-z))
    got, start, length, worst = Scorer(model).score("All fine. A BAD one! Quite awfully bad\nEnd")
    want = 1 - (1 - sigma(-5)) ** 2 * (1 - sigma(-2)) * (1 - sigma(2))
    assert got == pytest.approx(want) and worst == pytest.approx(sigma(2))
    assert "All fine. A BAD one! Quite awfully bad\nEnd"[start : start + length].strip() == "Quite awfully bad"
    assert features("awfully") == ["awfully", "awfu*", "awful*", "awfull*"]


def test_training_lowers_the_loss():
    toxic, sentences = np.array([1, 1, 0, 0]), np.array([3, 2, 3, 1])
    hits = [[[0]], [[0, 1]], [[1]], []]
    weights, bias = train(toxic, sentences, hits, 2)
    assert weights[0] > 3 and weights[1] < 1 and bias < -1


def test_nulls_empty_and_long_texts(spark, fitted):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "...", 0), (None, "vorgul w1.", 0), (5, "w1. " * 40000, 0), (5, "w1. " * 40000, 0)], "doc_id long, text string, toxicity int")
    out = score(docs, fitted)
    got = out.select("doc_id", "toxicity.*").collect()
    assert out.columns == docs.columns and len(got) == 6
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1 and next(r.score for r in got if r.doc_id is None) > 0.7


def test_without_examples(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(empty, labels)
    assert score(empty, model).count() == 0
    one = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert score(one, model).select("toxicity.score").first()[0] == 0.0
    assert fit(one, spark.createDataFrame([(1, 1, 1), (1, 1, None), (None, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")).weights == {}
