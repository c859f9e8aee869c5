"""Toxicity by multiple-instance learning: sentences are scored, and noisy-or makes the document's score.

Only documents carry labels. A sentence is toxic with the probability of a logistic model over its words and their
beginnings; a document is toxic if any sentence is: ``1 - prod(1 - p)``. The gradient of that likelihood puts the blame on
the sentences that explain the label, which then also locate the offence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidmill.llm.common import prepare

# The bound of the fit: at most so many labelled documents of each label take part, in order of a hash of the id.
SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000

# A word or beginning takes part if its likelihood-ratio statistic is at least this; the strongest this many.
LEAST_EVIDENCE = 25.0
MOST_FEATURES = 5_000

THRESHOLD = 0.7
RESULT = "score double, sentence_start long, sentence_length long, sentence_score double"

_SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")
_WORD = re.compile(r"\w+")
_BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return [word, *[word[:n] + "*" for n in _BEGINNINGS if len(word) > n]]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic`` of the bounded sample. Repeated labels of a document count as toxic if one is."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = ["_order", "doc_id"]
    marks = marks.withColumn("_order", F.xxhash64("doc_id"))
    some = marks.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).union(marks.where("toxic <> 1").orderBy(*order).limit(SAMPLE_CLEAN))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id", "toxic")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled ``docs``; without toxic and clean examples the score is the same for all.

    Words are counted and chosen on the executors. To the driver come the chosen words and, of each sampled document, the
    number of its sentences and the chosen words of the sentences that have some.
    """
    prepare(docs.sparkSession)
    sample = labelled(docs, labels)

    def tally(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[int(toxic == 1)].update({f for w in set(_WORD.findall((text or "").lower())) for f in features(w)})
                seen[int(toxic == 1)][""] += 1  # documents
        names = sorted(seen[0].keys() | seen[1].keys())
        yield pd.DataFrame({"feature": pd.Series(names, dtype=object), "clean": [seen[0][n] for n in names], "toxic": [seen[1][n] for n in names]})

    counts = sample.mapInPandas(tally, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Features of a handful of documents can't reach the least evidence.
    found = counts.where("toxic >= 5 OR feature = ''").toPandas()
    totals = found[found["feature"] == ""]
    if totals.empty or int(totals["toxic"].iloc[0]) == 0 or int(totals["clean"].iloc[0]) == 0:
        return Model({}, -math.inf)
    n1, n0 = int(totals["toxic"].iloc[0]), int(totals["clean"].iloc[0])
    chosen = []
    for feature, c0, c1 in found[found["feature"] != ""].itertuples(index=False):
        if c1 * n0 > c0 * n1 and (evidence := _evidence(c1, n1, c0, n0)) >= LEAST_EVIDENCE:
            chosen.append((-evidence, feature))
    names = [f for _, f in sorted(chosen)[:MOST_FEATURES]]
    index = {f: k for k, f in enumerate(names)}

    def instances(batches):
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"]):
                sentences = [m.group().lower() for m in _SENTENCE.finditer(text or "")]
                hits = [h for s in sentences if (h := sorted({index[f] for w in _WORD.findall(s) for f in features(w) if f in index}))]
                rows.append((int(toxic == 1), len(sentences), " ".join(",".join(map(str, h)) for h in hits)))
            yield pd.DataFrame(rows, columns=["toxic", "sentences", "hits"])

    bags = sample.mapInPandas(instances, "toxic int, sentences long, hits string").toPandas()
    weights, bias = train(bags["toxic"].to_numpy(), bags["sentences"].to_numpy(),
                          [[[int(k) for k in s.split(",")] for s in h.split(" ") if s] for h in bags["hits"]], len(names))
    return Model(dict(zip(names, map(float, weights))), float(bias))


def _evidence(c1: int, n1: int, c0: int, n0: int) -> float:
    """The likelihood-ratio statistic of a feature's documents against the labels."""
    def part(a, total, share):
        return a * math.log(a / (total * share)) if a else 0.0

    share = (c1 + c0) / (n1 + n0)
    return 2 * (part(c1, n1, share) + part(c0, n0, share) + part(n1 - c1, n1, 1 - share) + part(n0 - c0, n0, 1 - share))


def train(toxic: np.ndarray, sentences: np.ndarray, hits: list[list[list[int]]], size: int, rounds: int = 400, rate: float = 0.1, ridge: float = 0.002) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with running scales (Adam) on the noisy-or likelihood."""
    owner = np.array([d for d, bag in enumerate(hits) for _ in bag], dtype=np.int64)
    row = np.array([k for k, s in enumerate(s for bag in hits for s in bag) for _ in s], dtype=np.int64)
    column = np.array([f for bag in hits for s in bag for f in s], dtype=np.int64)
    plain = np.maximum(sentences, 1) - np.bincount(owner, minlength=len(toxic))  # sentences without a chosen word
    y = toxic.astype(bool)
    theta, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = -6.0
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=theta[column], minlength=len(owner)) + theta[-1]
        p, p0 = _sigmoid(z), _sigmoid(theta[-1])
        # log of the probability that no sentence is toxic
        none = plain * np.log1p(-p0) + np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(toxic))
        quiet = np.exp(none)
        blame = np.where(y, -quiet / np.maximum(1 - quiet, 1e-9), 1.0)  # times p: gradient by a sentence's z
        slope = np.bincount(column, weights=(blame[owner] * p)[row], minlength=size) if size else np.empty(0)
        gradient = np.append(slope, (blame * plain * p0).sum() + (blame[owner] * p).sum()) / len(toxic)
        gradient[:-1] += ridge * theta[:-1] / max(size, 1)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.maximum(theta[:-1], 0.0)  # words only add evidence
    return theta[:-1], theta[-1]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Scorer:
    """Scores texts with a model; remembers the weights of words."""

    MOST_WORDS = 150_000

    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.plain = _sigmoid(model.bias) if model.bias > -math.inf else 0.0

    def weights(self, words) -> dict[str, list[str]]:
        """The chosen features of those words that have some."""
        if len(self.cache) > self.MOST_WORDS:
            self.cache.clear()
        out, cache, known = {}, self.cache, self.model.weights
        for w in words:
            found = cache.get(w)
            if found is None:
                found = cache[w] = tuple(f for f in features(w) if known.get(f))
            if found:
                out[w] = found
        return out

    def sentences(self, text: str | None):
        """``start, length, probability`` of the sentences that hold a chosen word."""
        chosen = self.weights(set(_WORD.findall((text or "").lower())))
        if not chosen:
            return
        for m in _SENTENCE.finditer(text):
            there = {f for w in _WORD.findall(m.group().lower()) if w in chosen for f in chosen[w]}
            if there:
                yield m.start(), m.end() - m.start(), float(_sigmoid(self.model.bias + sum(self.model.weights[f] for f in sorted(there))))

    def score(self, text: str | None) -> tuple[float, int, int, float]:
        """Document score, and start, length and score of the worst sentence (0, 0 and the base where none stands out)."""
        found = list(self.sentences(text))
        plain = max(len(_SENTENCE.findall(text)) if text else 0, 1) - len(found)
        quiet = (1 - self.plain) ** max(plain, 0)
        for _, _, p in found:
            quiet *= 1 - p
        worst = max(found, key=lambda f: (f[2], -f[0]), default=(0, 0, self.plain))
        return float(1 - quiet), worst[0], worst[1], float(worst[2])


_READY: list = []


def scorer(spark: SparkSession, model: Model):
    """A column function ``text -> struct(score, sentence_start, sentence_length, sentence_score)``."""
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)  # at most MOST_FEATURES words

    @F.pandas_udf(RESULT)
    def score(texts: pd.Series) -> pd.DataFrame:
        if not _READY or _READY[0].model is not sent.value:
            _READY[:] = [Scorer(sent.value)]
        return pd.DataFrame([_READY[0].score(t) for t in texts], columns=["score", "sentence_start", "sentence_length", "sentence_score"])

    return score


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column of the document's score and its worst sentence; null and empty texts have one plain sentence.

    All columns and rows of ``docs`` stay; one of the name ``into`` is replaced. Spans count code points.
    """
    return docs.withColumn(into, scorer(docs.sparkSession, model)(F.col(text)))
