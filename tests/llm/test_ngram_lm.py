import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from evidmill.llm import ngram_lm
from evidmill.llm.ngram_lm import BASE, DISCOUNT, SUM_BASE, LogFrequencyFilter, fit, level_of, score, score_corpus, tokens

SCHEMA = "doc_id long, text string"


class Local(ngram_lm.Reader):
    """A small model's filter, read here."""

    def __init__(self, model):
        self.shards, self.least, self.order = model.shards, model.least, model.order
        self.train_tokens, self.vocabulary = model.train_tokens, model.vocabulary
        self.filters = {r.shard: LogFrequencyFilter.of(r.size, r.words) for r in model.table.collect()}

    def _levels(self, keys, entries):
        out = np.zeros(len(keys), dtype=np.int64)
        for shard, at in ngram_lm.dealt(keys, self.shards):
            out[at] = self.filters[shard].levels(entries[at])
        return out

    def own(self, histories, grams):
        return self._levels(grams, ngram_lm.entry(ngram_lm.named(histories, grams)))

    def sums(self, histories):
        heads = histories >> ngram_lm.NAME_BITS
        return self._levels(heads << ngram_lm.NAME_BITS, heads ^ ngram_lm._FOLLOWERS)


def split(text):
    return [*(text or "").encode().lower().split(), "end"]


def corpus(seed, n):
    rng = random.Random(seed)
    follow = {f"w{i}": [f"w{rng.randrange(80)}" for _ in range(3)] for i in range(80)}
    rows = []
    for i in range(n):
        word, out = f"w{rng.randrange(80)}", []
        for _ in range(rng.choice([1, 5, 60])):
            out.append(word.upper() if rng.random() < 0.2 else word)
            word = rng.choice(follow[word])
        rows.append((i, " ".join(out)))
    return rows


def test_base_is_exact_and_model_beats_it(spark):
    # One chain for all: the texts held out follow the same words.
    rows = corpus(3, 500)
    train, rest = rows[:400], rows[400:] + [(900, None), (901, ""), (902, "neverseen w1"), (903, "w1 w2 " * 20000), (None, "w1"), (903, "w1 w2 " * 20000)]
    counts = Counter(t for _, text in train for t in split(text))
    n, v = sum(counts.values()), len(counts)
    got = sorted(map(tuple, score_corpus(spark, spark.createDataFrame(rest, SCHEMA), spark.createDataFrame(train, SCHEMA)).collect()), key=str)
    want = []
    for i, text in rest:
        words = split(text)
        want.append((i, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    want.sort(key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)
    # Three followers a word: far below one in eighty.
    assert sum(g[5] for g in got if g[0] and g[0] < 900) > 0.75 * sum(g[4] for g in got if g[0] and g[0] < 900)


def test_probabilities_sum_to_one(spark):
    from evidmill.llm.ngram_lm import log_probabilities

    rows = corpus(4, 300)
    model, exact = fit(spark.createDataFrame(rows, SCHEMA))
    model = Local(model)
    counts = {np.uint64(r.token & (2**64 - 1)): r.c for r in exact.collect()}
    for history in ("w1", "w1 w2", "w70"):
        past = tokens(history)[:-1]
        total = 0.0
        for w in counts:
            words = np.append(past, w)
            total += 10 ** log_probabilities(words, np.array([counts[x] for x in words]), np.array([len(words)]), model)[-1]
        unseen = np.append(past, np.uint64(12345))
        total += 10 ** log_probabilities(unseen, np.array([counts.get(x, 0) for x in unseen]), np.array([len(unseen)]), model)[-1]
        assert 0.9 < total < 1.0001, history


def test_filter_never_reads_less_and_seldom_more():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    counts = np.floor(2 * 1.5 ** rng.integers(0, 20, 20_000)).astype(np.int64)
    levels = level_of(counts, 2)
    assert np.all(2 * BASE ** (levels - 1.0) <= counts * 1.000001) and np.all(counts < 2 * BASE**levels * 1.000001)
    own = LogFrequencyFilter(int(levels.sum()))
    own.add(keys, levels)
    read = own.levels(keys)
    assert np.all(read >= levels) and (read > levels).mean() < 0.02
    assert (own.levels(rng.integers(0, 2**63, 20_000, dtype=np.uint64)) > 0).mean() < 0.02


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    names = np.unique(rng.integers(0, 2**64, 5_000, dtype=np.uint64))
    for part in (names, names[:1], names[:0]):
        assert np.array_equal(ngram_lm.unpacked_sorted(ngram_lm.packed_sorted(part)), part)
    counts = rng.integers(0, 2**32, 1_000)
    assert np.array_equal(ngram_lm.unpacked(ngram_lm.packed(counts, 4), 4), counts)


def by_hand(train, order=3):
    """The formula over dictionaries of exact counts, quantised as the docstring says."""
    grams = [Counter() for _ in range(order + 1)]
    for _, text in train:
        words = split(text)
        for n in range(1, order + 1):
            grams[n].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    total, kinds = sum(grams[1].values()), len(grams[1])
    read = lambda c: 2 * BASE ** (int(level_of(np.array(c), 2)) - 0.5) if c >= 2 else 0.0
    sums = Counter()
    for n in range(2, order + 1):
        for gram, c in grams[n].items():
            if c >= 2:
                sums[gram[:-1]] += read(c)

    def probability(gram):
        if len(gram) == 1:
            return (grams[1][gram] + 1) / (total + kinds + 1)
        lower, head = probability(gram[1:]), gram[:-1]
        have = grams[1][head] if len(head) == 1 else (read(grams[len(head)][head]) if sums.get(head[:-1]) else 0.0)
        if have < 2 or not sums.get(head):
            return lower
        mass = 2 * SUM_BASE ** int(level_of(np.array(math.ceil(sums[head] * 64) / 64), 2, SUM_BASE))
        whole = max(have, mass)
        return DISCOUNT * min(read(grams[len(gram)][gram]), mass) / whole + (1 - DISCOUNT * mass / whole) * lower

    def scored(text):
        words = split(text)
        return sum(math.log10(probability(tuple(words[max(0, i - order + 1) : i + 1]))) for i in range(len(words)))

    return scored


class Exact(ngram_lm.Reader):
    """Levels without a filter."""

    def __init__(self, train, order=3):
        texts = [tokens(text) for _, text in train]
        self.tokens = Counter(int(w) for t in texts for w in t)
        self.least, self.order, self.train_tokens, self.vocabulary = 2, order, sum(self.tokens.values()), len(self.tokens)
        self.levels, heads, sums = {}, {}, Counter()
        for grams, histories in ngram_lm.text_grams(texts, order):
            for gram, c in Counter(grams.tolist()).items():
                self.levels[gram] = int(level_of(np.array(c), 2)) if c >= 2 else 0
            heads.update(zip(grams.tolist(), histories.tolist()))
        for gram, head in heads.items():
            if self.levels[gram]:
                sums[head] += 2 * BASE ** (self.levels[gram] - 0.5)
        self.heads = {head: int(level_of(np.array(math.ceil(q * 64) / 64), 2, SUM_BASE)) for head, q in sums.items()}

    def own(self, histories, grams):
        return np.array([self.levels.get(g, 0) for g in grams.tolist()], dtype=np.int64)

    def sums(self, histories):
        return np.array([self.heads.get(h, 0) for h in histories.tolist()], dtype=np.int64)


def test_formula_over_exact_levels():
    rows = corpus(8, 400)
    scored, exact = by_hand(rows[:300]), Exact(rows[:300])
    for _, text in rows:
        words = tokens(text)
        got = ngram_lm.log_probabilities(words, np.array([exact.tokens[int(w)] for w in words]), np.array([len(words)]), exact).sum()
        assert got == pytest.approx(scored(text), rel=1e-9)


@pytest.mark.parametrize("shard_grams", [500, 2_000_000])
def test_scores_like_the_formula(spark, monkeypatch, shard_grams):
    monkeypatch.setattr(ngram_lm, "SHARD_GRAMS", shard_grams)
    rows = corpus(8, 400)
    train, scored = rows[:300], by_hand(rows[:300])
    got = {r.doc_id: r.score for r in score_corpus(spark, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(train, SCHEMA)).collect()}
    want = {i: scored(text) for i, text in rows}
    # The filter now and then holds what was never entered, or a level too many: below one in a hundred, and a long text asks some 200 times.
    assert sum(abs(got[i] - want[i]) < 1e-6 for i, text in rows if len(text.split()) <= 5) > 0.9 * sum(len(text.split()) <= 5 for _, text in rows)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.005)


def test_equal_rows_without_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 20_000)
    docs = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a b c d e' AS text")
    model, exact = fit(docs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = score(docs, model, exact).withColumn("part", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 20_000 and out["score"].nunique() == 1 and out.groupby("part").size().max() < 12_000


def test_ngrams_count_alike_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_GRAMS", 3_000_000)  # several shards
    text = "never heard pair " * 3
    many = spark.range(400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 10000), k -> 'x' || ((id * 10000 + k) * 7919 % 99991)), ' ') AS text")
    few = many.where("doc_id < 4")
    for rest in (few, many):
        model, exact = fit(rest.union(spark.createDataFrame([(-1, text)], SCHEMA)))
        words = tokens("never heard pair")[:-1]
        pair, triple = ngram_lm.extended(words[:1], words[1:2]), ngram_lm.extended(ngram_lm.extended(words[:1], words[1:2]), words[2:])
        assert model.least == 2
        # Three occurrences are at level 2, however much else there is.
        local = Local(model)
        assert local.own(np.concatenate((words[:1], pair)), np.concatenate((pair, triple))).tolist() == [2, 2]
        assert local.sums(pair)[0] >= 1
    assert model.shards > 1 and len(local.filters) == model.shards
    # What the blocks get from the shards is what the model itself says.
    got = score(spark.createDataFrame([(1, text)], SCHEMA), model, exact).first()
    words = tokens(text)
    counts = {r.token & (2**64 - 1): r.c for r in exact.where(exact.token.isin(words.view(np.int64).tolist())).collect()}
    want = ngram_lm.log_probabilities(words, np.array([counts[int(w)] for w in words]), np.array([len(words)]), local).sum()
    assert got.score == pytest.approx(want, rel=1e-9) and got.score > got.base_score


def test_ids_beside_rows_without_one_keep_every_digit(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a b a b"), (None, None), (-(2**62) - 1, "")], SCHEMA).coalesce(1)
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in score_corpus(spark, docs, docs).collect()}
    assert got == {2**60 + 1: (5, 5), None: (1, 1), -(2**62) - 1: (1, 1)}


def test_texts_hashed_together_have_their_own_tokens():
    texts = ["A b  C", "", None, "x\ty \u00e9\xa0z ", "\u00ff \u00fe", "\n", "long " * 100_000, "a"]
    words, sizes = (np.concatenate(x) for x in zip(*ngram_lm.token_runs(texts)))
    want = [tokens(t) for t in texts]
    assert sizes.tolist() == [len(t) for t in want] and np.array_equal(words, np.concatenate(want))


def test_a_block_asks_in_ranges_and_in_little_memory():
    rng = np.random.default_rng(5)
    words, sizes = rng.integers(0, 2**64, 400_000, dtype=np.uint64)[rng.zipf(1.3, 400_000) % 400_000], np.full(1_000, 400)
    whole = ngram_lm.block_asks(words, sizes, 3, 64, 0, 64)
    tracemalloc.start()
    try:
        parts = [ngram_lm.block_asks(words, sizes, 3, 64, low, low + 32) for low in (0, 32)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(np.array_equal(np.concatenate([part[k] for part in parts]), whole[k]) for k in (0, 1))
    pairs = list(ngram_lm.run_grams(words, sizes, 3))
    assert np.array_equal(whole[0], np.unique(np.concatenate([ngram_lm.located(histories, grams, 64) for grams, histories in pairs])))
    assert np.array_equal(whole[1], np.unique(np.concatenate([histories for _, histories in pairs]) >> ngram_lm.NAME_BITS))
    # Longs a token.
    assert peak < 11 * 8 * len(words)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert score_corpus(spark, empty, empty).count() == 0
    one = score_corpus(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score) == (3, 0, 0, 0.0)
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, c int, token int")
    model, exact = fit(docs)
    assert score(docs, model, exact).first().n_known == 3
