import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from evidmill.llm.runs import collapse, looped, report, runs, text_runs
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def brute(words):
    """Every stretch of equal words q apart, extended as far as it goes, for every q."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(words[i : i + size - r] == words[i + r : i + size] for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out)


def looping(rng, n, names):
    words = [rng.randrange(names) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // (3 + rng.randrange(8))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_like_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        words = looping(rng, rng.randint(0, 80), rng.choice([1, 2, 3, 9]))
        want = brute(words)
        assert runs(words) == want
        assert text_runs(" ".join(map(str, words)).encode())[0] == want


def test_long_runs_and_long_periods():
    rng = random.Random(3)
    period = [rng.randrange(5000) for _ in range(3000)]
    words = ["a", *[str(w) for w in period * 5], "b", *["x"] * 20_000]
    assert text_runs(" ".join(words).encode())[0] == [(1, 15_000, 3000), (15_002, 20_000, 1)]


def test_fibonacci_words_have_no_fourth_powers():
    a, b = ["a"], ["a", "b"]
    for _ in range(14):
        a, b = b, b + a
    assert runs(b) == brute(b) == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found, gone = brute(words), set()
    for s, size, q in found:
        gone |= set(range(s + q, s + size))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
    short = hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *top, digest, short)


def test_report_with_nulls_repeats_ties_and_clashing_columns(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"é{w}" for w in looping(rng, rng.randint(0, 60), 3))) for k in range(150)]
    rows += [(None, None), (None, "a b c a b"), (151, ""), (152, " \t\n\x0b\x0c\r"), (153, "a " * 6 + "b " * 6), (153, "a " * 6 + "b " * 6), (154, "x y " * 7), (155, "word " * 30_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit(1)).withColumn("repeats", F.lit("x"))
    got = report(collapse(df.withColumn("text", looped(F.col("doc_id"), F.col("text")))))
    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((i, *expected(i, t)) for i, t in rows), key=key)
    assert report(collapse(spark.createDataFrame([], SCHEMA))).count() == 0


def test_collapsed_text_itself(spark):
    row = collapse(spark.createDataFrame([(1, "go  on on on on on on\nand stop")], SCHEMA)).first()
    assert row.repeats.collapsed == "go on and stop" and [tuple(r) for r in row.repeats.runs] == [(1, 6, 1)]
