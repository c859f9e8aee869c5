import hashlib
import re

import pytest

from evidmill.llm.exact_dedup import exact_dedup, identities

SCHEMA = "doc_id long, text string, keep_id string, n_chars long"


def brute(rows):
    groups, out = {}, []
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, len(text or "")))
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[norm], key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out.append((doc_id, keep, len(groups[norm]), doc_id == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [3, 8, 8192])
def test_like_brute_force(spark, block):
    long = "abc defg héllo " * 40
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t"), (7, "ab "), (8, long), (9, long + "!"), (10, "\n" + long),
            (11, "abc"), (11, "abc"), (12, "abcabd"), (13, "abcabe"), (14, "abc abd"), (None, "lone"), (15, "x" * 50), (16, "x" * 51), (17, "x" * 50)]
    docs = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in exact_dedup(docs, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_names_tell_texts_apart_without_digest(spark):
    docs = spark.createDataFrame([(i, ("ab" * (i % 7 + 1) + "c" * (i % 3))[: i % 11]) for i in range(60)], "doc_id long, text string")
    seen = {}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in identities(docs, 2).collect():
        seen.setdefault((r.level, r.name), set()).add(text[r.doc_id])
    assert all(len(v) == 1 for v in seen.values()) and len(seen) == len(set(text.values()))


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
