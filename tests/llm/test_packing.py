import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evidmill.llm.packing import packed, place

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def squares_by_hand(lengths, capacity):
    """The rule with the sum written out for every choice."""
    bins, places = [], []
    for s in lengths:
        best = None
        for gap in sorted({g for g in bins if g >= s and g > 0}):
            after = list(bins)
            after.remove(gap)
            after.append(gap - s)
            total = sum(after.count(g) ** 2 for g in set(after) if g)
            if best is None or total < best[0]:
                best = (total, gap)
        gap = best[1] if best else capacity
        if best:
            bins.remove(gap)
        bins.append(gap - s)
        places.append(capacity - gap)
    return places, len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_place_like_hand(lengths):
    sequence, offset = place(np.array(lengths, dtype=np.int64), 12)
    places, made = squares_by_hand(lengths, 12)
    assert offset.tolist() == places and len(set(sequence.tolist())) == made


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("shard", [3, 65536])
def test_pieces_and_places(spark, shard):
    texts = {1: None, 2: "", 3: "hello world " * 90, 4: "short", 5: "éè\U0001f600 <|endoftext|> 12345", 6: "x y" * 400, 7: "  \n\n ", 8: "a" * 31,
             9: "<|endoftext|>", 10: "x<|endoftext|><|endoftext|> y <|endoftext", 11: " <|endoftext|>\n" * 50}
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts.items()], "doc_id long, text string, length int")
    rows = packed(docs, VOCABULARY, public_tokenizers.PATTERN, 32, shard_docs=shard).collect()
    made = check(rows, texts, 32)
    assert made <= -(-sum(r.length for r in rows) // 32) + (1 if shard > 8 else 4)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packed(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "z")], "doc_id long, text string")
    rows = packed(twice, VOCABULARY, public_tokenizers.PATTERN, 8).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]


@pytest.mark.parametrize("row", ["(NULL, 'a b c')", "(7, concat('a b ', id))"])
def test_rows_without_own_ids_go_to_all_shards(spark, row):
    docs = spark.range(9000).selectExpr(f"inline(array(struct{row}))").toDF("doc_id", "text")
    rows = packed(docs, VOCABULARY, public_tokenizers.PATTERN, 64, shard_docs=1000).collect()
    assert len(rows) == 9000 and len({(r.sequence_id, r.offset) for r in rows}) == 9000
    shards = Counter(r.sequence_id >> 40 for r in rows)
    assert len(shards) == 9 and max(shards.values()) < 1300
