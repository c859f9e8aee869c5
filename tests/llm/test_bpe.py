import base64
import hashlib
import random
import time

import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from evidmill.llm.bpe import Codec, RankQueue, decode, encode, round_trip

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = open(VOCABULARY, "rb").read()
OWN = Codec(RANKS, public_tokenizers.PATTERN)
PEER = tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, special_tokens={},
                         mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("abé ñß'stlm 12\n\t\x1c\x85 .,", max_size=200)))
def test_like_tiktoken(text):
    ids = OWN.encode(text)
    assert ids == PEER.encode_ordinary(text) and OWN.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_single_pieces_like_tiktoken(piece):
    assert list(OWN.merge(piece)) == PEER._encode_single_piece(piece)


def test_very_long_pre_tokens():
    rng = random.Random(1)
    for piece in ("ab" * 150_000, "".join(rng.choice("etaoinshrdluàß") for _ in range(200_000)), " " * 50_000, "%" * 60_001):
        begin = time.process_time()
        ids = OWN.encode(piece)
        assert time.process_time() - begin < 20 and OWN.decode(ids).decode() == piece
        if len(piece) < 70_000:
            assert ids == PEER.encode_ordinary(piece)


def test_queue_gives_lowest_rank_and_leftmost_place():
    rng, queue, want = random.Random(2), RankQueue(50_000), []
    for _ in range(2000):
        if rng.random() < 0.6 or not want:
            entry = (rng.choice([0, 63, 64, 4095, 4096, 49_999, rng.randrange(50_000)]), rng.randrange(99))
            queue.push(*entry)
            want.append(entry)
        else:
            assert queue.pop() == min(want)
            want.remove(min(want))
    while want:
        assert queue.pop() == min(want)
        want.remove(min(want))
    assert queue.pop() is None


def test_results_dont_depend_on_what_is_remembered(monkeypatch):
    import evidmill.llm.bpe as bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = Codec(RANKS, public_tokenizers.PATTERN)
    text = "eins zwei drei vier eins fünf sechs sieben zwei eins " * 3
    assert own.encode(text) == PEER.encode_ordinary(text) and len(own.known) <= 3


def test_rows(spark):
    texts = [(1, None, "x"), (2, "", "x"), (3, "Grüße an alle, it's 2024!\n\n  ok", "x"), (None, "lone", "x"), (3, "again", "x"), (4, "word " * 30_000, "x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    got = sorted(map(tuple, round_trip(docs, VOCABULARY, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for doc_id, text, _ in texts:
        ids = PEER.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = decode(encode(docs, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    assert round_trip(docs.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0
