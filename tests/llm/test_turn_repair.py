import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from evidmill.llm.turn_repair import damaged, repaired_turns, summaries

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = WORDS.findall(text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Uniform-cost search over all edit strings, the automaton written as a pattern. Gives (cost, edits, lines)."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    best = None
    while heap:
        cost, edits, k, roles, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if k == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best = min(best, (cost, edits, lines)) if best else (cost, edits, lines)
            continue
        if (edits, k, roles) in done or edits.count("I") > len(rows) + 2:
            continue
        done.add((edits, k, roles))
        ways = [(5, "I", "user", "", 0), (5, "I", "assistant", "", 0)]
        if k < len(rows):
            ways.append((2, "D", None, None, 1))
            if marks[k] not in ("blank", "duplicate"):
                late = 5 if marks[k] == "truncated" else 0
                ways += [(late, "K", rows[k][1], rows[k][2], 1), (1 + late, "R", "user", rows[k][2], 1), (1 + late, "R", "assistant", rows[k][2], 1)]
        for c, e, role, text, step in ways:
            # An empty role has no initial that is legal.
            after = roles if role is None else roles + (role[:1] or " ")
            if re.fullmatch(r"(s?(ua)*u?)", after):
                heapq.heappush(heap, (cost + c, edits + e, k + step, after, lines if role is None else (*lines, f"{role}:{text}")))
    return best


def brute(turns, dropped=()):
    groups = defaultdict(list)
    for k, (conv, turn, role, text) in enumerate(turns):
        groups[conv]
        if k not in dropped:
            groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        marks, known = faults(rows), [r[0] for r in rows if r[0] is not None]
        cost, edits, lines = cheapest(rows, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def made(rng, convs, longest):
    rows = []
    for conv in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "unknown", ""])
            text = rng.choice(["Yes.", "No", "", " \n\t", None, "Wait!  ", "é?", f"t{t}.", f"t{t}.", "a "])
            rows.append((conv, rng.choice([t, t, t, t, None, t // 2]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_like_search_over_all_edits(spark, seed):
    turns = made(random.Random(seed), 60, 5)
    assert collected(summaries(spark.createDataFrame(turns, SCHEMA))) == brute(turns)


def test_damage_and_dropped_conversations(spark):
    turns = made(random.Random(9), 120, 4)
    hurt, dropped = [], set()
    for conv, turn, role, text in turns:
        code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text or " ") if code == 2 else text
        role = "user" if code == 4 else role
        for _ in range(2 if code == 3 else 1):
            dropped |= {len(hurt)} if code == 0 else set()
            hurt.append((conv, turn, role, text))
    want = brute(hurt, dropped)
    assert any(w[6] == "" and w[7] == hashlib.sha256(b"").hexdigest() for w in want.values())
    rows = damaged(spark.createDataFrame(turns, SCHEMA))
    from pyspark.sql import functions as F

    assert collected(summaries(rows, F.col("_dropped"))) == want


def test_state_is_carried_across_batches(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(5001)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    got = collected(summaries(spark.createDataFrame(rows, SCHEMA)))
    # Deleting the last user turn is cheaper than an inserted answer.
    assert got[1][5:7] == (2, "K" * 5000 + "D") and got[2][5:7] == (0, "KK")
    lines = [f"{'user' if t % 2 == 0 else 'assistant'}:turn {t}." for t in range(5000)]
    assert got[1][7] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_turns_join_to_the_digest(spark):
    turns = made(random.Random(4), 40, 6)
    df = spark.createDataFrame(turns, SCHEMA)
    want, lines, audit = brute(turns), defaultdict(list), defaultdict(str)
    for r in sorted(repaired_turns(df).collect(), key=lambda r: (r.conv_id, r.place)):
        audit[r.conv_id] += r.edit
        if r.role is not None:
            lines[r.conv_id].append(f"{r.role}:{r.text}")
    for conv, w in want.items():
        assert audit[conv] == w[6] and hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == w[7]


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(None, None, None, None, 1), (None, 3, "user", "x" * 100_000 + ".", 1), (7, 0, "user", "a.", 1), (7, 0, "user", "a.", 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", cost long")
    got = collected(summaries(df))
    assert got == brute([r[:4] for r in rows])
    empty = spark.createDataFrame([], SCHEMA)
    assert summaries(empty).count() == 0 and repaired_turns(empty).count() == 0
