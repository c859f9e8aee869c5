"""Detectors: one positive each, the negative controls, idempotence, JSON ownership."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from evidmill.functions import detectors as dt, paths
from evidmill.operators import redact

J = "".join  # credential shapes are put together at run time, none is stored
POSITIVE = {
    "home_path": "see /home/ann/x.txt now",
    "private_key_pem": J(["-----BEGIN RSA ", "PRIVATE KEY-----\nab[REDACTED:email]cd\n-----END RSA ", "PRIVATE KEY-----"]),
    "aws_access_key_id": J(["id AK", "IA", "A1B2C3D4E5F6G7H8", "."]),
    "github_token": J(["gh", "p_", "a1B2" * 9]),
    "github_pat": J(["github", "_pat_", "a1_B" * 20]),
    "gitlab_pat": J(["gl", "pat-", "a1B2-" * 5]),
    "slack_token": J(["xo", "xb-", "1234567890-ab"]),
    "jwt": J(["ey", "Jhbcdef.ey", "Jzdefgh.sig_nature"]),
    "url_credentials": "https://user:pass@host/x",
    "authorization_credential": J(["Authorization: Bear", "er abcdefghijkl123"]),
    "aws_secret_access_key": J(["aws_secret_access_", "key = ", "aB3/" * 10]),
    "abs_path": "cwd=/private/tmp/run/ws",
    "email": "mail a.b@example.org!",
    "ipv4": "at 10.1.2.3:80",
}
NEGATIVE = [
    "a" * 64, "token = \"" + "a1" * 20 + "\"", "//pkg/sub:target", "@repo//pkg:tgt", "../rel/path", "grpc://host/a/b", "file://host/share/x",
    "${HOME}/x/y", "127.0.0.1", "169.254.1.2", "0.0.0.0", "version 1.2.3", "input_tokens: 12", "run.sh", "secret_access_key=" + "0123456789" * 4,
]


def scanned(spark, pairs, **kwargs):
    """``(redacted, [detector, ...], [excerpt, ...])`` of each ``(text, key)``."""
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(pairs)], "i int, text string, key string")
    rows = redact.scan(df, "text", F.col("key"), **kwargs).collect()
    return [(r.redacted, [f.detector for f in r.findings], [(f.start, f.end, f.line, f.excerpt) for f in r.findings]) for r in sorted(rows, key=lambda r: r.i)]


def test_each_detector_fires_and_is_idempotent(spark):
    once = scanned(spark, [(t, None) for t in POSITIVE.values()])
    for name, (_, found, _) in zip(POSITIVE, once):
        assert name in found
    again = scanned(spark, [(r[0], None) for r in once])
    assert [(r[0], r[1]) for r in again] == [(r[0], []) for r in once]


def test_negative_controls(spark):
    for text, got in zip(NEGATIVE, scanned(spark, [(t, "note") for t in NEGATIVE])):
        assert got[0] == text and got[1] == [], text


def test_key_context_and_digest_exception(spark):
    got = scanned(spark, [("aB3/" * 10, "client_secret"), ("aB3/" * 10, "note"), *[(d, "client_secret") for d in ("0a" * 20, "0A" * 20, "1" * 40)]])
    assert [bool(r[1]) for r in got] == [True, False, False, False, False]


def test_unknown_placeholder_does_not_hide_a_secret(spark):
    hidden = "[REDACTED:" + POSITIVE["aws_access_key_id"][3:-1] + "]"
    assert scanned(spark, [(hidden, None)])[0][1] == ["aws_access_key_id"]


def test_separators_of_the_c0_range_hide_nothing(spark):
    for gap in "\x1c\x1d\x1e\x1f\u2003":
        text, found, _ = scanned(spark, [(J(["tok", "en", gap, "ABCDEFGHIJKLMNOPQR"]), None)])[0]
        assert found == ["authorization_credential"] and "ABCD" not in text


def by_hand(text, chosen):
    """Hits of plain patterns, taken one after another from the left."""
    left, out = 0, []
    while True:
        found = [(m.start(d.group), -len(m.group(d.group)), k) for k, d in enumerate(chosen) for m in re.finditer(d.pattern, text)
                 if m.start(d.group) >= left and not (d.reject and re.fullmatch(d.reject, m.group(d.group)))]
        if not found:
            return out
        start, size, k = min(found)
        left = start - size
        out.append((start, left, chosen[k].name))


def test_places_like_plain_search(spark):
    rng = random.Random(4)
    parts = [*POSITIVE.values(), "\n", " ", "é\U0001f600", "/", "x@y.org", "a.b", "10.0.0.9", "http://u:p@h.example/z/k", "https://", "/usr/lib/x.so"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    chosen = tuple(d for d in dt.chosen(dt.DEFAULT) if d.name != "private_key_pem")
    got = scanned(spark, [(t, None) for t in texts], names=tuple(d.name for d in chosen))
    for text, (new, found, places) in zip(texts, got):
        want = by_hand(text, chosen)
        if "[REDACTED" in text:
            continue
        assert [(a, b, n) for (a, b, _, _), n in zip(places, found)] == want, text
        assert [line for _, _, line, _ in places] == [1 + text.count("\n", 0, a) for a, _, _ in want]
        stands = {"home_path": lambda h: "${HOME}", "abs_path": lambda h: ("file://" if h.startswith("file") else "") + "[REDACTED:abs_path]/" + h.split("/")[-1]}
        wanted, cursor = "", 0
        for start, stop, name in want:
            wanted += text[cursor:start] + stands.get(name, lambda h: f"[REDACTED:{name}]")(text[start:stop])
            cursor = stop
        assert new == wanted + text[cursor:]


def test_a_registered_detector(spark):
    own = dt.Detector("ticket", "pii", r"\bTCK-[0-9]{4}\b")
    assert scanned(spark, [("see TCK-1234 now", None)], more=(own,))[0][:2] == ("see [REDACTED:ticket] now", ["ticket"])
    assert scanned(spark, [("host build.example.com", None)], names=dt.enabled(hostname=True))[0][1] == ["hostname"]


def test_null_text(spark):
    assert scanned(spark, [(None, None)])[0][:2] == (None, [])


@pytest.mark.parametrize("text,want", [
    ("--f=/tmp/x/bep.json", "--f=[REDACTED:abs_path]/bep.json"), ("file:///Users/a/out.txt", "file://[REDACTED:abs_path]/out.txt"),
    ("/one", "/one"), ("https://h/a/b", "https://h/a/b"), ("/a/b/c d", "[REDACTED:abs_path]/c d"), ("//a:b", "//a:b")])
def test_path_scrub_on_the_jvm(spark, text, want):
    col = lambda v: spark.range(1).select(paths.scrub_local_paths(F.lit(v))).first()[0]
    assert col(text) == want and col(want) == want


def test_root_scrub(spark):
    out = spark.range(1).select(paths.scrub_local_paths(F.lit("at /data now /data/x /database"), ("/data",))).first()[0]
    assert out == "at [REDACTED:abs_path]/data now [REDACTED:abs_path]/x /database"


def test_json_state_belongs_to_the_nearest_object(spark):
    doc = {"redaction_state": "safe", "a": {"redaction_state": "unknown", "m": ["x@y.org"]}, "b": {"p": "fine"}}
    bare = {"redaction_state": "blocked", "m": "x@y.org"}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(bare)), (3, "no json, mail c@d.net"), (4, '{"n": 1.50, "n2": [1e3]}'), (5, None)], "id int, j string")
    out = {r.id: r.redacted for r in redact.rewrite_json(df, "id", "j").collect()}
    one = json.loads(out[1])
    assert one["redaction_state"] == "safe" and one["a"]["redaction_state"] == "redacted" and one["a"]["m"] == ["[REDACTED:email]"]
    assert json.loads(out[2])["redaction_state"] == "blocked" and out[3] == "no json, mail [REDACTED:email]"
    assert out[4] == '{"n": 1.50, "n2": [1e3]}' and out[5] is None
    rows = {r.id: (r.path, r.owner, r.owner_state) for r in redact.scan_json(df, "id", "j").collect()}
    assert rows == {1: ("$.a.m[0]", "$.a", "redacted"), 2: ("$.m", "$", "blocked"), 3: ("$", None, None)}


def test_a_hit_implies_its_mark(spark):
    """Patterns are run on all texts, marks beside them: no hit may stand in an unmarked text."""
    rng = random.Random(8)
    parts = [*POSITIVE.values(), "bearer", "BASIC ", "Token", "toKen ", "baſic ", "ſecret_acceſs-Key = ", "aB3/" * 10, " ABCDEFGHIJKLMNOPQR", "://u:p", "@", "9.9", ".8.7 ",
             "/a", "/b/", "file:///", "é", " ", "\n", ".com", "x@y"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))),) for _ in range(600)] + [(t,) for t in POSITIVE.values()]
    df = spark.createDataFrame(rows, "t string")
    found = 0
    for d in dt.DETECTORS:
        row = df.select(F.size(redact.hits(F.col("t"), dt.pattern(d), d.group, 0, d.reject)).alias("n"), dt.marked(F.col("t"), d).alias("m")).groupBy().agg(
            F.count_if(F.col("n") > 0).alias("hits"), F.count_if((F.col("n") > 0) & ~F.col("m")).alias("lost")).first()
        assert row.lost == 0 and row.hits > 0 or d.name == "hostname", d.name
        found += row.hits
    assert found > 100
