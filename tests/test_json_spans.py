"""Lossless JSON: tokens against the standard parser, edits that leave all other characters alone."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from evidmill.functions import json_spans
from evidmill.operators import receipts, redact

MAIL, GONE = "u1@example.com", "[REDACTED:email]"


def strings(value, out):
    if isinstance(value, str):
        out.append(("value", value))
    elif isinstance(value, list):
        for v in value:
            strings(v, out)
    elif isinstance(value, dict):
        for k, v in value.items():
            out.append(("key", k))
            strings(v, out)
    return out


def made(rng, depth=0):
    kind = rng.randrange(7 if depth < 5 else 4)
    if kind == 0:
        return rng.choice([0, -1.5, 1e30, True, False, None])
    if kind <= 3:
        return rng.choice(["", "é\U0001f600", 'a"b\\c', "\n\t/", "x.y", "\u007f"])
    if kind == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "a.b", "b/c", "~", "", "é"]) + str(k): made(rng, depth + 1) for k in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(20))
def test_items_like_the_standard_parser(seed):
    rng = random.Random(seed)
    for _ in range(60):
        value = made(rng)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        found = json_spans.items(text)
        assert [(i.location, i.text) for i in found] == strings(value, [])
        assert all(json.loads(text[i.start : i.stop]) == i.text for i in found)
        broken = text[: rng.randrange(len(text))] + rng.choice(["", ",", "}", "]", '"', "x", ":"]) + text[rng.randrange(len(text)) :]
        try:
            json.loads(broken)
            valid = True
        except ValueError:
            valid = False
        assert (json_spans.items(broken) is not None) == valid, broken


def test_deep_text_and_half_surrogates():
    deep = '{"a":' * 5000 + '["\\ud800x"]' + "}" * 5000
    assert json_spans.items(deep)[-1].text == "�x"
    assert json_spans.items("[" * 100_000) is None


CASES = [
    # A key with a dot beside a nested key of the same path.
    ('{"a.b":"mail %s","a":{"b":"clean"}}', 1), ('{"a.b":"mail %s","a":{"b":"%s"}}', 2),
    # Repeated keys, numbers, white space and escapes around the hit.
    ('{"k": "%s", "k" : "x",\n "n": [1.50, 1e3, -0, 12345678901234567890]}', 1), ('["\\u00e9\\/ %s \\n\\ud83d\\ude00", "\\u0041"]', 1),
    ('["to %s and %s\\t, then %s"]', 3), ('{"a/b":{"~":["%s"]}, "0": "%s"}', 2), ('"%s"', 1),
    ('{"x":' * 80 + '"%s"' + "}" * 80, 1), ("no json %s", 1), ('{"open": "%s"', 1), ("{}", 0), ("", 0),
]


def test_untouched_characters_stay(spark):
    rows = [(k, text % ((MAIL,) * n) if n else text) for k, (text, n) in enumerate(CASES)]
    out = {r.id: r.redacted for r in redact.rewrite_json(spark.createDataFrame([*rows, (99, None)], "id int, j string"), "id", "j").collect()}
    assert out == {**{k: text % ((GONE,) * n) if n else text for k, (text, n) in enumerate(CASES)}, 99: None}


def test_states_of_owners(spark):
    docs = ['{"redaction_state" : "safe","a":{"redaction_state":"unknown","m":["%s"]},"b":1}', '{"m":"%s","redaction_state":"blocked"}',
            '{"m":"%s","redaction_state":null}', '{"a.b":{"redaction_state":"safe","x":[[{"m":"%s"}]]},"a":{"b":{"redaction_state":"safe"}}}', '{"redaction_state":"redacted","m":"%s"}',
            '{"redaction_state":"safe","redaction_state":"unknown","m":"%s"}']
    want = [d % GONE for d in docs]
    want[0] = want[0].replace('"unknown"', '"redacted"')
    want[3] = want[3].replace('"safe"', '"redacted"', 1)
    want[5] = want[5].replace('"unknown"', '"redacted"')
    df = spark.createDataFrame([(k, d % MAIL, 7) for k, d in enumerate(docs)], "id int, j string, text int")
    out = {r.id: r.redacted for r in redact.rewrite_json(df, "id", "j").collect()}
    assert [out[k] for k in range(len(docs))] == want
    places = {r.id: (r.path, r.pointer, r.owner) for r in redact.scan_json(df, "id", "j").where("id IN (0, 3)").collect()}
    assert places == {0: ("$.a.m[0]", "/a/m/0", "$.a"), 3: ("$.a.b.x[0][0].m", "/a.b/x/0/0/m", "$.a.b")}


def test_paths_keep_their_base_name_inside_escapes(spark):
    df = spark.createDataFrame([(1, '{"p":"\\u0022/private/tmp/x/bep.json\\u0022 \\/ 10.1.2.3"}')], "id int, j string")
    assert redact.rewrite_json(df, "id", "j").first().redacted == '{"p":"\\u0022[REDACTED:abs_path]/bep.json\\u0022 \\/ [REDACTED:ipv4]"}'


def test_keys_are_reported_and_never_rewritten(spark):
    df = spark.createDataFrame([(1, '{"%s": {"%s": 1}}' % (MAIL, MAIL))], "id int, j string")
    assert sorted(r.pointer for r in redact.scan_json(df, "id", "j").collect()) == [f"/{MAIL}", f"/{MAIL}/{MAIL}"]
    assert redact.rewrite_json(df, "id", "j").first().redacted == df.first().j


def test_forbidden_keys_at_any_depth_and_unparseable_text(spark):
    deep = '{"x":' * 200 + '{"prompt":1}' + "}" * 200
    rows = [(1, deep), (2, '{"pr\\u006fmpt":2}'), (3, '{"prompt": '), (4, "{}"), (5, None)]
    got = {r.id: r.name for r in receipts.forbidden_keys(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()}
    assert got == {1: "prompt", 2: "prompt", 3: None}


def test_tolerant_parse_keeps_the_text(spark):
    df = spark.createDataFrame([('{"a": 1}', "[1, 2]", 5), ("no json", "{", 6), (None, '"s"', 7)], "payload string, command string, span int")
    out = json_spans.decoded_rows(df)
    assert dict(out.dtypes) == {"payload": "variant", "command": "variant", "span": "int"}
    assert [tuple(r) for r in out.select(F.col("payload").cast("string"), F.col("command").cast("string"), F.schema_of_variant("payload")).collect()] == [
        ('{"a":1}', "[1,2]", "OBJECT<a: BIGINT>"), ("no json", "{", "STRING"), (None, "s", None)]


def test_the_operator_ships_the_package(tmp_path):
    """Run from another folder, with the package found by the driver alone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        from evidmill.session import build_session
        from evidmill.operators import redact
        spark = build_session("elsewhere", "local-cluster[1,1,1024]", **{{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": {str(tmp_path)!r}, "spark.executorEnv.PYTHONPATH": "", "spark.log.level": "ERROR"}})
        print("GOT", redact.rewrite_json(spark.createDataFrame([(1, '["{MAIL}"]')], "id int, j string"), "id", "j").first().redacted)
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f'GOT ["{GONE}"]' in done.stdout, done.stderr[-2000:]
