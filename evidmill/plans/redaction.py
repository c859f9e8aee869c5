"""Queries: scans for secrets, paths and personal data (R, A25, P8, F13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidmill.functions import detectors as dt, json_spans, paths
from evidmill.operators import redact
from evidmill.plans.binding import Spine


def _texts(s: Spine):
    d = s.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("documents").alias("part"), "text")
    p = s.table("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("pages").alias("part"), F.col("html").alias("text"))
    return d.unionByName(p)


def _json_docs(s: Spine):
    """Nested documents whose values hold addresses, under objects with and without a state."""
    c = s.table("conversations")
    mail = F.concat(F.lit("mail u"), F.col("conv_id").cast("string"), F.lit("@example.com now"))
    doc = F.to_json(F.struct(
        F.when(F.col("turn") % 2 == 0, "safe").when(F.col("turn") == 1, "blocked").alias("redaction_state"),
        F.struct(F.array(F.struct(mail.alias("note"), F.when(F.col("turn") == 2, "unknown").alias("redaction_state"))).alias("items"), F.lit(1).alias("n")).alias("payload")))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), doc.alias("json"))


def _stored(s: Spine):
    """Turns as stored rows: every other payload is JSON, the rest is the text as it came."""
    c = s.table("conversations")
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("role", "text"))).otherwise(F.col("text")).alias("payload"))


def _nested(s: Spine):
    """Whole texts inside JSON written by hand: keys with dots and repeated keys, numbers and spaces that a rewrite must keep."""
    d = s.table("documents").where("text IS NOT NULL")
    escaped = F.substring(F.to_json(F.struct("text")), F.lit(9), F.lit(1 << 30))  # the string literal, and the closing brace
    literal = F.substring(escaped, F.lit(1), F.length(escaped) - 1)
    return d.select("doc_id", F.concat(F.lit('{"a.b" : '), literal, F.lit(', "a": {"b": "clean"}, "n": [1.50, 1e3], "k":"x", "k": ['), literal, F.lit("]}")).alias("json"))


def _paths(s: Spine):
    d = s.table("documents")
    return d.select("doc_id", F.concat(
        F.lit("cwd=/private/tmp/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt //b:t file:///Users/me/"), F.col("lang"),
        F.lit(" grpc://h/a/b ")).alias("t"))


QUERIES = {
    "R1_R4_native_counts": lambda s: redact.native_counts(
        _texts(s), ["id"], "text", ("home_path", "private_key_pem", "gitlab_pat", "slack_token", "email")),
    "R4_ipv4_counts": lambda s: redact.native_counts(_texts(s), ["part", "id"], "text", ("ipv4",)).groupBy("part").agg(F.sum("ipv4").alias("n")),
    "R1_R2_R5_R6_R7_findings": lambda s: redact.findings(redact.scan(_texts(s), "text"), ["id"]).select("id", "detector", "tier", "line", "start"),
    "R6_rewritten_texts": lambda s: redact.scan(_texts(s), "text").select("id", F.sha2("redacted", 256).alias("sha256")),
    "R5_R6_email_rewrite": lambda s: redact.scan(_texts(s), "text", names=("email",)).select("id", F.sha2("redacted", 256).alias("sha256")),
    "R7_email_lines": lambda s: redact.findings(redact.scan(_texts(s), "text", names=("email",)), ["id"]).groupBy("id", "line").agg(F.count("*").alias("n")),
    "A25_detector_counts": lambda s: redact.detector_counts(redact.findings(redact.scan(_texts(s), "text", names=("email", "gitlab_pat")), ["id"])),
    "R10_gate": lambda s: redact.gate(redact.scan(_texts(s), "text", names=("email",)), ["part"]),
    "R8_json_findings": lambda s: redact.scan_json(_json_docs(s), "doc", "json").select(
        "doc", "path", "location", "redacted", "owner", "owner_state"),
    "R8_json_rewrite": lambda s: redact.rewrite_json(_json_docs(s), "doc", "json").select(
        "doc", F.get_json_object("redacted", "$.payload.items[0].note").alias("note"),
        F.get_json_object("redacted", "$.redaction_state").alias("outer_state"),
        F.get_json_object("redacted", "$.payload.items[0].redaction_state").alias("inner_state")),
    "F11_tolerant_parse": lambda s: json_spans.decoded_rows(_stored(s)).select(
        "conv_id", "turn", F.schema_of_variant("payload").startswith("OBJECT").alias("is_object"), F.try_variant_get("payload", "$.role", "string").alias("role"),
        F.sha2(F.coalesce(F.try_variant_get("payload", "$.text", "string"), F.try_variant_get("payload", "$", "string")), 256).alias("sha256")),
    "R8_nested_rewrite": lambda s: redact.rewrite_json(_nested(s), "doc_id", "json").select("doc_id", F.sha2("redacted", 256).alias("sha256")),
    "R3_R11_scrubbed_paths": lambda s: _paths(s).select("doc_id", paths.scrub_local_paths(F.col("t")).alias("scrubbed")),
    "R12_stripped_reports": lambda s: s.table("documents").select(
        "doc_id", paths.strip_prompts(F.concat(F.lit('{"raw_prompt": "'), F.col("source"), F.lit('", "at": "/home/'), F.col("lang"), F.lit('/x"}'))).alias("t")),
    "P8_F13_redacted_fields": lambda s: redact.redacted_fields(s.table("documents").select(
        "doc_id", F.to_json(F.struct(
            F.concat(F.lit("[REDACTED:abs_path]/"), F.col("source")).alias("cwd"), F.lit("plain").alias("mode"),
            F.array(F.lit("x"), F.concat(F.lit("--f=[REDACTED:abs_path]/"), F.col("lang"))).alias("command"))).alias("payload")),
        "doc_id", "payload").withColumn("value", redact.masked_excerpt(F.col("value"), 12)),
}

_TEXTS = "WITH t AS (SELECT concat('d', doc_id) AS id, 'documents' AS part, text FROM documents UNION ALL SELECT concat('p', page_id), 'pages', html FROM pages)"
_BY_NAME = {d.name: d.pattern for d in dt.DETECTORS}
_EMAIL = _BY_NAME["email"]
_COUNT = "len(regexp_extract_all(text, '{p}'))"

ORACLES = {
    "F11_tolerant_parse": """SELECT conv_id, turn, turn % 2 = 0 AS is_object, CASE WHEN turn % 2 = 0 THEN role END AS role, sha256(text) AS sha256 FROM conversations""",
    "R1_R4_native_counts": _TEXTS + " SELECT id, " + ", ".join(
        _COUNT.format(p=_BY_NAME[n].replace("'", "''").replace(r"\x1c-\x1f", "")) + f" AS {n}" for n in ("home_path", "private_key_pem", "gitlab_pat", "slack_token", "email")) + " FROM t",
    "R4_ipv4_counts": _TEXTS + rf""", q AS (SELECT part, unnest(regexp_extract_all(text, '(?:^|[^0-9.])({_BY_NAME["ipv4"][len("(?<![0-9.])"):-len("(?![0-9.])")]})(?:$|[^0-9.])', 1)) AS ip FROM t)
 SELECT t.part, coalesce((SELECT count(*) FROM q WHERE q.part = t.part AND NOT regexp_matches(ip, '^(0|127)\.|^169\.254\.')), 0) AS n FROM t GROUP BY 1""",
    "R5_R6_email_rewrite": _TEXTS + f" SELECT id, sha256(regexp_replace(text, '{_EMAIL}', '[REDACTED:email]', 'g')) AS sha256 FROM t",
    "R7_email_lines": _TEXTS + f""", l AS (SELECT id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t)
 SELECT id, line, len(regexp_extract_all(s, '{_EMAIL}')) AS n FROM l WHERE regexp_matches(s, '{_EMAIL}')""",
    "A25_detector_counts": _TEXTS + rf""", c AS (SELECT sum(len(regexp_extract_all(text, '{_EMAIL}')))::BIGINT AS e, sum(len(regexp_extract_all(text, '\bglpat-[A-Za-z0-9_-]{{20,}}')))::BIGINT AS g FROM t)
 SELECT 'email' AS detector, e AS n FROM c WHERE e > 0 UNION ALL SELECT 'gitlab_pat', g FROM c WHERE g > 0 UNION ALL SELECT 'all', e + g FROM c""",
    "R10_gate": _TEXTS + f" SELECT part, count(*) AS documents, sum(len(regexp_extract_all(text, '{_EMAIL}')))::BIGINT AS findings, bool_or(regexp_matches(text, '{_EMAIL}')) AS failed FROM t GROUP BY 1",
    "R8_json_findings": """SELECT conv_id * 100 + turn AS doc, '$.payload.items[0].note' AS path, 'value' AS location, 'mail [REDACTED:email] now' AS redacted,
 CASE WHEN turn = 2 THEN '$.payload.items[0]' WHEN turn % 2 = 0 OR turn = 1 THEN '$' END AS owner, CASE WHEN turn % 2 = 0 THEN 'redacted' WHEN turn = 1 THEN 'blocked' END AS owner_state FROM conversations""",
    "R8_json_rewrite": """SELECT conv_id * 100 + turn AS doc, 'mail [REDACTED:email] now' AS note, CASE WHEN turn = 2 THEN 'safe' WHEN turn % 2 = 0 THEN 'redacted' WHEN turn = 1 THEN 'blocked' END AS outer_state,
 CASE WHEN turn = 2 THEN 'redacted' END AS inner_state FROM conversations""",
    "R3_R11_scrubbed_paths": "SELECT doc_id, concat('cwd=[REDACTED:abs_path]/f', doc_id, '.txt //b:t file://[REDACTED:abs_path]/', lang, ' grpc://h/a/b ') AS scrubbed FROM documents",
    "R12_stripped_reports": """SELECT doc_id, '{"prompt_redacted": "<redacted>", "at": "${HOME}/x"}' AS t FROM documents""",
    "P8_F13_redacted_fields": """SELECT doc_id, 'cwd' AS field, '[REDACTED:ab...' AS value FROM documents UNION ALL SELECT doc_id, 'command', '--f=[REDACTED:ab...' FROM documents""",
}
