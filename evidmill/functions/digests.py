"""Digests: ids, hashes, declared digest text and its shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _ascii_char(ch: Column) -> Column:
    """One character as it stands inside an ASCII-only JSON string."""
    code = F.ascii(ch)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
    low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    out = F.when(code > 0xFFFF, F.concat(unit(high), unit(low))).when((code < 32) | (code > 126), unit(code)).otherwise(ch)
    for raw, text in named.items():
        out = F.when(ch == raw, F.lit(text)).otherwise(out)
    return out


def json_string(value: Column) -> Column:
    """A JSON string literal with non-ASCII characters escaped, as the id formula needs."""
    plain = value.rlike(r"^[ !#-\[\]-~]*$")
    escaped = F.array_join(F.transform(F.split(value, ""), _ascii_char), "")
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(escaped), F.lit('"'))


def stable_id(kind: str, *parts: Column) -> Column:
    """``prefix_<24 hex>`` from the SHA-256 of the compact JSON list of kind and parts."""
    prefix = re.sub(r"[^A-Za-z0-9_]+", "_", kind).strip("_").lower() or "id"
    items = [json_string(F.lit(kind)), *[json_string(p) for p in parts]]
    payload = F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload, 256), 1, 24))


def function_name(raw: Column) -> Column:
    """Digest function name without case, dashes and underscores."""
    return F.regexp_replace(F.lower(F.trim(raw)), "[-_]", "")


def digest_prefix(digest: Column) -> Column:
    """algorithm prefix of ``algo:hex``, NULL when there is none."""
    text = F.trim(digest)
    return F.when(text.contains(":"), function_name(F.substring_index(text, ":", 1)))


def digest_body(digest: Column) -> Column:
    text = F.lower(F.trim(digest))
    at = F.instr(text, ":")
    return F.when(at > 0, F.trim(F.substr(text, at + 1))).otherwise(text)


def is_sha256_hex(text: Column) -> Column:
    """P5: exactly 64 hex digits."""
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def recomputable(declared: Column, fn_name: Column, options_seen: Column) -> Column:
    """True when the declared digest can only be a SHA-256."""
    other_fn = F.coalesce(options_seen & (fn_name != "sha256"), F.lit(False))
    prefix_ok = F.coalesce(digest_prefix(declared) == "sha256", F.lit(True))
    return ~other_fn & prefix_ok & F.coalesce(digest_body(declared).rlike("^[0-9a-f]{64}$"), F.lit(False))


def declared_digest(file: Column) -> Column:
    """declared digest of a file VARIANT: text, ``{hash|sha256}``, or ``sha256``."""
    get = lambda p: F.nullif(F.trim(F.try_variant_get(file, p, "string")), F.lit(""))
    kind = F.schema_of_variant(F.try_variant_get(file, "$.digest", "variant"))
    text = F.when(kind == "STRING", get("$.digest"))
    return F.coalesce(text, get("$.digest.hash"), get("$.digest.sha256"), get("$.sha256"))


def declared_size(file: Column) -> Column:
    """declared size, tolerant of text and of three key names."""
    get = lambda p: F.try_variant_get(file, p, "string").try_cast("bigint")
    return F.coalesce(get("$.length"), get("$.sizeBytes"), get("$.size_bytes"))
