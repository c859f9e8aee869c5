"""Small labelling functions: lanes, content types, durations, tones, commands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lane(value: Column, tools: tuple[str, ...] = ("bazel",)) -> Column:
    """A lane that names one of ``tools`` is that tool's lane; ``cache…`` is cache."""
    out = F.when(value.startswith("cache"), F.lit("cache")).otherwise(value)
    for tool in reversed(tools):
        out = F.when(value.contains(tool), F.lit(tool)).otherwise(out)
    return out


def cache_lane(hit: Column) -> Column:
    return F.when(hit, "cache-hit").when(~hit, "cache-miss").otherwise("cache")


def content_type(key: Column) -> Column:
    """content type by suffix."""
    return (
        F.when(key.endswith(".json"), "application/json")
        .when(key.endswith(".png"), "image/png")
        .otherwise("application/octet-stream")
    )


def hash_prefix(value: Column, n: int = 12) -> Column:
    """first ``n`` characters of a hash; an empty one is NULL."""
    return F.left(F.nullif(value, F.lit("")), F.lit(n))


def duration_label(seconds: Column) -> Column:
    """``5.4s`` below a minute and a half, ``2m 3s`` from there."""
    minutes = F.floor(seconds / 60)
    tenths = F.floor(seconds * 10 + 0.5)
    short = F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("bigint").cast("string"), F.lit("s")
    )
    rest = F.floor(seconds - minutes * 60 + 0.5)
    long = F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s"))
    return F.when(seconds >= 90, long).when(seconds >= 0, short)


def rate_label(value: Column) -> Column:
    """two decimals, ``n/a`` when unknown."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.2f", value))


def delta_label(value: Column, unit: str = "") -> Column:
    """a signed number with two decimals and a unit."""
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.format_string("%+.2f", value), F.lit(unit)))


def command_label(command: Column, index: Column) -> Column:
    """base name of the executable, unsafe characters as dashes, and an index."""
    exe = F.element_at(F.split(F.get(command, F.lit(0)), "/"), -1)
    safe = F.regexp_replace(exe, r"(?U)[^\p{L}\p{N}_-]", "-")
    return F.concat(F.coalesce(safe, F.lit("command")), F.lit("-"), index.cast("string"))


# Whole-word patterns that decide a status tone.
HARD_NEGATIVE = (
    r"fail(?:ed|ure|ing|s)?", r"error(?:ed|s)?", r"cancel(?:l?ed|l?ing|s)?", r"abort(?:ed|ing|s)?",
    r"time(?:d)?[\s-]?out", "unsuccessful", "denied", "blocked", r"broke(?:n)?", r"crash(?:ed|es|ing)?",
    "killed", "rejected",
)
POSITIVE = (
    r"complete[d]?", r"pass(?:ed)?", r"success(?:ful)?", r"succeed(?:ed)?", "ok", "okay", "done", "finished",
    "healthy", "ready",
)
NEGATED = (
    r"(?:not|no|never|n['’]t|without|non[-\s]?)\s*(?:yet\s+)?"
    r"(?:ok|okay|complete[d]?|pass(?:ed)?|success(?:ful)?|succeed(?:ed)?|done|finished?|ready)"
)
EXIT_CODE = r"\bexit(?:ed)?(?:\s*code)?\s*[:=]?\s*(-?\d+)\b"


def status_tone(status: Column) -> Column:
    """P10: pass, fail or neutral. A recorded failure wins, a negated success is neutral."""
    value = F.lower(F.trim(status.cast("string")))
    bad = value.rlike(r"\b(?:" + "|".join(HARD_NEGATIVE) + r")\b")
    good = value.rlike(r"\b(?:" + "|".join(POSITIVE) + r")\b")
    negated = value.rlike(r"\b" + NEGATED + r"\b")
    code = F.coalesce(
        F.nullif(F.regexp_extract(value, EXIT_CODE, 1), F.lit("")),
        F.nullif(F.regexp_extract(value, r"^(-?\d+)$", 1), F.lit("")),
    )
    return (
        F.when(value.isNull() | (value == ""), "neutral")
        .when(bad, "fail")
        .when(negated, "neutral")
        .when(code.rlike("^-?0+$"), "pass")
        .when(code.isNotNull(), "fail")
        .when(good, "pass")
        .otherwise("neutral")
    )
