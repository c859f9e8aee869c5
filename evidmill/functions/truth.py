"""Truth labels: projection defaults and the roll-up rules over many rows.

The roll-ups are split into additive partials (counts and one minimum) and a
final expression, so that they can be pre-aggregated per run before a shuffle on
the run group and never need the rows of a group together.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The label vocabularies.
SOURCE_KINDS = ("collectable_v1", "derived_v1", "simulated_v1", "future")
CONFIDENCES = ("high", "medium", "low", "unknown")
REDACTION_STATES = ("safe", "redacted", "blocked", "unknown")
# Priority of a source kind, best first; anything else ranks last.
KIND_PRIORITY = {"collectable_v1": 0, "derived_v1": 1, "simulated_v1": 2, "future": 3, "unknown": 4}
KIND_OTHER = 99

QUAD = ("source_kind", "confidence", "evidence_refs", "redaction_state")


def _or_unknown(col: str) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("unknown"))


def truth_quad(refs: bool = True) -> list[Column]:
    """The four labels with their defaults."""
    quad = [
        _or_unknown("source_kind").alias("source_kind"),
        _or_unknown("confidence").alias("confidence"),
        _or_unknown("redaction_state").alias("redaction_state"),
    ]
    if refs:
        empty = F.array().cast("array<string>")
        quad.append(F.coalesce(F.col("evidence_refs"), empty).alias("evidence_refs"))
    return quad


def kind_rank(kind: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in KIND_PRIORITY.items():
        rank = F.when(kind == name, F.lit(value)).otherwise(rank)
    return F.when(kind.isNull() | (kind == ""), F.lit(None).cast("int")).otherwise(
        F.coalesce(rank, F.lit(KIND_OTHER))
    )


def quad_partials() -> dict[str, tuple[str, Column]]:
    """Additive partials of A6, A8 and A9 as ``name -> (merge, column)``."""
    conf, red = F.col("confidence"), F.col("redaction_state")
    return {
        "q_rows": ("sum", F.lit(1)),
        "q_high": ("sum", F.when(conf == "high", 1).otherwise(0)),
        "q_low": ("sum", F.when(conf == "low", 1).otherwise(0)),
        "q_safe": ("sum", F.when(red == "safe", 1).otherwise(0)),
        "q_blocked": ("sum", F.when(red == "blocked", 1).otherwise(0)),
        "q_redacted": ("sum", F.when(red == "redacted", 1).otherwise(0)),
        "q_kind": ("min", kind_rank(F.col("source_kind"))),
    }


def dominant_source_kind(prefix: str = "") -> Column:
    """Best source kind by priority; no rows is ``future``, no label is derived."""
    rank = F.col(f"{prefix}q_kind")
    named = F.lit("other")
    for name, value in KIND_PRIORITY.items():
        named = F.when(rank == value, F.lit(name)).otherwise(named)
    return (
        F.when(F.coalesce(F.col(f"{prefix}q_rows"), F.lit(0)) == 0, "future")
        .when(rank.isNull(), "derived_v1")
        .otherwise(named)
    )


def weakest_confidence(prefix: str = "") -> Column:
    """All high is high, any low is low, otherwise medium; no rows is unknown."""
    rows = F.coalesce(F.col(f"{prefix}q_rows"), F.lit(0))
    return (
        F.when(rows == 0, "unknown")
        .when(F.col(f"{prefix}q_high") == rows, "high")
        .when(F.col(f"{prefix}q_low") > 0, "low")
        .otherwise("medium")
    )


def redaction_rollup(prefix: str = "") -> Column:
    """Blocked, then redacted, then safe only when every row is safe."""
    rows = F.coalesce(F.col(f"{prefix}q_rows"), F.lit(0))
    return (
        F.when(rows == 0, "unknown")
        .when(F.col(f"{prefix}q_safe") == rows, "safe")
        .when(F.col(f"{prefix}q_blocked") > 0, "blocked")
        .when(F.col(f"{prefix}q_redacted") > 0, "redacted")
        .otherwise("unknown")
    )


def quad_columns(prefix: str = "") -> list[Column]:
    return [
        dominant_source_kind(prefix).alias("source_kind"),
        weakest_confidence(prefix).alias("confidence"),
        redaction_rollup(prefix).alias("redaction_state"),
    ]
