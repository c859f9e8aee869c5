"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidmill.llm import exact_dedup, language_id, near_dedup, packing, queries, toxicity
from evidmill.llm.common import matching, remainder_column, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; trained as ``op9_toxicity`` is."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder_column("doc_id", 3) != 1))
    scored = toxicity.score(docs, model, into="_toxicity")
    return scored.where(F.col("_toxicity.score") < toxicity.THRESHOLD).drop("_toxicity")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters and undecided ones go. Trained as ``op5_language_id`` is."""
    model = language_id.fit(docs.where(remainder_column("doc_id", 3) != 1))
    named = language_id.identify(docs, model, into="_language")
    return named.where(~F.col("_language.rejected")).drop("_language")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays. Rows without id stay: they can't be told apart by it."""
    return _only(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return _only(docs, near_dedup.near_dedup(docs, width=5, percent=80))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left."""
    return packing.packed(docs, queries.vocabulary("byte_bpe_50k.json"), queries.pattern())


def _only(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows that stay: semi join on the id, broadcast up to a bound and shuffled beyond."""
    kept = written(decisions.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept")
    return matching(docs.where("doc_id IS NOT NULL"), kept, "doc_id").select(docs.columns).union(docs.where("doc_id IS NULL"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# Trained models and a tokenizer have no SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
