"""The spine on disk: schemas, guarded reads, idempotent append, upgrade (S10-S16) and sinks."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from evidmill.functions.digests import stable_id
from evidmill.sources.key_index import KeyIndex, Lookup

SCHEMA_VERSION = 4
# Columns every table has, and the own columns of each.
COMMON = "source_kind string, confidence string, evidence_refs array<string>, redaction_state string, created_at string, updated_at string"
OWN = {
    "runs": "run_group string, scenario string, mode string, status string, started_at string, ended_at string",
    "changes": "run_id string, change_kind string, path string, before_hash string, after_hash string, summary string",
    "invocations": "run_id string, invocation_kind string, command array<string>, cwd string, env_hash string, exit_code int, started_at string, ended_at string",
    "artifacts": "run_id string, artifact_key string, artifact_path string, manifest_path string, sha256 string, size_bytes bigint, content_type string, producer_command array<string>, config_hash string",
    "artifact_references": "run_id string, target_id string, reference_key string, name string, uri string, local_path string, declared_digest string, declared_size_bytes bigint, computed_digest string, digest_verified boolean, presence string, verification_note string",
    "targets": "run_id string, label string, target_kind string, status string",
    "actions": "run_id string, target_id string, action_key string, mnemonic string, status string",
    "cache_events": "run_id string, target_id string, action_id string, event_key string, event_kind string, hit boolean, digest string",
    "failures": "run_id string, failure_kind string, message string, span string",
    "graph_nodes": "run_id string, node_key string, node_kind string, label string, payload string",
    "graph_edges": "run_id string, from_node_id string, to_node_id string, from_node_key string, to_node_key string, edge_kind string, payload string",
    "proof_blocks": "run_id string, block_key string, block_kind string, title string, summary string, payload string",
}
_TYPES = {
    "string": StringType(), "int": IntegerType(), "bigint": LongType(), "boolean": BooleanType(), "array<string>": ArrayType(StringType()),
}


def _schema(own: str) -> StructType:
    """Built without a session, so UDF workers can import this module."""
    pairs = [part.split() for part in f"id string, stable_key string, {own}, {COMMON}".split(", ")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


SCHEMAS = {table: _schema(own) for table, own in OWN.items()}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the table's columns and types; an unknown column is an error."""
    schema = SCHEMAS[table]
    unknown = sorted(set(df.columns) - set(schema.names))
    if unknown:
        raise ValueError(f"unknown columns for {table}: {', '.join(unknown)}")
    cols = []
    for f in schema.fields:
        col = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name == "id":
            col = F.coalesce(col, stable_id(table, F.col("stable_key")))
        elif f.name in ("confidence", "redaction_state"):
            col = F.coalesce(col, F.lit("unknown"))
        elif f.name == "evidence_refs":
            col = F.coalesce(col, F.array().cast("array<string>"))
        cols.append(col.alias(f.name))
    return df.select(*cols)


def open_or_reason(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame] | None, str | None]:
    """The tables of a dataset, or why it cannot be read; never an empty result instead.

    ``missing``: no dataset there; ``empty``: its description has no row; ``incomplete``: a table of a known version is
    missing. Any other fault, as of permission or network, is raised.
    """
    try:
        meta = _meta(spark, root)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, "missing"
    if meta is None:
        return None, "empty"
    if meta.version is None:
        return None, "format"
    if meta.version != SCHEMA_VERSION:
        return None, f"schema_v{meta.version}"
    try:
        return {t: spark.read.schema(s).parquet(f"{_base(root, meta)}/{t}") for t, s in SCHEMAS.items()}, None
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, "incomplete"


_META = "version int, generation int, folder string"


def _meta(spark: SparkSession, root: str) -> Row | None:
    """The valid description of a dataset: that of the last generation."""
    rows = spark.read.schema(_META).json(f"{root}/_meta").orderBy(F.coalesce("generation", F.lit(0)).desc(), F.col("version").desc_nulls_last()).take(1)
    return rows[0] if rows else None


def _base(root: str, meta: Row | None) -> str:
    return f"{root}/{meta.folder}" if meta and meta.folder else root


def tables_root(spark: SparkSession, root: str) -> str:
    """The folder that holds the tables of the valid generation."""
    return _base(root, _meta(spark, root))


def commit_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """K5: all tables of a dataset replaced at once, in two phases; returns the folder of the new generation.

    Every table is written below a new folder first. One row appended to the description then makes it the valid one, so a stop at
    any point leaves the old tables or the new ones, never some of each. Older generations stay until they are removed by hand.
    """
    meta = _meta(spark, root)
    generation = (meta.generation or 0) + 1
    folder = f"_generation-{generation}-{uuid.uuid4().hex[:8]}"
    missing = sorted(set(SCHEMAS) - set(tables))
    if missing:
        raise ValueError(f"tables are missing: {', '.join(missing)}")
    for table in SCHEMAS:
        conform(tables[table], table).write.parquet(f"{root}/{folder}/{table}")
    spark.createDataFrame([(SCHEMA_VERSION, generation, folder)], _META).coalesce(1).write.mode("append").json(f"{root}/_meta")
    return f"{root}/{folder}"


def create(spark: SparkSession, root: str) -> None:
    """An empty dataset of the current version."""
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{table}")
    spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{root}/_meta")


def first_writes(df: DataFrame, order: list[str]) -> DataFrame:
    """The first row per stable key by arrival order, as one aggregate."""
    rest = [c for c in df.columns if c != "stable_key"]
    return df.groupBy("stable_key").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select("stable_key", "_r.*")


def new_rows(incoming: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to insert; keys already stored keep their first write."""
    return first_writes(incoming, order).join(existing.select("stable_key"), "stable_key", "left_anti")


def upsert(incoming: DataFrame, root: str, table: str, order: list[str] | None = None) -> Lookup:
    """Append what is new. ``order`` names extra arrival columns, dropped on write.

    What is stored is told by the table's key index: files that a batch reads don't grow with the table. One writer at a time.
    """
    spark = incoming.sparkSession
    order = order or ["created_at", "id"]
    extra = [c for c in order if c not in SCHEMAS[table].names]
    ready = conform(incoming.drop(*extra), table) if not extra else incoming
    index = KeyIndex(spark, tables_root(spark, root), table)
    version, generation = index.ready()
    found = index.lookup(first_writes(ready, order), version, generation)
    index.append(conform(found.fresh.drop(*extra), table), version, generation)
    return found


def finalize_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with status, end and refs of ``results`` (id, status, ended_at, evidence_refs, updated_at)."""
    names = ("status", "ended_at", "evidence_refs", "updated_at")
    new = results.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    joined = runs.join(new, "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in names}).select(*runs.columns)


def upgrade(spark: SparkSession, old_root: str, new_root: str) -> int:
    """A dataset of an older version written anew in the current one; rows are kept.

    Absent tables become empty ones, absent columns NULL. The new folder gets its
    version last, so a half-written one is never readable. A newer version is refused.
    """
    version = spark.read.schema("version int").json(f"{old_root}/_meta").take(1)[0].version
    if version > SCHEMA_VERSION:
        raise ValueError(f"dataset version {version} is newer than {SCHEMA_VERSION}")
    for table, schema in SCHEMAS.items():
        try:
            rows = conform(spark.read.parquet(f"{old_root}/{table}"), table)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = spark.createDataFrame([], schema)
        rows.write.mode("overwrite").parquet(f"{new_root}/{table}")
    spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{new_root}/_meta")
    return version


def write_projection(df: DataFrame, path: str, key: str = "run_group") -> None:
    """One JSON document with sorted keys per group, partitioned by a bucket of the group."""
    cols = sorted(c for c in df.columns)
    doc = F.to_json(F.struct(*cols))
    df.select(F.pmod(F.xxhash64(key), F.lit(256)).alias("bucket"), doc.alias("value")).write.mode("overwrite").partitionBy("bucket").text(path)


def write_mirror(scanned: DataFrame, root: str, out: str) -> DataFrame:
    """Redacted texts at their relative paths, and the counts per kind of what was skipped.

    ``scanned``: path, kind, redacted (from a scan of S9 rows).
    """
    rel = F.regexp_replace("path", "^(?:file:)?" + root.rstrip("/") + "/", "")
    scanned.where(F.col("kind").isin("text", "json")).select(rel.alias("rel_path"), F.col("redacted").alias("text")).write.mode("overwrite").parquet(out)
    return scanned.groupBy("kind").agg(F.count("*").alias("files")).withColumn("skipped", ~F.col("kind").isin("text", "json"))


def append_gc_event(report: DataFrame, path: str) -> None:
    """The append-only log of retention events."""
    report.write.mode("append").json(path)
