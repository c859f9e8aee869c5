"""The evidence spine derived from the driver tables.

Scalar expressions are written once in the dialect that Spark SQL and DuckDB
share; ``Spine`` applies them as DataFrames, ``with_spine`` as a WITH clause.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidmill.session import ship_package

RUN = {
    "id": "o_orderkey",
    "stable_key": "concat('run:', CAST(o_orderkey AS STRING))",
    "run_group": "o_custkey",
    "scenario": "CASE o_orderpriority WHEN '1-URGENT' THEN 'cold-cache' WHEN '2-HIGH' THEN 'warm-cache' ELSE o_orderpriority END",
    "mode": "CASE WHEN o_orderkey % 5 = 0 THEN 'remote' ELSE 'local' END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END",
    "started_at": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate AS STRING) END",
    "created_at": "CAST(o_orderdate AS STRING)",
    "source_kind": "CASE o_orderkey % 5 WHEN 0 THEN 'collectable_v1' WHEN 1 THEN 'derived_v1' WHEN 2 THEN 'simulated_v1' WHEN 3 THEN 'future' ELSE NULL END",
    "confidence": "CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'high' END",
    "redaction_state": "CASE o_orderstatus WHEN 'F' THEN 'safe' WHEN 'O' THEN 'redacted' ELSE 'unknown' END",
}
LINE_QUAD = {
    "source_kind": "CASE l_linenumber % 4 WHEN 0 THEN 'collectable_v1' WHEN 1 THEN 'derived_v1' WHEN 2 THEN 'simulated_v1' ELSE NULL END",
    "confidence": "CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'medium' ELSE 'high' END",
    "redaction_state": "CASE WHEN l_linestatus = 'F' THEN 'safe' WHEN l_linenumber = 7 THEN 'blocked' WHEN l_linenumber = 6 THEN 'unknown' ELSE 'redacted' END",
}
LINE_KEY = (
    "concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':',"
    " CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING))"
)
CACHE = {
    "id": f"concat('cache:', {LINE_KEY})",
    "run_id": "l_orderkey",
    "target_id": "concat('target:', CAST(l_orderkey AS STRING), ':', CAST(l_partkey AS STRING))",
    "action_id": f"concat('action:', {LINE_KEY})",
    "event_kind": "CASE l_returnflag WHEN 'A' THEN 'remote_cache_hit' WHEN 'R' THEN 'cache_miss' ELSE 'action_cache_observed' END",
    "hit": "CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false ELSE NULL END",
    "created_at": "CAST(l_shipdate AS STRING)",
    **LINE_QUAD,
}
ACTION = {
    "id": f"concat('action:', {LINE_KEY})",
    "run_id": "l_orderkey",
    "target_id": "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('target:', CAST(l_orderkey AS STRING), ':', CAST(l_partkey AS STRING)) END",
    "mnemonic": "CASE l_linenumber % 3 WHEN 0 THEN 'CppCompile' WHEN 1 THEN 'Javac' ELSE 'BazelTest' END",
    "status": "CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'R' THEN 'FAILED' ELSE NULL END",
    "created_at": "CAST(l_shipdate AS STRING)",
    **LINE_QUAD,
}
FAILURE = {
    "id": f"concat('failure:', {LINE_KEY})",
    "run_id": "l_orderkey",
    "failure_kind": "CASE WHEN l_linenumber % 2 = 0 THEN 'target_completed' ELSE 'build_finished' END",
    "message": "concat('part ', CAST(l_partkey AS STRING), ' returned')",
    "created_at": "CAST(l_shipdate AS STRING)",
    **LINE_QUAD,
}
FAILURE_WHERE = "l_returnflag = 'R' AND l_linestatus = 'F'"
WORKER_WHERE = "l_linenumber = 7 AND l_suppkey % 5 = 0"
WORKER = {
    "run_id": "l_orderkey",
    "worker_name": "concat('worker-', CAST(l_suppkey % 16 AS STRING))",
    "line_number": "l_partkey",
}
CHANGE = {
    "id": "concat('change:', CAST(doc_id AS STRING))",
    "run_id": "doc_id % 200",
    "path": "concat('src/', source, '/f', CAST(doc_id AS STRING), '.py')",
    "before_text": "CASE WHEN doc_id % 7 IN (0, 1) THEN NULL ELSE text END",
    "after_text": "CASE WHEN doc_id % 7 IN (1, 2) THEN NULL WHEN doc_id % 7 = 3 THEN concat(text, '!') ELSE text END",
    "source_kind": "'collectable_v1'",
    "confidence": "CASE WHEN doc_id % 5 = 0 THEN 'medium' ELSE 'high' END",
    "redaction_state": "'safe'",
    "created_at": "CAST(doc_id AS STRING)",
}
EVENT = {
    "id": "event_id",
    "ts": "ts",
    "source": "concat('src', CAST(user_id % 4 AS STRING))",
    "kind": "CASE event_type WHEN 'view' THEN 'run' WHEN 'signup' THEN 'receipt' ELSE 'verdict' END",
    "run_group": "concat('user-', CAST(user_id AS STRING), CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-red' WHEN 2 THEN '-iter3' ELSE '-green-r2' END)",
    "next_action": "CASE event_type WHEN 'error' THEN 'dispatch_fix_with_evidence' WHEN 'purchase' THEN 'none_complete' WHEN 'click' THEN 'attach_missing_evidence' END",
    "status": "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'failed' WHEN 'view' THEN 'completed' END",
    "confidence": "CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END",
    "redaction_state": "CASE WHEN event_id % 50 = 0 THEN 'blocked' WHEN event_id % 9 = 0 THEN 'redacted' WHEN event_id % 11 = 0 THEN 'unknown' ELSE 'safe' END",
}


def _exprs(cols: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in cols.items()]


class Spine:
    """Lazy spine DataFrames over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").selectExpr(*_exprs(RUN))

    @cached_property
    def timed_runs(self) -> DataFrame:
        """Runs with ``ended_at``: the last ship date of the order."""
        ends = self.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
            F.max("l_shipdate").cast("string").alias("ended_at")
        )
        return self.runs.join(ends, "id", "left")

    @cached_property
    def cache_events(self) -> DataFrame:
        return self.lineitem.selectExpr(*_exprs(CACHE))

    @cached_property
    def actions(self) -> DataFrame:
        return self.lineitem.selectExpr(*_exprs(ACTION))

    @cached_property
    def failures(self) -> DataFrame:
        return self.lineitem.where(FAILURE_WHERE).selectExpr(*_exprs(FAILURE))

    @cached_property
    def targets(self) -> DataFrame:
        """One per (order, part); FAILED when any of its lines was returned."""
        lines = self.lineitem.groupBy("l_orderkey", "l_partkey").agg(
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("bad"),
            F.min("l_linenumber").alias("l_linenumber"),
            F.min("l_quantity").alias("l_quantity"),
            F.min("l_linestatus").alias("l_linestatus"),
            F.min("l_shipdate").cast("string").alias("created_at"),
        )
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        quad = [f"{LINE_QUAD[c]} AS {c}" for c in LINE_QUAD]
        return lines.join(part, "l_partkey", "left").selectExpr(
            "concat('target:', CAST(l_orderkey AS STRING), ':', CAST(l_partkey AS STRING)) AS id",
            "l_orderkey AS run_id",
            "concat('//', coalesce(p_brand, 'none'), ':', CAST(l_partkey AS STRING)) AS label",
            "CASE WHEN bad = 1 THEN 'FAILED' ELSE 'PASSED' END AS status",
            "created_at",
            *quad,
        )

    @cached_property
    def invocations(self) -> DataFrame:
        """One per (order, supplier); started with the order, ended with the last shipment."""
        lines = self.lineitem.groupBy("l_orderkey", "l_suppkey").agg(
            F.max("l_shipdate").cast("string").alias("ended_at"),
            F.max("l_linenumber").alias("l_linenumber"),
            F.max("l_quantity").alias("l_quantity"),
            F.max("l_linestatus").alias("l_linestatus"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("exit_code"),
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("string").alias("started_at")
        )
        return lines.join(orders, "l_orderkey").selectExpr(
            "concat('inv:', CAST(l_orderkey AS STRING), ':', CAST(l_suppkey AS STRING)) AS id",
            "l_orderkey AS run_id",
            "'bazel-build' AS invocation_kind",
            "explode(array(split(concat('bazel|build|//...|--remote_cache=grpc://cache', CAST(l_suppkey % 5 AS STRING), '.example:9092|',"
            " CASE WHEN l_suppkey % 3 = 0 THEN concat('--remote_executor=grpc://127.0.0.1:', CAST(50000 + l_suppkey % 7 AS STRING))"
            " WHEN l_suppkey % 3 = 1 THEN concat('--remote_executor|grpcs://exec', CAST(l_suppkey % 4 AS STRING), '.example:443|--remote_executor=grpc://user:pw@127.0.0.1:8980')"
            " ELSE '--config=ci' END), '[|]'))) AS command",  # a generator, so filters do not repeat the split
            "exit_code",
            "started_at",
            "ended_at",
            "started_at AS created_at",
            *[f"{LINE_QUAD[c]} AS {c}" for c in LINE_QUAD],
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        """One per document: its text is the content, its run is an order of the same number."""
        return self.table("documents").selectExpr(
            "concat('artifact:', CAST(doc_id AS STRING)) AS id",
            "doc_id AS run_id",
            "concat('logs/', source, '/', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.png' ELSE '.txt' END) AS artifact_key",
            "sha2(text, 256) AS sha256",
            "n_chars AS size_bytes",
            "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'collectable_v1' END AS source_kind",
            "CASE WHEN doc_id % 6 = 0 THEN 'low' ELSE 'high' END AS confidence",
            "CASE WHEN lang = 'en' THEN 'safe' ELSE 'redacted' END AS redaction_state",
            "CAST(doc_id AS STRING) AS created_at",
        )

    @cached_property
    def worker_events(self) -> DataFrame:
        """Worker identity lines of a run."""
        return self.lineitem.where(WORKER_WHERE).selectExpr(*_exprs(WORKER))

    @cached_property
    def agent_blocks(self) -> DataFrame:
        """One agent provenance block per conversation; its run has the same number."""
        user, bot = F.col("role") == "user", F.col("role") == "assistant"
        calls = self.table("conversations").groupBy("conv_id").agg(
            F.min_by("text", F.when(user, F.col("turn"))).alias("prompt"),
            F.max_by("text", F.when(bot, F.col("turn"))).alias("response"),
            F.count_if(bot).alias("turns"),
        )
        return calls.selectExpr(
            "concat('agent:', CAST(conv_id AS STRING)) AS id", "conv_id AS run_id",
            "'agent_provenance' AS block_kind",
            "concat('model-', CAST(conv_id % 3 AS STRING)) AS model",
            "sha2(coalesce(prompt, ''), 256) AS prompt_sha256", "sha2(response, 256) AS response_sha256", "turns",
            "CASE conv_id % 4 WHEN 0 THEN 'receipt_verified_v1' WHEN 1 THEN 'stub_receipt_v1'"
            " WHEN 2 THEN 'operator_asserted_v1' ELSE 'receipt_imported_v1' END AS provenance_class",
            "conv_id % 4 = 0 AS live",
            "CASE conv_id % 4 WHEN 1 THEN 'simulated_v1' ELSE 'collectable_v1' END AS source_kind",
            "CASE conv_id % 4 WHEN 3 THEN 'medium' ELSE 'high' END AS confidence",
            "CASE conv_id % 4 WHEN 3 THEN 'redacted' ELSE 'safe' END AS redaction_state",
            "CAST(conv_id AS STRING) AS created_at",
        )

    @cached_property
    def changes(self) -> DataFrame:
        """One changed path per document: hashes of its text, some edited, new or deleted."""
        return self.table("documents").selectExpr(*_exprs(CHANGE)).selectExpr(
            "id", "run_id", "path", "CASE WHEN before_text IS NOT NULL THEN sha2(before_text, 256) END AS before_hash",
            "CASE WHEN after_text IS NOT NULL THEN sha2(after_text, 256) END AS after_hash",
            "source_kind", "confidence", "redaction_state", "created_at")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").selectExpr(*_exprs(EVENT))


def _select(cols: dict[str, str], table: str, where: str | None = None) -> str:
    tail = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(_exprs(cols))} FROM {table}{tail}"


SQL = {
    "runs": _select(RUN, "orders"),
    "timed_runs": "SELECT r.*, e.ended_at FROM runs r LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS STRING) AS ended_at"
    " FROM lineitem GROUP BY 1) e ON e.l_orderkey = r.id",
    "cache_events": _select(CACHE, "lineitem"),
    "actions": _select(ACTION, "lineitem"),
    "failures": _select(FAILURE, "lineitem", FAILURE_WHERE),
    "targets": "SELECT concat('target:', l_orderkey, ':', l_partkey) AS id, l_orderkey AS run_id,"
    " concat('//', coalesce(p_brand, 'none'), ':', l_partkey) AS label,"
    " CASE WHEN bad = 1 THEN 'FAILED' ELSE 'PASSED' END AS status, created_at,"
    f" {', '.join(_exprs(LINE_QUAD))}"
    " FROM (SELECT l_orderkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bad,"
    " min(l_linenumber) AS l_linenumber, min(l_quantity) AS l_quantity, min(l_linestatus) AS l_linestatus,"
    " CAST(min(l_shipdate) AS STRING) AS created_at FROM lineitem GROUP BY 1, 2) x LEFT JOIN part ON p_partkey = l_partkey",
    "invocations": "SELECT concat('inv:', l_orderkey, ':', l_suppkey) AS id, l_orderkey AS run_id, l_suppkey,"
    " 'bazel-build' AS invocation_kind, exit_code,"
    " CAST(o_orderdate AS STRING) AS started_at, ended_at, CAST(o_orderdate AS STRING) AS created_at,"
    " concat('grpc://cache', l_suppkey % 5, '.example:9092') AS cache_endpoint,"
    " CASE l_suppkey % 3 WHEN 0 THEN concat('grpc://127.0.0.1:', 50000 + l_suppkey % 7)"
    " WHEN 1 THEN 'grpc://user:pw@127.0.0.1:8980' END AS endpoint,"
    " CASE l_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS endpoint_args,"
    f" {', '.join(_exprs(LINE_QUAD))}"
    " FROM (SELECT l_orderkey, l_suppkey, CAST(max(l_shipdate) AS STRING) AS ended_at, max(l_linenumber) AS l_linenumber,"
    " max(l_quantity) AS l_quantity, max(l_linestatus) AS l_linestatus,"
    " max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS exit_code FROM lineitem GROUP BY 1, 2) x"
    " JOIN orders ON o_orderkey = l_orderkey",
    "artifacts": "SELECT concat('artifact:', doc_id) AS id, doc_id AS run_id,"
    " concat('logs/', source, '/', doc_id, CASE doc_id % 3 WHEN 0 THEN '.json' WHEN 1 THEN '.png' ELSE '.txt' END) AS artifact_key,"
    " sha256(text) AS sha256, n_chars AS size_bytes,"
    " CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'collectable_v1' END AS source_kind,"
    " CASE WHEN doc_id % 6 = 0 THEN 'low' ELSE 'high' END AS confidence,"
    " CASE WHEN lang = 'en' THEN 'safe' ELSE 'redacted' END AS redaction_state, CAST(doc_id AS STRING) AS created_at FROM documents",
    "timeline": _select(EVENT, "events"),
    "worker_events": _select(WORKER, "lineitem", WORKER_WHERE),
    "agent_blocks": "SELECT concat('agent:', conv_id) AS id, conv_id AS run_id, concat('model-', conv_id % 3) AS model,"
    " sha256(coalesce(prompt, '')) AS prompt_sha256, sha256(response) AS response_sha256, turns, conv_id % 4 = 0 AS live,"
    " CASE conv_id % 4 WHEN 0 THEN 'receipt_verified_v1' WHEN 1 THEN 'stub_receipt_v1' WHEN 2 THEN 'operator_asserted_v1'"
    " ELSE 'receipt_imported_v1' END AS provenance_class,"
    " CASE conv_id % 4 WHEN 1 THEN 'simulated_v1' ELSE 'collectable_v1' END AS source_kind,"
    " CASE conv_id % 4 WHEN 3 THEN 'medium' ELSE 'high' END AS confidence,"
    " CASE conv_id % 4 WHEN 3 THEN 'redacted' ELSE 'safe' END AS redaction_state, CAST(conv_id AS STRING) AS created_at"
    " FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS prompt,"
    " arg_max(text, turn) FILTER (WHERE role = 'assistant') AS response,"
    " count(*) FILTER (WHERE role = 'assistant') AS turns FROM conversations GROUP BY 1) x",
    "changes": "SELECT id, run_id, path, sha256(before_text) AS before_hash, sha256(after_text) AS after_hash,"
    " source_kind, confidence, redaction_state, created_at FROM (" + _select(CHANGE, "documents") + ") x",
}
_NEEDS = {"timed_runs": ("runs",)}


def with_spine(*names: str, body: str) -> str:
    """A DuckDB statement: the named spine tables as CTEs, then ``body``."""
    order: list[str] = []
    for name in names:
        for dep in (*_NEEDS.get(name, ()), name):
            if dep not in order:
                order.append(dep)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    text = body.strip()
    head = text.upper()
    if head.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {text[15:]}"
    if head.startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}"
    return f"WITH {ctes} {text}"
