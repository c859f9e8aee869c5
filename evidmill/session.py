"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "evidmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the UDF workers."""
    context = spark.sparkContext
    if getattr(context, "_evidmill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # A driver-side file: Spark copies it to every executor.
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="evidmill-"), "evidmill"), "zip", root, "evidmill")
    context.addPyFile(archive)
    context._evidmill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a local one is made in local mode (tests, a laptop); on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="evidmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/evidmill/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows that one step of a large job shuffles, and the most steps it is cut into.
STEP_ROWS = 1 << 24
MAX_STEPS = 8
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def steps_of(rows: int) -> range:
    """The steps of a job that shuffles ``rows`` rows."""
    return range(min(MAX_STEPS, 1 + rows // STEP_ROWS))


def in_step(df: DataFrame, name: str, step: int, steps: range) -> DataFrame:
    """The rows of ``df`` whose ``name`` belongs to a step; every row belongs to one."""
    return df if len(steps) == 1 else df.where(F.pmod(F.xxhash64(name), F.lit(len(steps))) == step)


def kept(parts: DataFrame | Iterable[DataFrame], name: str, apart: str | None = None) -> DataFrame:
    """``parts`` written one after another to the shared folder; the shuffle files of each are given up when it is written.

    Later steps read from the files, and only the columns they need. Rows that differ in ``apart`` lie in files of their own.
    """
    schema = None
    for part in [parts] if isinstance(parts, DataFrame) else parts:
        spark = part.sparkSession
        if schema is None:
            schema, path, before = part.schema, scratch_path(spark, name), spark.conf.get(_FREED)
        spark.conf.set(_FREED, "true")
        try:
            writer = part.write.mode("append").option("compression", "zstd")
            (writer.partitionBy(apart) if apart else writer).parquet(path)
        finally:
            spark.conf.set(_FREED, before)
    out = spark.read.schema(schema).parquet(path).select(*schema.names)
    out._kept_at = path
    return out


def give_up(df: DataFrame, below: str = "") -> None:
    """Remove the files of a ``kept`` DataFrame, or those in one folder of it, when nothing reads them any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at + below)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of a DataFrame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Hint a broadcast only when the size estimate is within ``limit``.

    Beyond it the join stays a shuffle join, which AQE may still split.
    """
    return F.broadcast(df) if size_in_bytes(df) <= limit else df
