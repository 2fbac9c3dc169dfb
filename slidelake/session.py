"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "slidelake", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local master may fall back to a temporary folder; a cluster may not,
    since other machines would not see it.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="slidelake-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing is created."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it back.

    The result survives the loss of executors, is computed once, and tells the
    planner its true size, so that joins with it are chosen well.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_to_buckets(df: DataFrame, *keys: str) -> DataFrame:
    """As ``cut_lineage``, in files by the hash of the ``keys``: joins and groupings by them leave the table where it lies.

    Rows are not shuffled for it; a task writes each bucket's rows to a file of their own, so it suits tables of few, large rows
    and those that their last step has dealt out by the same keys.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    return spark.table(name)


def rocksdb_state(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; streams started before keep the one in their checkpoint."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(setting, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def local_path(uri: str) -> str:
    """Path of a mounted file system without the ``file:`` scheme."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        raise ValueError(f"random access needs a mounted path, got {uri}")
    return os.path.abspath(uri)
