"""Session settings, reliable checkpoints and scratch folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Settings that help at any size; everything else is left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "lotbook", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the defaults above; ``settings`` use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    named = {name.replace("__", "."): value for name, value in settings.items()}
    for name, value in {**DEFAULTS, **named}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a
    temporary folder; on a cluster the setting has to be there.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="lotbook-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table below the shared folder, in the folder of this application."""
    root = shared_dir(spark).rstrip("/")
    return f"{root}/scratch-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str = "stage", task_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as parquet and read it back, for results that are scanned several times.

    Unlike a checkpoint the table is columnar, so later scans prune columns and push filters down. ``task_rows``: no file has more
    rows, and a task reads two files at most, for readers to whom a row is many times as large as in a file. How files are
    put together is a setting of scans, so it is made in a session of its own over the same context.
    """
    path, reader = scratch_path(df.sparkSession, label), df.sparkSession
    writer = df.write.option("maxRecordsPerFile", task_rows) if task_rows else df.write
    writer.parquet(path)
    if task_rows:
        shuffles = reader.conf.get("spark.sql.shuffle.partitions")
        reader = reader.newSession()
        for name, value in {"shuffle.partitions": shuffles, "files.openCostInBytes": "4m", "files.maxPartitionBytes": "8m"}.items():
            reader.conf.set(f"spark.sql.{name}", value)
    return reader.read.schema(df.schema).parquet(path)
