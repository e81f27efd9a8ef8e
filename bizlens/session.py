"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a cluster deployment keeps; local runs only add the master.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only what the planner has measured below this size.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, *, app: str = "bizlens",
              shuffle_partitions: int | None = None,
              conf: dict[str, str] | None = None) -> SparkSession:
    """Build or fetch the session with the settings the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(_DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Only a session in one process (tests, laptops) without it gets a fresh
    scratch folder; ``local-cluster`` has executors of its own and must name one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    master = sc.master or ""
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; a cluster must name a shared folder")
    path = tempfile.mkdtemp(prefix="bizlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df, *, eager: bool = True):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def keep_rows(df):
    """Write ``df`` once as Parquet into the shared folder and read it back: rows of many joins
    that several passes read, in far fewer bytes than a checkpoint of them."""
    path = os.path.join(checkpoint_dir(df.sparkSession), "rows", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffle_tasks(spark: SparkSession, rows: int, *, rows_per_task: int = 500_000):
    """Run with a shuffle partition per ``rows_per_task`` of ``rows`` at least, then restore: what a
    task sorts and hashes does not grow with the table. Where these are more than the session's, AQE
    merges them to 16 MB only."""
    key, merged = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old, tasks = {k: spark.conf.get(k) for k in (key, merged)}, -(-rows // rows_per_task)
    if tasks > int(old[key]):
        spark.conf.set(key, str(tasks))
        spark.conf.set(merged, "16m")
    try:
        yield spark
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@contextmanager
def utc_session(spark: SparkSession):
    """Run with the session time zone at UTC (streams cast ``timestamp_ntz`` to
    ``timestamp`` for watermarks; this pins that conversion), then restore it."""
    key = "spark.sql.session.timeZone"
    old = spark.conf.get(key)
    spark.conf.set(key, "UTC")
    try:
        yield spark
    finally:
        spark.conf.set(key, old)
