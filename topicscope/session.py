"""Session helpers.

``get_session`` is for local runs (tests, bench, scripts).  On a cluster the
caller owns the session; library code only reads settings from it.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "topicscope", extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or int(cpus)
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.driver.memory", os.environ.get("TOPICSCOPE_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # remove reliable-checkpoint files once their DataFrame is unreferenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system).
    Only when it is unset -- local tests and benches -- a scratch folder is
    created and registered, so lineage cuts and stream checkpoints still
    work.
    """
    current = spark.conf.get(CHECKPOINT_KEY, None)
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set; a cluster needs a shared folder there")
    path = tempfile.mkdtemp(prefix="topicscope-ckpt-")
    spark.conf.set(CHECKPOINT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Queries started inside have these settings; those of before come back at the end."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_removed(spark: SparkSession):
    """The shuffle files of each query run inside are removed when it ends.  Otherwise they stay until the driver
    happens to collect its garbage, so that the steps of a job add up on the executors' disks."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


@contextmanager
def at_least_partitions(spark: SparkSession, n: int):
    """Queries started inside have ``n`` shuffle partitions or more.  A stream keeps the number that its checkpoint
    began with, for its state as well."""
    key = "spark.sql.shuffle.partitions"
    with settings(spark, {key: str(max(int(spark.conf.get(key)), n))}):
        yield
