"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts travel in Arrow batches to the Python helpers; keep them small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # Push a semi-join filter into the large side of selective joins.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app: str = "proofloom", master: str | None = None, **extra: str) -> SparkSession:
    """Session with this package's defaults; cluster settings given outside win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to this package's default, if they are more.

    For jobs whose texts go through Python in sessions that others have built: a
    batch is held by the executor and by its worker, whole.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now, most = int(spark.conf.get(key, "10000")), int(SETTINGS[key])
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster.

    The folder is read from `spark.checkpoint.dir`. Only a local session
    (tests) may fall back to a temporary folder of the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="proofloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df, name: str):
    """Write an intermediate table to the shared folder and read it back.

    Used between the rounds of iterative jobs: the plan restarts from files
    that survive the loss of an executor.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys):
    """Hash rows over enough tasks for a step that costs far more time than bytes.

    The number is explicit: the adaptive planner sizes partitions by bytes and
    would put such a step into a few long tasks.
    """
    spark = df.sparkSession
    n = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)
