"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go away with the tables that use them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # no call-site capture per column expression: plans with many expressions build much faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "corpusaudit",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session. On a cluster leave ``master`` and the partition count to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the shared folder the cluster names.

    A local master without that setting (tests, laptop runs) gets a scratch folder; a cluster
    without it is refused, because a folder of one machine would be lost with that machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusaudit-", dir=os.environ.get("TMPDIR")))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, for tables a job writes and reads back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back: what is used several times is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_with_tasks(module: str) -> None:
    """Send a module's functions to the workers themselves, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
