"""Cutting lineage in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Spark removes the shuffle files of a job when it ends, not when the driver's collector finds them
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# the temporary folder of each local application; the setting can't be changed once a session runs
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = tempfile.mkdtemp(prefix="run-")
    return _local[application]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and has no lineage behind it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a small derived table to the shared folder and read it back.

    Later stages start from files: lost executors recompute nothing upstream, and the size
    of the table is known to the planner when it chooses joins. The files replace the job's shuffles, which go.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)
