"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "catalograin", **extra: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; `extra` keys use `__` for `.`."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session, sure to have a checkpoint folder: the cluster's `spark.checkpoint.dir`, or where that is unset and all runs in one JVM a temporary one."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="catalograin-")
        spark.sparkContext.setCheckpointDir(path)
    return spark


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet below the checkpoint folder and read again: its lineage is cut, and small files are read together, so that the
    number of partitions does not grow from round to round. Shuffle files go with the end of the write."""
    spark = with_checkpoints(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)
