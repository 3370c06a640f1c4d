"""Tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a broadcast may hold, as its rows lie in memory; beyond, a join shuffles.
BROADCAST_BYTES = 64 << 20
_KEY = "spark.checkpoint.dir"
#: Spark's own setting: shuffle files go when an execution ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting: a batch for Python ends at so many bytes, not only after 10,000 rows, which long texts make tens of MB on both sides of each task.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; where that is unset and the master is one JVM, a temporary folder."""
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='catalograin-')}"
    spark.conf.set(_KEY, path)
    return path


def stored(df: DataFrame, tag: str, batch_bytes: int | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again, so lost executors cost no recomputation.

    The shuffle files of the write are not needed again and go with its end, so a chain of tables needs the disk of its largest step only.
    `batch_bytes` bounds the batches that the write's Python steps get; a row is never cut.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    settings = {_CLEANUP: "true"} | ({_BATCH: f"{batch_bytes}b"} if batch_bytes else {})
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bounds the batches for Python of this session's steps from now on; for an application whose steps return texts and are written by others."""
    spark.conf.set(_BATCH, f"{batch_bytes}b")


def small(df: DataFrame, size: int) -> DataFrame:
    """`df` marked for a broadcast if its measured `size` in bytes allows, else `df` itself."""
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
