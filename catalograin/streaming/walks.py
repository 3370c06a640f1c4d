"""Streams around walks: replay buffers with timers, items merged as they are extracted, lookups that are asked for once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ingest import upsert
from .events import BUFFER, RETIRE_MS

#: Replay buffers need a state store that keeps maps and timers.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
BUCKETS = 64


class ReplayBuffer(StatefulProcessor):
    """The last `size` events of a channel as a map from number to message: an event touches its own entry and those it pushes out, not the whole buffer.

    Each batch with events moves the channel's timer; when it fires after `retire_ms` of silence, the channel's state goes. A later event starts it anew.
    """

    def __init__(self, size: int = BUFFER, retire_ms: int = RETIRE_MS):
        self.size, self.retire_ms = size, retire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "seq long", "message string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for seq, message in zip(batch.seq.tolist(), batch.message.tolist(), strict=True):
                self.held.updateValue((seq,), (message,))
        seqs = sorted(k[0] for k in self.held.keys())
        for seq in seqs[: -self.size]:
            self.held.removeKey((seq,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retire_ms)
        kept = seqs[-self.size :]
        yield pd.DataFrame({"channel": [key[0]] * len(kept), "seq": kept, "message": [self.held.getValue((s,))[0] for s in kept]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"channel": [key[0]], "seq": [None], "message": [None]}).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def replay_buffers(events: DataFrame, size: int = BUFFER, retire_ms: int = RETIRE_MS) -> DataFrame:
    """(channel, seq, message) of all events that a channel of a stream holds, whenever it gets new ones; one row without seq when it retires.

    events: (channel, seq, message). The session needs STATE_STORE. An event that comes twice is held once.
    """
    return events.select("channel", "seq", "message").groupBy("channel").transformWithStateInPandas(
        statefulProcessor=ReplayBuffer(size, retire_ms), outputStructType="channel string, seq long, message string", outputMode="Update", timeMode="processingTime"
    )


# Items as they are extracted ----------------------------------------------------------------------------------------------------------------


def _bucketed(items: DataFrame, buckets: int) -> DataFrame:
    return items.withColumn("bucket", F.pmod(F.xxhash64("collection_id", "url"), F.lit(buckets)).cast("int"))


def stored_items(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Items at `path` after all batches, or those before one: of each bucket what its last batch wrote."""
    empty = spark.createDataFrame([], f"{schema}, bucket int, batch long")
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return empty.drop("bucket", "batch")
    rows = spark.read.schema(empty.schema).parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))  # a row a bucket
    return rows.join(F.broadcast(last), ["bucket", "batch"], "left_semi").drop("bucket", "batch")


def merge_into(path: str, schema: str, order: str = "seq", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For `writeStream.foreachBatch`: merges each batch of items into the table at `path` by `ingest.upsert`.

    Only buckets with new items are written, under the batch's number, from what the batches before left. A batch that comes again after a failure finds
    the same and writes the same, in place of what it wrote. Of several versions of an item in a batch the last by `order` counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("collection_id", "url").agg(F.max_by(F.struct(*(c for c in batch.columns if c not in ("collection_id", "url", order))), order).alias("i"))
        new = _bucketed(newest.select("collection_id", "url", "i.*"), buckets).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
            if not touched:
                return
            old = _bucketed(stored_items(spark, path, schema, number), buckets).where(F.col("bucket").isin(touched)).drop("bucket")
            merged = _bucketed(upsert(old, new.drop("bucket")), buckets).withColumn("batch", F.lit(number).cast("long"))
            merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
        finally:
            new.unpersist()

    return run


# Lookups --------------------------------------------------------------------------------------------------------------------------------------


def asked_once(requests: DataFrame, aliases: DataFrame, synonyms: DataFrame, within: str = "10 minutes") -> DataFrame:
    """`requests(identity, key, ts)` as (canonical, key, ts), each product and key once while its lookup is under way, which is as long as `within` says.

    aliases: (identity, canonical); synonyms: (key, synonym), a key standing for its synonyms. On a stream what was asked is forgotten when the
    watermark has passed, so state ends; on a table it is asked for once at all.
    """
    own = synonyms.select(F.col("synonym").alias("key"), F.col("key").alias("own"))
    rows = requests.withWatermark("ts", within) if requests.isStreaming else requests
    named = rows.join(aliases, "identity", "left").join(own, "key", "left").select(F.coalesce("canonical", "identity").alias("canonical"), F.coalesce("own", "key").alias("key"), "ts")
    if named.isStreaming:
        return named.dropDuplicatesWithinWatermark(["canonical", "key"])
    return named.groupBy("canonical", "key").agg(F.min("ts").alias("ts"))
