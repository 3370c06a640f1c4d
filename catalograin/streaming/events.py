"""Job events: ordered replay, latest snapshots, bounded buffers and rates, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUFFER = 500
RETIRE_MS = 10 * 60 * 1000


def replay_after(events: DataFrame, boot: str, last_id: Column) -> DataFrame:
    """Events newer than the last one seen. An id is `<boot>-<seq>`; one of another boot, of no boot or of the future replays all.

    events: (channel, seq, ...); the last sequence of each channel decides what is the future.
    """
    newest = F.max("seq").over(Window.partitionBy("channel"))
    seen = F.when(F.regexp_extract(last_id, r"^(.*)-\d+$", 1) == boot, F.regexp_extract(last_id, r"-(\d+)$", 1).try_cast("long"))
    return events.withColumn("newest", newest).where(F.coalesce((F.col("seq") > seen) | (seen > F.col("newest")), F.lit(True))).drop("newest")


def tail(events: DataFrame, size: int = BUFFER) -> DataFrame:
    """The last `size` events of each channel."""
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("seq")))
    return events.withColumn("r", place).where(F.col("r") <= size).drop("r")


def latest(events: DataFrame, *keys: str) -> DataFrame:
    """The newest event of each key, by seq; also as a streaming aggregation."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("e")).select(*keys, "e.*")


def rates(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """(start, user_id, n) per minute, for events with `ts`; late ones beyond the watermark are left out of streams. Not a feature of the searched system, but an aid for limits."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")


def _buffer(size: int, retire_ms: int, events: bool = False):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            held += list(zip(batch.seq.tolist(), batch.message.tolist(), strict=True))
            held = sorted(dict(held).items())[-size:] if isinstance(held[0], tuple) else held
        flat = [(int(s), str(m)) for s, m in held]
        state.update((flat,))
        state.setTimeoutDuration(retire_ms)
        if events:
            yield pd.DataFrame({"channel": [key[0]] * len(flat), "seq": [s for s, _ in flat], "message": [m for _, m in flat]})
            return
        yield pd.DataFrame({"channel": [key[0]], "n": [len(flat)], "first_seq": [flat[0][0] if flat else None], "last_seq": [flat[-1][0] if flat else None]})

    return run


def buffers(events: DataFrame, size: int = BUFFER, retire_ms: int = RETIRE_MS) -> DataFrame:
    """A stream's replay buffers: for each channel the extent of its last `size` events (channel, seq, message), dropped after `retire_ms` of silence."""
    return events.groupBy("channel").applyInPandasWithState(
        _buffer(size, retire_ms), "channel string, n long, first_seq long, last_seq long", "held array<struct<seq:long,message:string>>", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def held_events(events: DataFrame, size: int = BUFFER, retire_ms: int = RETIRE_MS) -> DataFrame:
    """A stream's replay buffers themselves: (channel, seq, message) of all events a channel holds, whenever it gets new ones, so that a reader can replay from a batch."""
    return events.groupBy("channel").applyInPandasWithState(
        _buffer(size, retire_ms, True), "channel string, seq long, message string", "held array<struct<seq:long,message:string>>", "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def subscribed(events: DataFrame, channels: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """What one subscriber gets: events of its channels and types (None: all)."""
    for column, wanted in (("channel", channels), ("type", types)):
        if wanted is not None:
            events = events.where(F.col(column).isin(wanted))
    return events


def retired(events: DataFrame, now: Column, quiet: str = "10 minutes") -> DataFrame:
    """(channel, last): channels whose newest event (`ts`) is older than `quiet`; a new event brings one back."""
    return events.groupBy("channel").agg(F.max("ts").alias("last")).where(F.col("last") <= now - F.expr(f"INTERVAL {quiet}"))
