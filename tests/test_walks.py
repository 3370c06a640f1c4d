import random
import time

import pytest
from pyspark.sql import functions as F

from catalograin.operators import facts, ingest
from catalograin.sources.items import items_of_parts
from catalograin.streaming import events, walks

EVENTS = "channel string, seq long, message string"


@pytest.fixture
def state_store(spark):
    for key, value in walks.STATE_STORE.items():
        spark.conf.set(key, value)
    yield
    for key in walks.STATE_STORE:
        spark.conf.unset(key)


def test_replay_buffers_survive_a_restart(spark, tmp_path, state_store):
    """What a stream holds after three runs from one checkpoint is the tail of all events; repeats change nothing."""
    rows = [("ab"[i % 3 == 0], i, f"m{i}") for i in range(40)]
    source, seen = str(tmp_path / "in"), {}

    def keep(batch, _):
        new = {}
        for r in batch.collect():
            new.setdefault(r["channel"], []).append((r["seq"], r["message"]))
        seen.update(new)

    until = lambda test: next((True for _ in range(600) if test() or time.sleep(0.1)), False)
    for part in (rows[:15], rows[10:16], rows[16:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = walks.replay_buffers(stream, size=6).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
        try:  # timers that wait keep such a query from ending by itself
            assert until(lambda last=part[-1][1]: any(last in [s for s, _ in v] for v in seen.values())), query.exception()
        finally:
            query.stop()
    tail = {}
    for r in events.tail(spark.createDataFrame(rows, EVENTS), 6).collect():
        tail.setdefault(r["channel"], []).append((r["seq"], r["message"]))
    assert {c: sorted(v) for c, v in seen.items()} == {c: sorted(v) for c, v in tail.items()}


def test_a_quiet_channel_retires_and_comes_back(spark, tmp_path, state_store):
    source, seen = str(tmp_path / "in"), []
    put = lambda *rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    put(("a", 1, "x"), ("a", 2, "y"))
    stream = walks.replay_buffers(spark.readStream.schema(EVENTS).parquet(source), 5, retire_ms=2_000)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.append([r["seq"] for r in df.collect()])).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    until = lambda test: next((True for _ in range(600) if test() or time.sleep(0.1)), False)
    try:
        assert until(lambda: [1, 2] in seen) and until(lambda: [None] in seen)
        put(("a", 3, "z"))
        assert until(lambda: [3] in seen), seen  # without what went
    finally:
        query.stop()


def _pieces(spark, sf="/root/testdata/sf0.001"):
    items = items_of_parts(spark, sf).where("id < 60")
    rows = items.unionByName(items.where("id % 4 = 0").withColumns({"title": F.concat(F.lit("again "), "title"), "gone_at": F.lit(None).cast(items.schema["gone_at"].dataType)}))
    return rows.withColumn("seq", F.when(F.col("title").startswith("again"), 1000 + F.col("id")).otherwise(F.col("id")))


def test_items_merged_as_they_come(spark, tmp_path):
    """In pieces, with one batch delivered twice, as in one go."""
    rows = _pieces(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "seq")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    walks.merge_into(one, schema)(rows, 0)
    merge = walks.merge_into(many, schema, buckets=8)
    pieces = [rows.where("seq < 20"), rows.where("seq BETWEEN 20 AND 1019"), rows.where("seq > 1019")]
    for number, piece in enumerate(pieces):
        merge(piece, number)
        if number == 1:
            merge(piece, number)
    merge(rows.limit(0), 3)
    told = lambda path: sorted(map(str, walks.stored_items(spark, path, schema).collect()))
    assert told(one) == told(many) and len(told(one)) == rows.select("collection_id", "url").distinct().count()
    assert walks.stored_items(spark, str(tmp_path / "none"), schema).count() == 0


def test_items_merged_from_a_stream(spark, tmp_path):
    rows = _pieces(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "seq")
    source, target = str(tmp_path / "in"), str(tmp_path / "items")
    for piece in ("seq < 30", "seq BETWEEN 30 AND 1019", "seq > 1019"):  # files are read in the order of their times
        rows.where(piece).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(walks.merge_into(target, schema, buckets=4)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    key = lambda df: {r["url"]: r["title"] for r in df.collect()}
    want = rows.groupBy("collection_id", "url").agg(F.max_by("title", "seq").alias("title"))
    assert key(walks.stored_items(spark, target, schema)) == key(want)


def test_lookups_are_asked_for_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i % 7}", ["x", "wide", "y"][i % 3], 1_700_000_000 + i) for i in range(60)], "identity string, key string, s long").selectExpr("identity", "key", "timestamp_seconds(s) AS ts")
    aliases = spark.createDataFrame([("n1", "n0"), ("n2", "n0"), ("n0", "n0")], "identity string, canonical string")
    alike = spark.createDataFrame([("x", "wide")], "key string, synonym string")
    want = {(r["canonical"], r["key"]) for r in facts.to_ask(rows, rows.limit(0), aliases, alike).collect()}
    assert {(r["canonical"], r["key"]) for r in walks.asked_once(rows, aliases, alike).collect()} == want
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = walks.asked_once(stream, aliases, alike).writeStream.foreachBatch(lambda df, _: seen.extend((r["canonical"], r["key"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None and sorted(seen) == sorted(want)


def test_accepted_versions_against_a_loop(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    visits = []
    for page in range(12):
        text = set(words[:20])
        for at in range(9):
            text = (text - set(rng.sample(words, rng.choice([0, 1, 3]))) | set(rng.sample(words, rng.choice([0, 2])))) or {"w0"}
            shown = lambda t, share: sorted(w for w in t if rng.random() >= share)
            visits.append((page, at, 0, shown(text, rng.choice([0, 0, 0.15, 0.6]))))
            if rng.random() < 0.6:
                visits.append((page, at, 1, shown(text, rng.choice([0, 0.2, 0.7]))))
    want, known = [], {}
    missing = lambda old, new: len(set(old) - set(new)) / len(old) if old else 0.0
    for page, at in sorted({v[:2] for v in visits}):
        loads = [v[3] for v in sorted(visits) if v[:2] == (page, at)]
        if page not in known:
            known[page] = loads[0]
            want.append((page, at, 1, 0.0, "first"))
            continue
        load, tries = loads[0], 1
        if missing(known[page], load) > 0.1 and len(loads) > 1:
            tries = 2
            load = min(loads, key=lambda t: missing(known[page], t))
        share = missing(known[page], load)
        verdict = "reject" if share > 0.3 else "same" if load == known[page] else "changed"
        want.append((page, at, tries, share, verdict))
        known[page] = known[page] if verdict == "reject" else load
    got = ingest.accepted_versions(spark.createDataFrame(visits, "page long, at long, attempt int, tokens array<string>")).collect()
    assert sorted((r[0], r[1], r[2], round(r[3], 9), r[4]) for r in got) == sorted((*w[:3], round(w[3], 9), w[4]) for w in want)
    assert {w[4] for w in want} == {"first", "reject", "same", "changed"}
