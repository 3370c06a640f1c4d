import zlib

import numpy as np
import pytest

from catalograin.llm.sharding import kd_shards, shard_documents


def bounds(rows, shards):
    """Bytes by shard, and slots without gaps."""
    for s in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    return [sum(r["size"] for r in rows if r["shard"] == s) for s in range(shards)]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_near_equal_bytes(spark, shards):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.pareto(1.5) * 50 + i % 3) + str(i % 700), f"s{i % 4}", "en") for i in range(2000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), shards).collect()
    weights = bounds(got, shards)
    largest = max(len(r[1]) + 1 for r in rows) * 3
    assert len(got) == 2000 and max(weights) - min(weights) <= largest
    groups = {}
    for r in got:
        groups.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_a_large_group_stays_whole(spark):
    rows = [(i, "the same text again" if i % 3 == 0 else f"text {i}") for i in range(900)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len({r["shard"] for r in got if r["doc_id"] % 3 == 0}) == 1
    bounds(got, 4)


def test_equal_values_are_told_apart_by_hash(spark):
    groups = spark.createDataFrame([(100, float(i) / 1000, 1.0) for i in range(1000)], "bytes long, tie double, d double")
    assert sorted(r["n"] for r in kd_shards(groups, ["d"], 8).groupBy("shard").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == [125] * 8


def test_edges(edge_docs, no_docs):
    rows = shard_documents(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    bounds(rows, 8)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["size"] == 1 and by_id[1]["text_crc32"] == 0 and by_id[1]["shard"] == by_id[2]["shard"]
    assert by_id[6]["text_crc32"] == zlib.crc32("Ünïcödé wörds ünd 𝒳 more Ünïcödé wörds".encode())
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert shard_documents(no_docs).count() == 0
