import random
import time

from pyspark.sql import functions as F

from catalograin.operators import curation, ledger, navigation, products
from catalograin.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_split_and_reject(spark):
    aliases = spark.createDataFrame([("a1", "a"), ("a", "a"), ("b1", "b")], "identity string, canonical string")
    merged = curation.merge_canonical(aliases, spark.createDataFrame([("a", "b"), ("c", "c")], "source string, target string"))
    assert rows(merged) == [("a", "b"), ("a1", "b"), ("b", "b"), ("b1", "b")]
    assert rows(curation.split_identity(merged, spark.createDataFrame([("a1",), ("new",), ("a1",)], "identity string"))) == [("a", "b"), ("a1", "a1"), ("b", "b"), ("b1", "b"), ("new", "new")]
    told = curation.reject_pairs(spark.createDataFrame([("a", "b")], "a string, b string"), spark.createDataFrame([("b", "a"), ("z", "y"), ("q", "q"), ("y", "z")], "x string, y string"))
    assert rows(told) == [("a", "b"), ("y", "z")]


def test_checked_groups_and_their_order(spark):
    none = spark.createDataFrame([], "a string, b string")
    proposed = spark.createDataFrame(
        [(0, 0, 0, "mg zs", True, True), (0, 0, 1, "mg zs 80 kw", True, False), (0, 0, 2, "mg zs 82 kw", True, False), (0, 0, 3, "mg zs 110 kw", True, False), (0, 1, 0, "mg zs 110 kw", True, True), (1, 0, 0, "mg zs 2024", True, False), (1, 0, 1, "mg zs old", False, False)],
        "call int, grp int, pos int, name string, fresh boolean, first boolean",
    )
    got = rows(curation.checked_groups(proposed, spark.createDataFrame([("mg zs old", "mg zs")], "identity string, canonical string"), none))
    assert got == [("mg zs 2024", "mg zs"), ("mg zs 80 kw", "mg zs"), ("mg zs 82 kw", "mg zs")]
    assert rows(curation.checked_groups(proposed.limit(0), spark.createDataFrame([], "identity string, canonical string"), none)) == []


def test_next_control(spark):
    schema = "page_id int, here string, pos int, rel string, label string, cls string, href string, disabled boolean"
    here = "https://s.example/l?p=2"
    made = [
        (1, here, 0, "", "1", None, "https://s.example/l?p=1", False), (1, here, 1, None, "3", "page-next", "https://s.example/l?p=3#x", False), (2, here, 0, "prev", "Back", "", "https://s.example/l?p=1", False), (3, here, 0, "", "Next", "", "#", None),
        (4, here, 0, "next", "Next", "", "https://s.example/l?p=3", True), (5, here, 0, "", "a", "", "https://s.example/x", False), (5, here, 1, "", "b", "", "https://s.example/y", False),
    ]
    visited = spark.createDataFrame([(1, "https://s.example/l?p=1#top"), (2, "https://s.example/l?p=1")], "page_id int, url string")
    got = {r["page_id"]: (r["pos"], r["href"]) for r in navigation.next_control(spark.createDataFrame(made, schema), visited).collect()}
    assert got == {1: (1, "https://s.example/l?p=3#x"), 3: (0, None), 5: (0, "https://s.example/x")}


def test_floor_index_against_sorting(spark):
    rng = random.Random(4)
    groups = {"few": [3.0, 1.0, 2.0], "ties": [5.0] * 4000 + [1.0] * 10, "many": [rng.random() for _ in range(9000)], "one": [7.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "g string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        want = {g: sorted(vs)[min(len(vs) - 1, int(p * len(vs)))] for g, vs in groups.items()}
        assert {r["g"]: r["value"] for r in ledger.floor_index(df, "v", p, "g").collect()} == want
    assert ledger.floor_index(df.where("g = 'many'"), "v", 0.5).first()["value"] == sorted(groups["many"])[4500]


def test_other_listings_of_a_product(spark):
    items = spark.createDataFrame([(i, "p" if i < 6 else "q", 1 if i == 5 else None, i) for i in range(8)], "id long, identity string, gone_at long, indexed_at long")
    got = {}
    for r in products.same_product_listings(items, spark.createDataFrame([], "identity string, canonical string"), 2).collect():
        got.setdefault(r["id"], []).append((r["other"], r["total"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(3, 5), (4, 5)], 1: [(3, 5), (4, 5)], 2: [(3, 5), (4, 5)], 3: [(2, 5), (4, 5)], 4: [(2, 5), (3, 5)], 5: [(3, 5), (4, 5)], 6: [(7, 1)], 7: [(6, 1)]}


def test_held_events(spark, tmp_path):
    schema = "channel string, seq long, message string"
    for n in range(2):
        spark.createDataFrame([("c", 10 * n + k, f"m{n}{k}") for k in range(4)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = []
    query = events.held_events(stream, 3).writeStream.foreachBatch(lambda df, _: seen.append([r["seq"] for r in df.collect()])).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.monotonic() + 90
    while [11, 12, 13] not in seen and time.monotonic() < end:
        time.sleep(0.2)
    query.stop()
    assert [1, 2, 3] in seen and [11, 12, 13] in seen
    rows_ = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "channel string, seq long, type string")
    assert events.subscribed(rows_, ["a"]).count() == 1 and events.subscribed(rows_, None, ["z"]).count() == 0 and events.subscribed(rows_).count() == 2
    seen = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:15:00")], "channel string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["channel"] for r in events.retired(seen, F.lit("2024-01-01 00:20:00").cast("timestamp")).collect()] == ["a"]


def test_merged_products_where_nothing_merges(spark, tmp_path):
    """No alias at all, and one canonical name only: the pair is told as the query's SQL does."""
    from catalograin.more_queries import merged_products

    part = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    for names, want in ((["oak"] * 20, [(None, None)] * 2), (["oak", "fir", "elm"], [("b elm", "b oak")] + [("b oak", "b oak")] * 2)):
        keys = [10, 21, 20] if len(names) == 3 else range(20)
        table = [(k, {10: "oak", 20: "oak", 21: "elm"}.get(k, n) if len(names) == 3 else n, "b", "t", 1, 1.0) for k, n in zip(keys, names, strict=True)]
        folder = tmp_path / str(len(names))
        spark.createDataFrame(table, part).write.parquet(f"{folder}/part.parquet")
        got = [tuple(r) for r in merged_products(spark, str(folder)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
