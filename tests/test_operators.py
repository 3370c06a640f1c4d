import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from catalograin.operators import facts, ingest, keys, ledger, products
from catalograin.session import with_checkpoints
from catalograin.sources import html, portable
from catalograin.sources.items import ITEM, bag_from_json
from catalograin.streaming import events

SAME = [("opel mokka 1.2 at", "opel mokka 1.2 turbo at 2023"), ("bmw x3 100 kw", "bmw x3 136hp"), ("citroën c3", "citroen c3"), ("mg zs+", "mg zs plus")]
OTHER = [("opel mokka 1.2 2022", "opel mokka 1.4 2022"), ("ford puma st", "ford puma titanium"), ("ford focus tdi", "ford focus tsi"), ("bmw x3 100kw", "bmw x3 140kw"), ("mg hs phev", "mg hs hybrid"), ("mg zs", "kg zs")]
MAYBE = [("opel mokka 2023", "opel mokka gs line 2023"), ("bmw x3", "bmw x3 competition 2021")]


@pytest.fixture(scope="module")
def features(spark):
    names = sorted({n for pair in SAME + OTHER + MAYBE for n in pair})
    return products.with_features(spark.createDataFrame([(n,) for n in names], "identity string")).cache()


def test_pair_rules(features):
    same = {frozenset(r) for r in products.same_pairs(features).collect()}
    maybe = {tuple(r) for r in products.maybe_pairs(features).collect()}
    assert {frozenset(p) for p in SAME} <= same and not {frozenset(p) for p in OTHER + MAYBE} & same
    assert set(MAYBE) <= maybe and not {frozenset(p) for p in OTHER + SAME} & {frozenset(p) for p in maybe}


def test_groups_are_complete_linkage(spark):
    names = ["vw golf", "vw golf 85 kw", "vw golf 110 kw", "vw golf 115 hp 2024", "kia ceed", "kia ceed 2023", "kia ceed 2024"]
    rows = spark.createDataFrame([(n,) for n in names * 2], "identity string")
    got = {r["identity"]: r["canonical"] for r in products.regroup(rows).collect()}
    assert len(got) == 7 and got["vw golf 85 kw"] == got["vw golf 115 hp 2024"] != got["vw golf 110 kw"]
    assert got["kia ceed 2023"] != got["kia ceed 2024"] and got["kia ceed"] == got["kia ceed 2023"]
    told = products.regroup(rows, spark.createDataFrame([("kia ceed 2023", "kia ceed")], "a string, b string"))
    got = {r["identity"]: r["canonical"] for r in told.collect()}
    assert got["kia ceed"] == "kia ceed 2024"


def first_fit(names, rejected=frozenset()):
    """Names like `brand words... [year] [n kw]`, one at a time from the most specific."""

    def parts(name):
        brand, *rest = name.split()
        years = sorted({w for w in rest if w.isdigit() and len(w) == 4})
        power = [float(w[:-2]) for w in rest if w.endswith("kw")]
        return brand, tuple(sorted({w for w in rest if w not in years and not w.endswith("kw")})), years, power

    def fits(a, b):
        (ba, wa, ya, pa), (bb, wb, yb, pb) = parts(a), parts(b)
        near = lambda x, y: all(any(abs(p - q) <= 0.04 * max(p, q) for q in y) for p in x)
        return ba == bb and wa == wb and not (ya and yb and ya != yb) and (not pa or not pb or near(pa, pb) and near(pb, pa)) and frozenset((a, b)) not in rejected

    def order(name):
        _, words, years, power = parts(name)
        return -(len(words) + len(years) + len(power)), -len(name), name

    groups, out = [], {}
    for name in sorted(set(names), key=order):
        home = next((g for g in groups if all(fits(name, other) for other in g)), None)
        if home is None:
            groups.append(home := [])
        home.append(name)
        out[name] = home[0]
    return out


@pytest.mark.parametrize("step", [256, 7])
def test_groups_of_one_brand_and_words_against_one_at_a_time(spark, step):
    rng = random.Random(step)
    names = [f"oak desk tall{' ' + str(rng.randint(2001, 2012)) * 1 if rng.random() < 0.7 else ''}{f' {rng.randint(50, 79)}kw' if rng.random() < 0.8 else ''}" for _ in range(2000)]
    spelt = lambda n: " ".join([n.split()[0], *rng.sample(n.split()[1:], len(n.split()) - 1)])
    names = list({spelt(n) for n in names if len(n.split()) > 3 or rng.random() < 0.1})[: 2000 if step == 256 else 120]
    pairs = [tuple(rng.sample(names, 2)) for _ in range(60)]
    rows = spark.createDataFrame([(n,) for n in names], "identity string")
    got = {r["identity"]: r["canonical"] for r in products.regroup(rows, spark.createDataFrame(pairs, "a string, b string"), step=step).collect()}
    assert got == first_fit(names, {frozenset(p) for p in pairs})


def test_groups_of_nothing(spark):
    rows = spark.createDataFrame([("",), ("  ",), ("x",)], "identity string")
    assert {tuple(r) for r in products.regroup(rows).collect()} == {("", ""), ("  ", "  "), ("x", "x")}
    assert products.regroup(rows.limit(0)).count() == 0


def test_flat_aliases(spark):
    chain = [(f"n{i}", f"n{i + 1}", i) for i in range(1000)]
    circle = [("a", "b", 1), ("b", "c", 3), ("c", "a", 2), ("tail", "a", 9), ("x", "x", 1), ("y", "z", 1), ("z", "y", 1), ("again", "n5", 1), ("again", "b", 2), (None, "q", 1), ("q", None, 1)]
    got = {r["alias"]: r["key"] for r in keys.flat_aliases(spark.createDataFrame(chain + circle, "alias string, canonical string, ordinal int")).collect()}
    # the last pair of a circle is refused, so its alias is a key
    want = {f"n{i}": "n1000" for i in range(1001)} | {k: "b" for k in ("a", "b", "c", "tail", "again")} | {"y": "y", "z": "y"}
    assert got == want
    assert keys.flat_aliases(spark.createDataFrame([], "alias string, canonical string, ordinal int")).count() == 0


def test_flat_aliases_against_following_them(spark, monkeypatch):
    """Random pairs with many circles, tails with names that are less than any in their circle, and equal ordinals; circles join by a shuffle too."""
    rng = random.Random(3)
    rows = [(f"n{i:03}", f"n{i // 40 * 40 + rng.randrange(40):03}", rng.randrange(9)) for i in range(400) if i % 90 < 80]
    up, order = {a: b for a, b, _ in rows if a != b}, {a: n for a, _, n in rows}
    want = {}
    for name in {n for pair in up.items() for n in pair}:
        seen = []
        at = name
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        want[name] = min(seen[seen.index(at) :], key=lambda n: (-order[n], n)) if at in seen else at
    assert len({k for k in want.values() if k in up}) > 1
    df = spark.createDataFrame(rows, "alias string, canonical string, ordinal int")
    for most in (50_000, 0):
        monkeypatch.setattr(keys, "MOST_BROADCAST", most)
        assert {r["alias"]: r["key"] for r in keys.flat_aliases(df).collect()} == want


def test_flat_aliases_take_rounds_by_the_longest_circle(spark, monkeypatch):
    """Many short circles take few rounds, and no join is broadcast."""
    made = []
    monkeypatch.setattr(keys, "written", lambda df: made.append(df) or with_checkpoints(spark) and df.localCheckpoint())
    rows = [(f"c{i}.{k}", f"c{i}.{(k + 1) % 4}", k) for i in range(500) for k in range(4)]
    got = {r["alias"]: r["key"] for r in keys.flat_aliases(spark.createDataFrame(rows, "alias string, canonical string, ordinal int")).collect()}
    assert got == {a: f"{a.split('.')[0]}.3" for a, _, _ in rows} and len(made) <= 5


def test_suggestions_and_single_candidates(spark):
    with_checkpoints(spark)
    items = spark.createDataFrame([("vw golf",), ("vw golf style",), ("vw golf style",), ("vw golf life",), ("kia rio",), ("kia rio max",)], "identity string")
    none = spark.createDataFrame([], "identity string, canonical string")
    got = {r["identity"]: r["candidates"] for r in products.suggestions(items, none).collect()}
    assert got == {"vw golf": ["vw golf style", "vw golf life"], "kia rio": ["kia rio max"]}
    told = spark.createDataFrame([("kia rio max", "kia rio")], "a string, b string")
    assert {r["identity"] for r in products.suggestions(items, none, told).collect()} == {"vw golf"}
    assert {(r["identity"], r["canonical"]) for r in products.auto_confirm(items, none).collect()} == {("kia rio", "kia rio max")}


def test_attribute_names(spark):
    pairs = [("shelf_cm", "shelf_size_mm", True), ("luggage_volume_l", "cargo_capacity_liters", True), ("manual_blinds", "electric_blinds", False), ("drawers", "drawer_count", True), ("side_panel", "panel", False), ("capacity", "l", False)]
    rows = spark.createDataFrame(pairs, "a string, b string, want boolean").withColumn("got", products.names_related(F.col("a"), F.col("b")))
    assert [r["got"] for r in rows.collect()] == [p[2] for p in pairs]
    exact = spark.createDataFrame([("digital_wall_clock", "wall_clock")], "a string, b string")
    assert not exact.select(products.names_related(F.col("a"), F.col("b"), F.lit(True))).first()[0]


def make(spark, rows):
    return spark.createDataFrame([(i, 1, url, f"T{i}", None, None, None, identity, i, gone, specs) for i, url, identity, gone, specs in rows], ITEM)


def num(x):
    return (float(x), None, None)


def test_key_merges(spark):
    items = make(spark, [(1, "a", None, None, {"hp": num(100), "x": num(1)}), (2, "b", None, None, {"hp": num(100), "kw": num(70)}), (3, "c", None, None, {"x": num(2)})])
    merges = spark.createDataFrame([("hp", "kw", 0.7355)], "from_key string, to_key string, factor double")
    bags = lambda df: {r["id"]: {k: v["num"] for k, v in r["specs"].items()} for r in df.collect()}
    once = keys.apply_merges(items, merges)
    assert bags(once) == {1: {"kw": 73.6, "x": 1}, 2: {"kw": 70}, 3: {"x": 2}} and bags(keys.apply_merges(once, merges)) == bags(once)
    assert bags(keys.apply_merges(items, merges.limit(0))) == bags(items)


def test_registry(spark):
    schema = "collection_id long, key string, type string, unit string, label string, example string, count long, origin string"
    old = spark.createDataFrame([(1, "kw", "number", None, "Power", None, 2, "web")], schema)
    new = spark.createDataFrame([(1, "kw", "string", "kW", "Leistung", "85", 3, "page"), (2, "kw", "string", None, "P", None, 1, "web")], schema)
    got = {r["collection_id"]: tuple(r)[2:] for r in keys.upsert(old, new).collect()}
    assert got == {1: ("number", "kW", "Power", "85", 5, "page"), 2: ("string", None, "P", None, 1, "web")}
    assert keys.merged(keys.upsert(old, new)).first()["conflict"]


def test_bag_from_json(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 2.5, "c": true, "d": "x", "e": null, "f": [1]}',), (None,), ("{bad",)], "j string").select(bag_from_json(F.col("j")).alias("s")).collect()
    assert {k: tuple(v) for k, v in rows[0]["s"].items()} == {"a": (1.0, None, None), "b": (2.5, None, None), "c": (None, True, None), "d": (None, None, "x")}
    assert rows[1]["s"] is None


def test_fill_and_accept(spark):
    value = "struct<num:double,flag:boolean,txt:string>"
    items = make(spark, [(1, "a", "p", None, {"x": num(1)}), (2, "b", "q", None, {}), (3, "c", "r", None, None)])
    cache = spark.createDataFrame([("p", "x", num(9), True), ("p", "y", num(2), True), ("q", "y", None, False)], f"identity string, key string, value {value}, found boolean")
    got = {r["id"]: ({k: v["num"] for k, v in r["specs"].items()}, r["need"]) for r in facts.fill(items, cache, ["x", "y"]).collect()}
    assert got == {1: ({"x": 1.0, "y": 2.0}, []), 2: ({}, ["x"]), 3: ({}, ["x", "y"])}
    again = [("p", "y", num(3), True), ("p", "y", None, False), ("q", "wide", num(7), True), ("q", "x", None, False), ("r", "wide", num(1), True), ("r", "x", num(8), True)]
    alike = spark.createDataFrame([("x", "wide"), ("y", "tall"), ("z", "deep")], "key string, synonym string")
    wide = make(spark, [(4, "d", "q", None, {"tall": num(1)}), (5, "e", "r", None, {"wide": num(2)})])
    rows = facts.fill(items.unionByName(wide), cache.unionByName(spark.createDataFrame(again, cache.schema)), ["x", "y"], alike).collect()
    assert {r["id"]: ({k: v["num"] for k, v in r["specs"].items()}, r["need"]) for r in rows} == {1: ({"x": 1.0, "y": 2.0}, []), 2: ({"x": 7.0}, []), 3: ({"x": 8.0}, ["y"]), 4: ({"tall": 1.0, "x": 7.0}, []), 5: ({"wide": 2.0}, ["y"])}
    answers = spark.createDataFrame([("p", "a", "v", 0.9, True, True), ("p", "b", "v", 0.9, False, True), ("p", "c", "v", 0.5, True, True), ("p", "d", "v", 0.5, True, False), ("p", "e", "v", 0.7, True, False)], "identity string, key string, value string, confidence double, source_brand_ok boolean, asked boolean")
    got = {r["key"]: (r["value"], r["confidence"], r["found"]) for r in facts.accepted(answers).collect()}
    assert got == {"a": ("v", 0.9, True), "b": (None, 0.3, False), "c": (None, 0.5, False), "e": ("v", 0.7, True)}


def test_fact_age(spark):
    rows = spark.createDataFrame([("a", True, dt.datetime(2020, 1, 1)), ("b", False, dt.datetime(2020, 1, 1)), ("c", False, dt.datetime(2026, 1, 1))], "identity string, found boolean, fetched_at timestamp")
    now = F.lit("2026-01-10").cast("timestamp")
    assert sorted(r["identity"] for r in facts.usable(rows, now).collect()) == ["a", "c"] and facts.usable(rows, now, 0).count() == 3


def test_upsert_is_idempotent(spark):
    old = make(spark, [(1, "a", "p", 5, {"x": num(1), "web": num(2)}), (2, "b", None, None, {"y": num(1)})])
    new = make(spark, [(9, "a", "p2", None, {"x": num(3)}), (10, "c", None, None, {})])
    web = spark.createDataFrame([(1, "a", "web"), (1, "a", "x")], "collection_id long, url string, key string")
    state = lambda df: {r["url"]: (r["id"], r["identity"], r["gone_at"], {k: v["num"] for k, v in r["specs"].items()}) for r in df.collect()}
    once = ingest.upsert(old, new, web)
    assert state(once) == {"a": (1, "p2", None, {"x": 3.0, "web": 2.0}), "b": (2, None, None, {"y": 1.0}), "c": (10, None, None, {})}
    assert state(ingest.upsert(once, new, web)) == state(once)


def test_gone_safety(spark):
    items = make(spark, [(i, str(i), None, None, {}) for i in range(6)])
    gone = lambda seen, **k: sorted(r["id"] for r in ingest.mark_gone(items, items.where(seen), 7, **k).where("gone_at IS NOT NULL").collect())
    assert gone("id < 4") == [4, 5] and gone("id < 2") == [] and gone("id < 4", complete=False) == []


def test_walks(spark):
    rows = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 0, 9), (1, 2, 0, 9), (1, 3, 4, 9), (2, 0, 5, 9), (2, 1, 5, 9), (3, 0, 5, 9), (3, 1, 0, 0)], "walk_id long, page long, new_items long, items long")
    assert {r["walk_id"]: (r["last_page"], r["complete"]) for r in ingest.walk_end(rows).collect()} == {1: (2, True), 2: (1, False), 3: (1, True)}
    tuples = spark.createDataFrame([(1, "a", 0, "x"), (1, "b", 1, "y"), (1, "a", 2, "z")], "id long, key string, ordinal int, value string")
    assert {(r["key"], r["value"], r["place"]) for r in ingest.last_wins(tuples, "id").collect()} == {("a", "z", 0), ("b", "y", 1)}


def test_costs_and_knees(spark):
    used = spark.createDataFrame([("p", "m", 1000, 100, 10), ("p", "models/m:free", 1000, 0, 0), ("p", "other", 1, 1, 1)], "provider string, model string, prompt_tokens long, cached_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("p", "m", 1.0, 4.0, 0.5, None)], "provider string, model string, input double, output double, cache_read double, cache_write double")
    assert sorted((r["estimate"] or 0) for r in ledger.with_cost(used, prices).collect()) == pytest.approx([0, (900 + 50 + 40) / 1e6, 1000 / 1e6])
    steps = spark.createDataFrame([(1, 1, 10.0, 0), (1, 2, 19.5, 0), (1, 3, 20.0, 0), (2, 1, 9.0, 1)], "run_id int, tabs int, pages_per_min double, errors int")
    assert {r["run_id"]: r["knee"] for r in ledger.knee(steps).collect()} == {1: 2, 2: None}


def test_replay(spark):
    rows = spark.createDataFrame([("a", i, "job", f"m{i}") for i in range(5)], "channel string, seq long, type string, message string")
    seqs = lambda last: sorted(r["seq"] for r in events.replay_after(rows, "b1", F.lit(last)).collect())
    assert seqs("b1-2") == [3, 4] and seqs("b1-4") == [] and seqs("b0-2") == seqs("2") == seqs("b1-9") == [0, 1, 2, 3, 4]
    assert events.latest(rows, "channel").first()["message"] == "m4" and events.tail(rows, 2).count() == 2


def test_streams(spark, tmp_path):
    schema = "channel string, seq long, type string, message string"
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("a", i, "job", f"m{i}") for i in range(9)] + [("b", 1, "job", "x")], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    def run(until):
        """A stream with time-outs never ends by itself: it is stopped when the rows are there."""
        query = events.buffers(stream, 4).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", state).start()
        end = time.monotonic() + 60
        while not until <= set(seen) and time.monotonic() < end:
            time.sleep(0.2)
        query.stop()

    seen = []
    run({("a", 4, 5, 8), ("b", 1, 1, 1)})
    spark.createDataFrame([("a", i, "job", f"m{i}") for i in range(9, 11)], schema).coalesce(1).write.mode("append").parquet(source)
    run({("a", 4, 7, 10)})
    assert set(seen) == {("a", 4, 5, 8), ("b", 1, 1, 1), ("a", 4, 7, 10)}
    query = events.latest(stream, "channel").writeStream.format("memory").queryName("newest").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["channel"], r["seq"]) for r in spark.table("newest").collect()} == {("a", 10), ("b", 1)}


def test_export_and_import(spark, tmp_path):
    items = make(spark, [(1, "https://a/1", "p", None, {"x": num(1), "f": (None, True, None), "t": (None, None, "é")}), (2, "https://a/1", None, None, {}), (3, "javascript:x", None, None, {})])
    collections = spark.createDataFrame([(1, "Cars")], "collection_id long, name string")
    registry = spark.createDataFrame([(1, "x", "number", None, "X", None, "page")], "collection_id long, key string, type string, unit string, label string, example string, origin string")
    aliases = spark.createDataFrame([("p", "root"), ("p2", "root"), ("q", "other")], "identity string, canonical string")
    cache = spark.createDataFrame([(n, "k", num(1), 0.9, True) for n in ("p", "p2", "root", "q")], "identity string, key string, value struct<num:double,flag:boolean,txt:string>, confidence double, found boolean")
    path = str(tmp_path / "out")
    portable.write(portable.documents(collections, items, registry, aliases, cache), path)
    docs = portable.read(spark, path)
    row = docs.first()
    assert {a["identity"] for a in row["aliases"]} == {"p", "p2"} and {f["identity"] for f in row["facts"]} == {"p", "p2", "root"}
    assert portable.import_names(docs, collections).first()["name"] == "Cars (imported)"
    back = portable.imported_items(docs, F.lit(0)).collect()
    assert len(back) == 1 and back[0]["indexed_at"] == 0 and {k: tuple(v) for k, v in back[0]["specs"].items()} == {"x": (1.0, None, None), "f": (None, True, None), "t": (None, None, "é")}
    more = spark.createDataFrame([("p", "new"), ("z", "z"), ("z", "z")], "identity string, canonical string")
    assert {tuple(r) for r in portable.insert_new(aliases, more, "identity").collect()} == {("p", "root"), ("p2", "root"), ("q", "other"), ("z", "z")}


def test_snapshots(spark):
    page = """<html><head><title> A car </title><meta property="og:type" content="product"><script type="application/ld+json">{"@graph": [{"@type": "Car", "offers": {"@type": "Offer", "price": "9900"}}]}</script></head>
      <body><h1>Red <b>car</b></h1><p>one</p><p>one</p><script>no</script><a href="/x">two &amp; three</a></body></html>"""
    row = html.snapshots(spark.createDataFrame([(1, "u", page), (2, "v", None)], "page_id long, url string, html string")).collect()[0]
    assert (row["title"], row["h1"], row["text"], row["links"]) == ("A car", "Red car", "Red car\none\ntwo & three", ["/x"])
    assert row["og"] == {"type": "product"} and row["ld_types"] == ["Car", "Offer"] and row["ld_price"] == 9900.0


def test_snapshots_decode_the_references_asked_for(spark):
    page = """<title>a &amp; b &ampc &quot; &amp;quot; &#38;</title><h1>&copy;<b>&amp;</b></h1><script type="application/ld+json">{"@type": "A & B"}</script><a href="?a&amp;b=&lt;">x</a>"""
    pages = spark.createDataFrame([(1, "u", page), (2, "v", "&<script>&")], "page_id long, url string, html string")
    one, two = html.snapshots(pages, ["amp"]).orderBy("page_id").collect()
    assert (one["title"], one["h1"], one["ld_types"], one["links"]) == ("a & b &ampc &quot; &quot; &#38;", "&copy;&", ["A & B"], ["?a&b=&lt;"]) and two["text"] == "&"
    assert html.snapshots(pages, []).orderBy("page_id").first()["h1"] == "&copy;&amp;"
    assert html.snapshots(pages).orderBy("page_id").first()["h1"] == "©&"


def test_snapshots_are_handed_on_in_parts(spark, monkeypatch):
    """Batches of any size: pages are held by their characters, none is lost or moved."""
    from catalograin.queries import html as used

    monkeypatch.setattr(used, "BLOCK_CHARS", 40)
    pages = spark.createDataFrame([(i, f"u{i}", None if i % 5 == 0 else f"<title>{i}</title>" + "x" * (i % 90)) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    batches = []

    class Pages:
        columns = pages.columns
        select = lambda self, *c: self
        mapInArrow = lambda self, run, schema: run

    run = html.snapshots(Pages())
    for batch in run(pages.toArrow().to_batches()):
        batches.append(batch.num_rows)
        assert all(t == (None if i % 5 == 0 else str(i)) and u == f"u{i}" for i, u, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
    assert sum(batches) == 200 and max(batches) <= 20
