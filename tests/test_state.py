from pyspark.sql import functions as F

from catalograin.operators import state
from catalograin.sources.items import ITEM


def test_plan_cache(spark):
    cache = spark.createDataFrame([(1, "q", "s", "p1", 1), (2, "q", "s", "p2", 5), (2, "r", "s", "p3", 1)], "collection_id long, query string, signature string, plan string, used_at long")
    wanted = spark.createDataFrame([(1, "q", "s"), (3, "q", "s"), (1, "q", "t")], "collection_id long, query string, signature string")
    got = {(r["collection_id"], r["signature"]): (r["plan"], r["own"]) for r in state.cached_plans(wanted, cache).collect()}
    assert got == {(1, "s"): ("p1", True), (3, "s"): ("p2", False), (1, "t"): (None, False)}


def test_history(spark):
    rows = spark.createDataFrame([(1, None, 7, "a", 1), (1, None, 7, "a", 3), (1, 4, None, "b", 2), (1, None, None, "c", 2)], "user_id long, collection long, grp long, query string, at long")
    found = state.history(rows.withColumn("slot", state.slot(F.col("collection"), F.col("grp"))))
    assert {(r["slot"], r["query"], r["hits"], r["used_at"]) for r in found.collect()} == {(-7, "a", 2, 3), (4, "b", 1, 2), (0, "c", 1, 2)}
    assert state.recent(found, 1).count() == 3


def test_values_and_sources(spark):
    num = lambda x: (float(x), None, None)
    items = spark.createDataFrame([(1, 1, "u", None, None, None, None, None, 0, 5, {"a": num(1), "b": num(2)}), (2, 2, "v", None, None, None, None, None, 0, None, None)], ITEM)
    values = spark.createDataFrame([(1, "a", num(8), 0), (1, "a", num(9), 1), (2, "c", num(3), 0)], "id long, key string, value struct<num:double,flag:boolean,txt:string>, ordinal int")
    bags = lambda df: {r["id"]: {k: v["num"] for k, v in (r["specs"] or {}).items()} for r in df.collect()}
    assert bags(state.set_values(items, values)) == {1: {"a": 9, "b": 2}, 2: {"c": 3}}
    assert bags(state.without_key(items, "a", [2])) == bags(items) and bags(state.without_key(items, "a")) == {1: {"b": 2}, 2: {}}
    sources = spark.createDataFrame([(1, "a", "web", "https://x", 0.9)], "id long, key string, origin string, url string, confidence double")
    assert {r["id"]: r["sources"] and list(r["sources"]) for r in state.with_sources(items, sources).collect()} == {1: ["a"], 2: None}
    hashed = items.withColumns({"card_hash": F.lit("c"), "content_hash": F.lit("t")})
    seen = spark.createDataFrame([("u", "new", None)], "url string, card_hash string, content_hash string")
    assert {r["id"]: (r["gone_at"], r["card_hash"], r["content_hash"]) for r in state.touch(hashed, seen).collect()} == {1: (None, "new", "t"), 2: (None, "c", "t")}
    answers = spark.createDataFrame([(1, True, " so  it \n is "), (2, None, "x"), (3, False, " ")], "id long, match boolean, evidence string")
    assert [r["evidence"] for r in state.focus_answers(answers).orderBy("id").collect()] == ["so it is", None, None]


def test_cards_and_hints(spark):
    saved = spark.createDataFrame([(1, 0, "a", "t", None), (2, 0, "b", "t", True)], "job_id long, pos long, url string, text string, picked boolean")
    saved = state.save_cards(saved, 1, spark.createDataFrame([(0, "c", "t"), (1, "d", "t")], "pos long, url string, text string"))
    got = state.pick_cards(saved, 1, spark.createDataFrame([("d",), ("d",)], "url string"))
    assert {(r["job_id"], r["url"], r["picked"]) for r in got.collect()} == {(1, "c", False), (1, "d", True), (2, "b", True)}
    jobs = [(1, "listing", '{"max_items": 5, "max_pages": 2}', 4), (1, "listing", '{"max_items": 9, "max_pages": "7"}', None), (1, "enrich", '{"max_items": 99}', 50), (3, "listing", None, None), (3, "listing", "no json", 1)]
    items = spark.createDataFrame([(1, None), (1, None), (1, 5), (2, 6)], "collection_id long, gone_at long")
    found = state.recrawl_hints(spark.createDataFrame(jobs, "collection_id long, type string, params string, pages_seen long"), items)
    assert sorted(map(tuple, found.collect())) == [(1, 9, 2, 4, 2), (2, 0, 0, 0, 0), (3, 0, 0, 1, 0)]
    crumbs = [("Home", "https://s.com/"), ("Cars", "https://s.com/cars"), ("Used", "https://s.com/cars/used"), ("Ad", "https://o.com/x"), ("This", "https://s.com/i/1")]
    row = spark.createDataFrame([(crumbs,)], "c array<struct<name:string,url:string>>").select(state.category_of_crumbs(F.col("c"), "s.com", "https://s.com/i/1").alias("x")).first()
    assert row["x"]["name"] == "Used"
    html = spark.createDataFrame([('<div class="a" onclick="x()" style=\'y\'><script>no</script> <!-- no -->\n text</div>',)], "h string")
    assert html.select(state.prompt_text(F.col("h"))).first()[0] == '<div class="a"> text</div>'
    links = spark.createDataFrame([(1, c, p, u, t, False) for c in range(4) for p, u, t in ((0, f"/i/{c}", True), (1, "/seller", False))], "page_id long, card long, pos long, url string, in_title boolean, has_image boolean")
    best = {(r["card"], r["url"]): r["score"] for r in state.card_url_scores(links, "^/i/").collect()}
    assert best[0, "/i/0"] == 103.5 and best[0, "/seller"] == -4.0
    focus = spark.createDataFrame([(1, 1, "red"), (2, 1, None), (3, 2, None)], "id long, collection_id long, focus_for string")
    assert sorted(r["id"] for r in state.focus_pending(focus, spark.createDataFrame([(1, "red"), (2, None)], "id long, focus string")).collect()) == [2]
