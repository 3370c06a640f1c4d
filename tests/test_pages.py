import pytest
from pyspark.sql import functions as F

from catalograin.operators import navigation, pages
from catalograin.sources import tree

LISTING = """<html><head><title>All</title><style>.card{}</style></head><body><nav><ul><li class=card><a href="/home">Home</a></ul></nav>
<div class="grid">
 <div class="card"><a href="/brand/1">Ember</a><a href="/lamp/1?x=1#top"><img src="" data-src="//img.example/1.png" alt="Lamp one"></a><h3><a href="/lamp/1?x=1">Desk lamp  one</a></h3><span>19 EUR</span></div>
 <div class="card"><a href="/brand/1">Ember</a><p class="Product-Name"><a href="../lamp/2" title="Desk lamp two, brass">Desk lamp t…</a><b>29<br>EUR</b></div>
 <div class="card"><a href="/brand/1">Ember</a><a href="javascript:void(0)">Compare</a><div class="card inner"><a href="/lamp/3">12 EUR</a><img alt="Lamp three" src="/3.png"></div></div>
 <a class="card" href="lamp/4">Floor lamp<script>var x = "<a href='/no'>"</script></a>
</div><footer><a href="/lamp/imprint">Imprint</a></footer></body></html>"""
URL = "https://shop.example/all/list?p=2"


@pytest.fixture(scope="module")
def listing(spark):
    table = spark.createDataFrame([(1, URL, LISTING), (2, URL, None), (3, URL, ""), (4, URL, "no markup")], "page_id long, url string, html string")
    return table.select("page_id", "url"), tree.page_nodes(table).persist()


def brute_select(nodes, selector):
    """Numbers that a selector of plain parts chooses, by walking up."""
    by = {n[0]: n for n in nodes}

    def fits(n, part):
        return n[4] != "#text" and ((part[0] == "." and part[1:] in dict(n[5]).get("class", "").split()) or part in ("*", n[4]))

    def chosen(n, parts):
        if not fits(n, parts[-1]):
            return False
        if len(parts) == 1:
            return True
        up = by.get(n[2])
        if parts[-2] == ">":
            return up is not None and chosen(up, parts[:-2])
        while up is not None:
            if chosen(up, parts[:-1]):
                return True
            up = by.get(up[2])
        return False

    return {n[0] for n in nodes if any(chosen(n, alternative.split()) for alternative in selector.split(","))}


@pytest.mark.parametrize("selector", ["a", "*", ".card a", ".card > a", "div > div > a, nav li", ".card .card a", "ul li a, footer > a", "div .card > h3 a"])
def test_selectors(spark, listing, selector):
    got = {r["pos"] for r in tree.marked(listing[1], selector, "x").where("x AND page_id = 1").collect()}
    assert got == brute_select(tree.nodes_of(LISTING), selector) and got


def test_selector_attributes(listing):
    count = lambda s: tree.marked(listing[1], s, "x").where("x").count()
    assert (count('[class*=name i]'), count("p[class*=name]"), count('a[href^="/lamp"]'), count("[class~=inner]"), count("img[alt$='one']"), count("#none")) == (1, 0, 4, 1, 1, 0)
    for wrong in ("a:hover", "", "a >", "a,,b", "> a"):
        with pytest.raises(ValueError, match="selector"):
            tree.parse_selector(wrong)


def test_numbers_of_nodes_nest():
    nodes = tree.nodes_of(LISTING + "<div><p>x<div>y</i></p></b>" * 5)
    for pos, last, parent, depth, *_ in nodes:
        inside = [n for n in nodes if pos < n[0] <= last]
        assert all(n[1] <= last and n[3] > depth for n in inside)
        assert parent is None or nodes[parent][0] < pos <= last <= nodes[parent][1] and nodes[parent][3] == depth - 1


def test_markup_that_is_not_closed(spark):
    """Paragraphs, items and cells end where the next begins; stray ends and unclosed tags lose nothing but themselves."""
    shape = lambda h: [(n[4] if n[4] != "#text" else n[7], n[2]) for n in tree.nodes_of(h)]
    assert shape("<p>a<b>x<br><p>y") == [("p", None), ("a", 0), ("b", 0), ("x", 2), ("br", 2), ("p", None), ("y", 5)]
    assert shape("<ul><li><p>1<ul><li>2</ul><li>3</ul>4") == [("ul", None), ("li", 0), ("p", 1), ("1", 2), ("ul", 1), ("li", 4), ("2", 5), ("li", 0), ("3", 7), ("4", None)]
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>d")[-4:] == [("tr", 0), ("td", 6), ("c", 7), ("d", None)]
    assert shape("</p>a</span><div><span>b</div>c</span>") == [("a", None), ("div", None), ("span", 1), ("b", 2), ("c", None)]
    assert shape("<title>a &amp; <b></title><script>1<2</script>3<a href='x>4") == [("title", None), ("a & <b>", 0), ("script", None), ("1<2", 2), ("3", None), ("a", None), ("4", 5)]
    assert shape("a<b c='<d") == [("a", None)]
    deep = tree.page_nodes(spark.createDataFrame([(1, "<div>" * 30_000 + "x" + "</span>" * 30_000)], "page_id long, html string"))
    assert deep.agg(F.count("*"), F.max("depth")).first() == (30_001, tree.MAX_DEPTH)


def test_absolute_links(spark):
    base = "https://s.example/a/b?q=1#f"
    want = {"/x": "https://s.example/x", "x": "https://s.example/a/x", "../x?y=../z": "https://s.example/x?y=../z", "../../../x/.": "https://s.example/x/", "//t.example": "https://t.example/", "?p=2": "https://s.example/a/b?p=2", "#g": "https://s.example/a/b?q=1#g", "": "https://s.example/a/b?q=1", "mailto:a@b": "mailto:a@b", "HTTP://u.example/./v": "HTTP://u.example/./v", "http://u.example/./v/../w": "http://u.example/w"}
    rows = spark.createDataFrame(list(want), "string").select("value", tree.absolute(F.col("value"), F.lit(base)).alias("got")).collect()
    assert {r["value"]: r["got"] for r in rows} == want
    assert spark.range(1).select(tree.absolute(F.lit("x"), F.lit("https://s.example"))).first()[0] == "https://s.example/x"


def test_cards(listing):
    """The item's link stands twice or in the title; a brand that three cards share loses."""
    table, nodes = listing
    rows = {r["card"]: r for r in pages.cards(nodes, table, ".grid .card").collect()}
    found = [tuple(rows[k][1:]) for k in sorted(rows)]
    site = "https://shop.example"
    assert [(u, t, i) for _, u, t, _, i in [(0, *f[1:]) for f in found]] == [
        (f"{site}/lamp/1?x=1", "Desk lamp one", "https://img.example/1.png"),
        (f"{site}/lamp/2", "Desk lamp two, brass", None),
        (f"{site}/lamp/3", "Lamp three", f"{site}/3.png"),
        (f"{site}/lamp/3", "Lamp three", f"{site}/3.png"),
        (f"{site}/all/lamp/4", "Floor lamp", None),
    ]
    assert [f[3] for f in found][1:3] == ["Ember\nDesk lamp t…29\nEUR", "EmberCompare\n12 EUR"]
    by_pattern = pages.cards(nodes, table, ".grid .card", "/brand/").collect()
    assert sorted(r["url"] for r in by_pattern) == sorted([f"{site}/brand/1"] * 3 + [f"{site}/lamp/3", f"{site}/all/lamp/4"])


def test_pattern_cards(listing):
    table, nodes = listing
    rows = pages.pattern_cards(nodes, table, r"/lamp/\d").collect()
    assert sorted(r["url"].rsplit("/", 1)[1] for r in rows) == ["1?x=1", "1?x=1#top", "2", "3", "4"]
    assert {r["title"] for r in rows} == {"Desk lamp one", "Desk lamp two, brass", "Lamp three", "Floor lamp"}


PAGER = """<div class="pager"><a href="?p=1">← Back</a><a href="?p=1">1</a><a href="?p=2" class="on">2</a><a href="?p=3"><span class="step-next">More</span></a><a class="next disabled" href="?p=9">Last</a></div>"""


def test_next_control_of_a_tree(spark):
    table = spark.createDataFrame([(1, URL, PAGER), (2, URL, PAGER.replace("?p=3", "#")), (3, URL, "<a>x</a>")], "page_id long, url string, html string")
    found = pages.controls(tree.page_nodes(table), table, ".pager a, .step-next")
    visited = table.select("page_id", F.lit("https://shop.example/all/list?p=1").alias("url"))
    got = {r["page_id"]: (r["pos"], r["href"]) for r in navigation.next_control(found, visited).collect()}
    assert got == {1: (4, "https://shop.example/all/list?p=3"), 2: (4, None)}


def test_crumbs_and_classes(spark, listing):
    html = '<div class="x breadcrumbs-top x"><a href="/">Home</a> / <a href="/lamps"> All \n lamps</a><b class="x y">z</b></div><p class="breadcrumb"><a href="/no">No</a>'
    table = spark.createDataFrame([(5, URL, html)], "page_id long, url string, html string")
    nodes = tree.page_nodes(table)
    assert [tuple(r)[1:] for r in pages.trail_crumbs(nodes, table).orderBy("position").collect()] == [(1, "Home", "https://shop.example/"), (2, "All lamps", "https://shop.example/lamps")]
    assert [tuple(r) for r in pages.frequent_classes(nodes).collect()] == [(5, "x", 3)]
    assert [tuple(r) for r in pages.frequent_classes(listing[1]).collect()] == [(1, "card", 6)]


def test_markup_for_a_reader(spark):
    html = '<!DOCTYPE html><html lang=x><head><title>t</title></head><body onload="x()"><!-- c --><div id="a" style="s"><p class="k">1 &lt; 2<b>x<br><p>y</div>  <custom>kept</custom><svg><p>no</p></svg><a href="javascript:x" rel="r">z</a><img src="/i.png" alt=\'a"b\' width=3><button disabled>go'
    table = spark.createDataFrame([(1, html), (2, "x " * 150_000), (3, "")], "page_id long, html string")
    got = {r["page_id"]: r["markup"] for r in pages.sanitised(tree.page_nodes(table)).collect()}
    assert got[1] == '<html><body><div id="a"><p class="k">1 &lt; 2<b>x</b></p><p>y</p></div> kept<a rel="r">z</a><img src="/i.png" alt="a&quot;b" /><button disabled="">go</button></body></html>'
    assert len(got[2]) == 200_000 + len("<!--truncated-->") and 3 not in got


def test_made_pages_are_spread(spark, tmp_path, monkeypatch):
    """A small table that large pages come from gives as many tasks as its pages need."""
    from catalograin import page_queries

    monkeypatch.setattr(page_queries, "SMALL_PAGES", 10)
    monkeypatch.setattr(page_queries, "LISTINGS", 2)
    spark.range(95).selectExpr("id event_id", "'click' event_type", "1.5D value", "'{}' props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(200).selectExpr("id p_partkey", "'oak' p_name", "1 p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert page_queries._event_pages(spark, str(tmp_path)).rdd.getNumPartitions() == 10
    assert page_queries._listings(spark, str(tmp_path))[1].rdd.getNumPartitions() == 3


def test_changed_tokens_take_texts_apart_once(spark, tmp_path):
    from catalograin import more_queries

    rows = [(1, "b a b."), (2, "a c"), (3, " ".join(f"w{i}" for i in range(60))), (4, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = more_queries.changed_tokens(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, "- b|+ c")] and "split(" not in got._jdf.queryExecution().executedPlan().toString()


def test_page_markup_is_told_as_its_sql_does(spark, tmp_path):
    """References that lack their end, as where a heading is cut, stay; long pages are whole; a null page has a null."""
    from catalograin import page_queries
    from catalograin.queries import oracle_sql

    duckdb = pytest.importorskip("duckdb")
    heads = ["a &quot", "a &quo", "a &amp", "a &amp;", "&ampquot; &amp;quot; &copy &copy; &middot &middot; &quot; &#38; &lt; &lt &amp;lt; & &ampamp;", "x " * 150_000 + "y"]
    rows = [(n, "u", f"<html><head><title>{h}</title></head><body><article><h1>{h}</h1></article><footer>z</footer></body></html>") for n, h in enumerate(heads)] + [(len(heads), "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(duckdb.execute(oracle_sql()["page_markup"]).fetchall())
    got = dict(tuple(r) for r in page_queries.page_markup(spark, str(tmp_path)).collect())
    assert got == want and "<h1>a &amp;quot</h1>" in got[0] and len(got[5]) > 300_000


def test_changed_tokens_read_texts_of_any_length(spark, tmp_path):
    """No text is left out for its length; each is taken apart once, as `written` has them."""
    from catalograin import more_queries
    from catalograin.queries import oracle_sql

    duckdb = pytest.importorskip("duckdb")
    long = " ".join(f"w{i}" for i in range(3_000))
    rows = [(1, "b a b."), (2, "a c"), (3, long), (4, long + " Z"), (5, None), (6, "x"), (8, ""), (9, "y"), (-1, "m"), (0, "n"), (63, "o"), (64, "p"), (64, "q"), (65, "r"), (65, "s"), (None, "t"), (128, "u")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.execute(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(duckdb.execute(oracle_sql()["changed_tokens"]).fetchall(), key=str)
    got = more_queries.changed_tokens(spark, str(tmp_path))
    assert "split(" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len(want) == 14 and {(2, "- a|- c|+ w0|+ w1|+ w10|+ w100"), (3, "+ z"), (4, None), (5, None), (8, "+ y"), (-1, "- m|+ n"), (63, "- o|+ q"), (64, "- q|+ r")} <= set(want)
