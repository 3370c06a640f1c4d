import json

import pytest

from catalograin.sources import jsonld, tree


def page(*bodies, rest=""):
    return "".join(f'<script type="application/ld+json">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in bodies) + rest


def told(spark, *pages):
    table = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    nodes = tree.page_nodes(table).persist()
    return table, nodes, jsonld.walk(jsonld.bodies(nodes))


def brute_types(value):
    """Types and products as a walk by recursion meets them."""
    types, products = [], 0
    if isinstance(value, list):
        for v in value:
            t, p = brute_types(v)
            types, products = types + t, products + p
    elif isinstance(value, dict):
        if "@graph" in value:
            types, products = brute_types(value["@graph"])
        t = value.get("@type")
        own = [x for x in (t if isinstance(t, list) else [t]) if isinstance(x, str)]
        types = types + own
        if "Product" in own:
            return types, products + 1
        if "BreadcrumbList" in own and isinstance(value.get("itemListElement"), list):
            return types, products
        for v in value.values():
            t, p = brute_types(v)
            types, products = types + t, products + p
    return types, products


BODIES = [
    {"@type": "Product", "name": "x", "isRelatedTo": [{"@type": "Product"}]},
    {"@graph": [{"@type": ["Product", "Thing"]}, {"@graph": [{"@type": "Deep", "a": {"b": [{"@type": "Product"}]}}]}], "@type": "Page", "author": {"@type": "Person"}},
    [{"@type": "ItemList", "itemListElement": [{"@type": "ListItem", "item": {"@type": "Product"}}] * 3}, [[{"@type": [1, None, "Odd"]}]]],
    {"@type": "BreadcrumbList", "itemListElement": [{"@type": "ListItem"}]},
    {"@type": "BreadcrumbList", "itemListElement": {"@type": "ListItem"}},
    {"@type": "Product", "@graph": [{"@type": "Inner"}]},
    {"a": 1, "b": "x", "c": None, "d": []},
    5,
    "[1, 2",
    '{"@type": "Product", "@type": "Twice"}',
]


def test_walk_against_recursion(spark):
    rows = {r["page_id"]: r for r in jsonld.page_types(told(spark, *map(page, BODIES), None)[2]).collect()}
    for k, body in enumerate(BODIES[:8]):
        types, products = brute_types(body)
        if k in rows:
            assert (rows[k]["ld_types"], rows[k]["product_nodes"]) == (sorted(types), products)
        else:
            assert not types
    assert {8, 9, 10} & set(rows) == set() and rows[0]["product_name"] == "x"


def test_crumbs(spark):
    listed = [{"position": 3, "name": "Own"}, {"position": "1", "item": {"@id": "/1", "name": "Item's"}}, {"name": "No place", "item": "/2"}, {"position": 4, "item": {"url": "/4"}}, {}]
    found = jsonld.crumbs(told(spark, page({"@type": "breadcrumblist", "itemListElement": listed}, {"x": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "Later"}]}]}))[2])
    rows = [tuple(r)[2:] for r in found.orderBy("position", "place").collect()]
    assert rows == [(1.0, "Item's", "/1"), (3.0, "Own", None), (3.0, "No place", "/2"), (4.0, "", "/4"), (5.0, "", None), (6.0, "Later", None)]


META = '<meta property="og:title" content=" "><meta property="og:title" content="second"><meta property="product:price:amount" content="12.5"><meta name="description" content="plain"><h1> Head <b>line</b>\n</h1>'


@pytest.mark.parametrize(
    ("bodies", "want"),
    [
        ([], ("Head line", 12.5, None, None, "plain")),
        ([{"@type": "Car", "name": "c", "offers": [{"price": "7"}, {"price": 8}], "image": [{"url": "/i"}]}], ("c", 7.0, None, "/i", "plain")),
        ([{"@type": "Product", "name": "a", "offers": {"price": 1, "priceCurrency": "EUR"}}, {"@type": "MyProductGroup", "name": "b", "offers": {"price": "x"}, "description": "d" * 3000}], ("b", 1.0, "EUR", None, "d" * 2000)),
        ([{"@type": "Product", "name": "outer", "@graph": [{"@type": "Product", "name": "inner", "image": "/in"}]}], ("outer", 12.5, None, "/in", "plain")),
        ([{"a": {"@type": "Product", "name": "not at the root"}}], ("Head line", 12.5, None, None, "plain")),
    ],
)
def test_prefill(spark, bodies, want):
    table, nodes, _ = told(spark, page(*bodies, rest=META))
    assert tuple(jsonld.prefill(table, nodes).first())[1:] == want


def test_pages_that_say_nothing(spark):
    table, nodes, found = told(spark, "", None, "<p>x")
    assert found.count() == jsonld.page_types(found).count() == jsonld.crumbs(found).count() == 0
    assert [tuple(r)[1:] for r in jsonld.prefill(table, nodes).collect()] == [(None,) * 5] * 3


def test_scripts_need_no_join_and_no_page_is_broadcast(spark):
    """A script's text says its type itself; small files that many pages come from make no broadcast of them."""
    pages = spark.createDataFrame([(1, '<script type="application/ld+json">{"@type": "Car", "name": "n"}</script><h1>h</h1><style type="application/ld+json">{}</style>'), (2, "<h1>x <b>y</b></h1>")], "page_id long, html string")
    nodes = tree.page_nodes(pages)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = jsonld.bodies(nodes)
    assert "Join" not in plan(found) and [r["page_id"] for r in found.collect()] == [1]
    told = jsonld.prefill(pages, nodes)
    assert "Broadcast" not in plan(told) and {(r["page_id"], r["title"]) for r in told.collect()} == {(1, "n"), (2, "x y")}
