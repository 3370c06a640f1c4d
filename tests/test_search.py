import pytest
from pyspark.sql import functions as F

from catalograin.operators import facets, search
from catalograin.operators.compile import bucketed, candidates, compile_filter, readable, scoped
from catalograin.functions.vectors import relevance_within
from catalograin.plans.model import Filter, Key, Plan, Request, Sort
from catalograin.sources.items import ITEM

REGISTRY = [Key("socket", "string"), Key("lumen", "number", "lm"), Key("dimmable", "boolean")]
TYPES = {k.key: k.type for k in REGISTRY}


def item(i, socket=None, lumen=None, dimmable=None, title=None, price=None, currency=None, description=None, identity=None, gone=None, collection=1):
    specs = {}
    if socket is not None:
        specs["socket"] = (None, None, socket)
    if lumen is not None:
        specs["lumen"] = (float(lumen), None, None)
    if dimmable is not None:
        specs["dimmable"] = (None, dimmable, None)
    return (i, collection, f"https://s.example/{i}", title or f"Lamp {i}", description, price, currency, identity, i, gone, specs)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        item(1, "E14", 400, True, "Ćilim Orbit", 32.0, "CHF", "brass ring", "cilim orbit"), item(2, "GU10", 250, None, "Spot 3_way", 14.5, "CHF"), item(3, "e14", 800, False, None, 61.0, "SEK"), item(4, "GU10", None, True),
        item(5, None, 1200, False, "Reading 100%", 120.0, "CHF"), item(6, "E14", 470, True, None, 25.0, "SEK", collection=2), item(7, "E14", 90, gone=5), item(8, "gu10", 300, True, None, 9.0),
    ]
    return spark.createDataFrame(rows, ITEM).cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def found(items, *filters):
    rows, active, _ = candidates(scoped(items, 1), filters, TYPES)
    return {r["id"]: r["bucket"] for r in bucketed(rows, active, TYPES).collect()}


def test_scopes(items):
    assert ids(scoped(items)) == [1, 2, 3, 4, 5, 6, 8] and ids(scoped(items, [])) == [] and ids(scoped(items, [1], True)) == [1, 2, 3, 4, 5, 7, 8]
    collections = items.sparkSession.createDataFrame([(4, 70, False), (5, 71, True), (6, 71, False)], "id long, owner_id long, shared boolean")
    assert ids(readable(collections, 70)) == [4, 5] and ids(readable(collections, 1, True)) == [4, 5, 6]


@pytest.mark.parametrize(("text", "want"), [("ćILIM", [1]), ("100%", [5]), ("%", [5]), ("_", [2])])
def test_contains_is_literal(items, text, want):
    assert sorted(found(items, Filter("title", "contains", text))) == want


def test_strict_fields_reject_missing_values(items):
    assert sorted(found(items, Filter("currency", "neq", "chf"))) == [3]
    assert sorted(found(items, Filter("product", "contains", "spot"))) == [2] and sorted(found(items, Filter("product", "contains", "orbit"))) == [1]
    assert sorted(found(items, Filter("description", "exists"))) == [1]


def test_missing_values_cannot_be_judged(items):
    assert found(items, Filter("socket", "eq", "e14")) == {1: "matched", 3: "matched", 5: "unknown"}
    assert found(items, Filter("dimmable", "exists")) == {1: "matched", 2: "unknown", 3: "matched", 4: "matched", 5: "matched", 8: "matched"}
    assert found(items, Filter("price", "lt", 20)) == {2: "matched", 4: "unknown", 8: "matched"}
    assert found(items, Filter("dimmable", "neq", "yes")) == {2: "unknown", 3: "matched", 5: "matched"}
    assert found(items, Filter("nobody_has", "eq", 1)) == dict.fromkeys([1, 2, 3, 4, 5, 8], "matched")


@pytest.mark.parametrize(
    "f", [Filter("dimmable", "lte", False), Filter("dimmable", "in", [False]), Filter("lumen", "in", ["much"]), Filter("lumen", "gt", "much"), Filter("socket", "lt", ["a"]), Filter("dimmable", "eq", "maybe")]
)
def test_filters_that_say_nothing(f):
    assert compile_filter(f, TYPES).kind == "skip"


def test_hostile_keys_are_only_keys(items):
    key = "a'] OR 1=1 --"
    rows, _, _ = candidates(scoped(items, 1), [Filter(key, "eq", "x")], {key: "string"})
    assert ids(rows) == [1, 2, 3, 4, 5, 8]


@pytest.fixture(scope="module")
def sortable(spark):
    rows = [("beta", 20.0, 5.0), ("Alpha", None, 9.0), ("álamo", 7.0, None), ("Gamma", 7.5, 1.0), ("delta", 99.0, 3.0)]
    made = [(i, 1, f"u{i}", t, None, p, None, None, i, None, {"watt": (k, None, None)} if k else {}) for i, (t, p, k) in enumerate(rows)]
    return spark.createDataFrame(made, ITEM)


@pytest.mark.parametrize(
    ("sort", "want"),
    [
        (None, ["delta", "Gamma", "álamo", "Alpha", "beta"]), (Sort("price"), ["álamo", "Gamma", "beta", "delta", "Alpha"]), (Sort("price", "desc"), ["delta", "beta", "Gamma", "álamo", "Alpha"]),
        (Sort("watt"), ["Gamma", "delta", "beta", "Alpha", "álamo"]), (Sort("watt", "desc"), ["Alpha", "beta", "delta", "Gamma", "álamo"]), (Sort("nothing"), ["delta", "Gamma", "álamo", "Alpha", "beta"]),
        # in the order of readers: accents and case decide last
        (Sort("title"), ["álamo", "Alpha", "beta", "delta", "Gamma"]), (Sort("title", "desc"), ["Gamma", "delta", "beta", "Alpha", "álamo"]),
    ],
)
def test_orders(sortable, sort, want):
    page, _, totals = search.search(sortable, Request(Plan(sort=sort)), [Key("watt", "number", "W")])
    assert [r["title"] for r in page.collect()] == want
    assert totals.first()["total"] == 5 and totals.first()["strong_count"] is None
    second, _, _ = search.search(sortable, Request(Plan(sort=sort), limit=2, offset=2), [Key("watt", "number", "W")])
    assert [r["title"] for r in second.collect()] == want[2:4]


@pytest.mark.parametrize(
    ("scores", "want"),
    [([0.8, 0.73, 0.7, 0.61], ["high", "high", "medium", "low"]), ([0.3, 0.26, 0.1], ["medium", "medium", "low"]), ([0.24, None], ["low", "low"]), ([0.36, 0.27, 0.24], ["high", "medium", "low"])],
)
def test_relevance(spark, scores, want):
    rows = spark.createDataFrame([(i, 0, s) for i, s in enumerate(scores)], "i int, g int, score double")
    assert [r["r"] for r in rows.withColumn("r", relevance_within(F.col("score"), "g")).orderBy("i").collect()] == want


def test_meaning_orders_and_grades(items, spark):
    vectors = spark.createDataFrame([(2, [0.0, 2.0]), (1, [3.0, 4.0]), (5, [0.1, 1.0])], "id long, vector array<float>")
    page, _, totals = search.search(items, Request(Plan(semantic_text="x")), REGISTRY, 1, vectors, [0.0, 1.0])
    assert [(r["id"], r["relevance"]) for r in page.collect()][:3] == [(2, "high"), (5, "high"), (1, "low")]
    assert totals.first()["strong_count"] == 2
    assert [r["id"] for r in search.by_ids(items, [5, 99, 2]).collect()] == [5, 2]


def summary(items, *filters):
    return {r["key"]: r for r in facets.facet_summary(scoped(items, 1), list(filters), REGISTRY).collect()}


def values(items, *filters, **options):
    return {(r["key"], r["value"]): r["count"] for r in facets.facet_values(scoped(items, 1), list(filters), REGISTRY, **options).collect()}


def test_facets_without_filters(items):
    got = summary(items)
    assert {k: (r["count"], r["missing"]) for k, r in got.items()} == {
        "price": (5, 1), "title": (6, 0), "description": (1, 5), "product": (6, 0), "currency": (4, 2), "collection": (6, 0), "socket": (5, 1), "lumen": (5, 1), "dimmable": (5, 1),
    }
    assert (got["lumen"]["low"], got["lumen"]["high"], got["lumen"]["unit"]) == (250, 1200, "lm")
    assert (got["dimmable"]["yes"], got["dimmable"]["no"]) == (3, 2) and got["price"]["unit"] is None
    assert {v: n for (k, v), n in values(items).items() if k == "socket"} == {"E14": 2, "GU10": 3}


def test_a_field_is_not_narrowed_by_its_own_filter(items):
    ticked = Filter("socket", "in", ["gu10"])
    assert {v: n for (k, v), n in values(items, ticked).items() if k == "socket"} == {"E14": 2, "GU10": 3}
    got = summary(items, ticked)
    assert (got["lumen"]["count"], got["lumen"]["low"], got["lumen"]["high"]) == (2, 250, 300) and (got["dimmable"]["yes"], got["dimmable"]["no"]) == (2, 0)


def test_two_failing_fields_count_nowhere(items):
    filters = Filter("socket", "eq", "G9"), Filter("dimmable", "eq", False)
    got = summary(items, *filters)
    assert got["socket"]["count"] == 1 and (got["dimmable"]["yes"], got["dimmable"]["no"]) == (0, 0) and got["lumen"]["count"] == 0
    assert {v: n for (k, v), n in values(items, *filters).items() if k == "socket"} == {"e14": 1, "G9": 0}


def test_cap_and_ticked_values(spark):
    rows = [item(i, f"C{i}") for i in range(1, 8)]
    many = spark.createDataFrame(rows, ITEM)
    got = facets.facet_values(many, [], REGISTRY, cap=5).where("key = 'socket'").collect()
    assert len(got) == 5 and {r["more"] for r in got} == {2}
    got = facets.facet_values(many, [Filter("socket", "eq", "c7")], REGISTRY, cap=5).where("key = 'socket'").collect()
    assert len(got) == 6 and {r["more"] for r in got} == {1} and "C7" in {r["value"] for r in got}


def test_coverage_counts_synonyms(items):
    got = {r["key"]: (r["covered"], r["poor"]) for r in search.coverage(scoped(items, 1), ["socket", "currency", "light"], REGISTRY, {"light": ["lumen"]}).collect()}
    assert got == {"socket": (5, False), "currency": (4, True), "light": (5, False)}
