import hashlib

import pytest

from catalograin.plans.model import (
    Filter, Key, Plan, Request, Sort, as_boolean, as_number, as_text, boolean_filters, edit_filters, edit_sort, effective, highlight, merge_filters, normalize_key, normalize_list, normalize_query,
    range_filters, registry_signature, sanitize, sort_menu, text_filters, value_filters,
)

REGISTRY = [Key("width_cm", "number", "cm", count=5), Key("wood_type", "string", count=9), Key("soft_close", "boolean", count=2)]


@pytest.mark.parametrize(("name", "key"), [("Width CM", "width_cm"), ("drawer capacity liters", "drawer_capacity_liters"), ("Größe (cm)", "gro_e_cm"), ("Šírka", "sirka"), ("__a--b__", "a_b"), ("x" * 80, "x" * 64)])
def test_keys(name, key):
    assert normalize_key(name) == key


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (Filter("k", "eq", ["a", "b"]), Filter("k", "in", ("a", "b"))),
        (Filter("k", "in", [100]), Filter("k", "eq", 100)),
        (Filter("k", "in", 90), Filter("k", "eq", 90)),
        (Filter("k", "gt", [1, 2]), None),
        (Filter("k", "in", ["a", "b", "a"]), Filter("k", "in", ("a", "b"))),
        (Filter("k", "in", None), None),
        (Filter("k", "in", []), None),
        (Filter("k", "exists"), Filter("k", "exists")),
    ],
)
def test_lists(given, want):
    assert normalize_list(given) == want


def test_sanitize_resolves_names_and_asks_for_unknown_ones():
    plan = Plan((Filter("Width CM", "gt", 100), Filter("wide", "lt", 200), Filter("Inner volume", "gte", 400), Filter("castors", "eq", True)), Sort("Soft close"), "comfy", (Key("wood type", "string"),), ("wood_type", "width_cm", "colour"))
    got = sanitize(plan, REGISTRY, {"wide": "width_cm", "inner_volume": "drawer_volume"})
    assert [f.key for f in got.filters] == ["width_cm", "width_cm", "drawer_volume", "castors"]
    assert got.sort == Sort("soft_close") and got.semantic_text == "comfy"
    assert [(k.key, k.type) for k in got.missing] == [("drawer_volume", "number"), ("castors", "boolean"), ("colour", "string")]
    assert got.show == ("wood_type", "colour")
    assert sanitize(got, REGISTRY) == got


def test_a_registered_name_goes_before_its_synonym():
    assert sanitize(Plan((Filter("width_cm", "eq", 1),)), REGISTRY, {"width_cm": "other"}).filters[0].key == "width_cm"


def test_panel_filters_and_sorts():
    plan = Plan((Filter("wood_type", "eq", "diesel"),))
    merged = merge_filters(plan, [Filter("wood_type", "eq", "petrol"), Filter("price", "lt", 5)])
    assert [f.value for f in merged.filters] == ["diesel", 5]
    assert effective(Request(plan, sort=Sort("price")), REGISTRY).sort == Sort("price")
    assert effective(Request(Plan(sort=Sort("title")), sort=Sort("price")), REGISTRY).sort == Sort("title")
    assert range_filters("p", 1, None) == [Filter("p", "gte", 1)] and value_filters("f", ["a"]) == [Filter("f", "eq", "a")] and value_filters("f", []) == []
    assert text_filters("title", " Red  car red") == [Filter("title", "contains", "red"), Filter("title", "contains", "car")]
    assert boolean_filters("x", None) == [] and boolean_filters("x", False) == [Filter("x", "eq", False)]
    assert edit_filters(merged, "price", []).filters == plan.filters
    assert edit_sort(Plan(sort=Sort("width_cm")), Sort("price")).show == ("width_cm",)
    assert highlight(Plan((Filter("wood_type", "eq", "x"), Filter("title", "contains", "y")), Sort("price"), None, (Key("m", "string"),), ("width_cm", "wood_type"))) == ["price", "wood_type", "width_cm", "m"]
    assert [k.key for k in sort_menu([*REGISTRY, Key("price", "number", count=3), Key("zero", "number")])] == ["width_cm"]


def test_signature_and_query():
    assert registry_signature([Key("width_cm", "number", "cm")]) == hashlib.sha1(b"v2\nwidth_cm:number:cm").hexdigest()
    assert registry_signature(REGISTRY) == registry_signature(REGISTRY[::-1])
    assert normalize_query("  Cheap \n DIESEL ") == "cheap diesel"


def test_values():
    assert [as_number(x) for x in (3, "4.5", " 7 ", "x", None, float("inf"), True)] == [3.0, 4.5, 7.0, None, None, None, 1.0]
    assert [as_boolean(x) for x in (True, "YES", "0", "maybe", 1)] == [True, True, False, None, True]
    assert [as_text(x) for x in ("Ab", 5.0, 5.5, False, None)] == ["ab", "5", "5.5", "false", None]
    with pytest.raises(ValueError):
        Request(limit=0)
