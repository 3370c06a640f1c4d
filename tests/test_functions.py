import time

import pytest
from pyspark.sql import functions as F

from catalograin.functions import change, text, urls
from catalograin.plans.model import normalize_key

PAGE = "Lampa Orbit\n64,50 EUR\nViews\n118\nSocket\nE14\nHeight\n210"


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def same(spark, a, b):
    x, y = column(spark, [a, b], change.fingerprint)
    return x == y


@pytest.mark.parametrize(
    "other",
    [
        PAGE.upper(), PAGE.replace("\n", "\r\n  "), PAGE.replace("118", "2.041"), PAGE + "\n5 minutes ago", PAGE + "\nAufrufe: 31", PAGE + "\nUpdated:\n03.02.2025 at 08:15", "E14\n" + PAGE, PAGE + "\nFragen (12)",
        "Socket E14 Height 210\nLampa Orbit 64,50 EUR",
    ],
)
def test_equal_fingerprints(spark, other):
    assert same(spark, PAGE, other)


@pytest.mark.parametrize("other", [PAGE.replace("64,50", "59,00"), PAGE + "\nDimmable", PAGE.replace("210", "230"), ""])
def test_different_fingerprints(spark, other):
    assert not same(spark, PAGE, other)


def test_differences(spark):
    rows = spark.createDataFrame([("cost 64,50 eur", "cost 59,00 eur"), ("a b", "a"), ("", "x"), ("a", "a")], "o string, n string")
    rows = rows.select(change.tokens(F.col("o")).alias("o"), change.tokens(F.col("n")).alias("n"))
    got = rows.select(change.changed(F.col("o"), F.col("n")).alias("c"), change.removed_share(F.col("o"), F.col("n")).alias("s")).collect()
    assert got[0]["c"] == ["- 64,50", "+ 59,00"] and [r["s"] for r in got] == [pytest.approx(1 / 3), 0.5, 0.0, 0.0]


def test_numbers_and_booleans(spark):
    assert column(spark, ["1.234", "12,5 kg", "ca. 1.234.567 km", "-3", "1,234", "12.50", "none", None, "1 234"], text.loose_number) == [1234.0, 12.5, 1234567.0, -3.0, 1234.0, 12.5, None, None, 1234.0]
    assert column(spark, [" Yes", "NE", "oui", "x", None, "0"], text.loose_boolean) == [True, False, True, None, None, False]


def test_names(spark):
    assert column(spark, ["Größe (cm)", "Žuta boja", "__x__", None], text.attribute_key) == ["gro_e_cm", "zuta_boja", "x", None]
    assert column(spark, ["Citroën C4-X"], text.padded_name) == [" citroen c4 x "]
    assert column(spark, ["engine_power_kw"], text.humanized) == ["Engine power kw"]
    assert column(spark, ["\n  \n First \nx"], text.first_line) == ["First"]
    assert column(spark, ["https://www.Shop.example/a?b", "nothing"], text.source_host) == ["shop.example", None]
    assert column(spark, ["Car\nCa...\n10 km\n\nred"], lambda v: text.card_snippet(v, F.lit("Car"))) == ["10 km · red"]
    brands = spark.createDataFrame([("Kia", "the KIA dealer"), ("Kia", "Kiado"), (None, "x"), ("Kia", "")], "b string, s string")
    assert [r["m"] for r in brands.select(text.source_matches(F.col("b"), F.col("s")).alias("m")).collect()] == [True, False, True, True]


def test_urls(spark):
    assert column(spark, ["https://s.com/p/1?utm_source=x&id=5#top", "https://s.com/p?ref=a", "https://s.com/p?reference=1&pos=2&position_x=3", "https://s.com/"], urls.item_url) == [
        "https://s.com/p/1?id=5", "https://s.com/p", "https://s.com/p?reference=1", "https://s.com/",
    ]
    assert column(spark, ["https://s.com/p?page=1&a=2"], lambda v: urls.with_page(v, "page", F.lit(3))) == ["https://s.com/p?a=2&page=3"]
    assert column(spark, ["https://a.b/c", "javascript:x", "https://a/" + "x" * 3000, None], urls.safe_link) == ["https://a.b/c", None, None, None]
    assert column(spark, ["https://s.com/cars/12345/red-one?x", "https://s.com/cars"], urls.link_shape) == ["s.com/cars/*/*", "s.com/*"]
    assert column(spark, ["x.ads.example", "ads.example", "badads.example"], lambda v: urls.is_tracker(v, ["ads.example"])) == [True, True, False]
    assert urls.is_safe_pattern(r"/item/\d+") and not urls.is_safe_pattern(r"(a+)+b") and not urls.is_safe_pattern("(?=x)") and not urls.is_safe_pattern("[")


def test_patterns_of_hosts(spark):
    rows = spark.createDataFrame([(f"https://s.com/cars/used/{i}",) for i in range(9)] + [("https://s.com/about",), ("https://t.com/x/1",)], "url string")
    assert [tuple(r) for r in urls.directory_prefixes(rows).collect()] == [("s.com", "/cars/used/", 9)]
    assert [tuple(r) for r in urls.common_shape(rows).collect()] == [("s.com", "s.com/cars/used/*", 9)]


def test_long_pages_are_read_in_one_pass(spark):
    page = "\n".join(f"line {i} of it" for i in range(20_000))
    began = time.perf_counter()
    assert len(column(spark, [page, page + "\n3 days ago"], change.fingerprint)[0]) == 64
    assert time.perf_counter() - began < 60


def test_values_above_and_keys(spark):
    assert column(spark, ["Views\n12\nViews\nof it\n7", "12\nViews", "Updated\n1.2.2024\n5"], lambda v: F.array_join(change.stable_lines(v), "|")) == ["of it|7", "12", "5"]
    names = ["area m²", "Größe №", "x", None]
    assert column(spark, names, text.attribute_key) == [None if n is None else normalize_key(n) for n in names]


@pytest.mark.parametrize(("answer", "want"), [
    ('{"a": 1}', '{"a":1}'), ('Sure!\n```json\n[1, 2]\n```\nbye', "[1,2]"), ('so {"a": [1]} it is', '{"a":[1]}'), (r'{"css": "\.x"}', r'{"css":"\\.x"}'), ('{"rows": [{"k": "]"}, {"k": "b"}, {"k": ', '{"rows":[{"k":"]"},{"k":"b"}]}'),
    ("[[1, 2], [3", "[[1,2]]"), ("nothing", None), ("", None), (None, None),
])
def test_broken_answers(answer, want):
    assert text.mended_json(answer) == want
