"""Facets: value counts per field, each over the items that pass all filters but the field's own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import LISTING_TYPES, STRICT, Filter, Key, as_text
from .compile import compile_filter, has_value, number_text

VALUE_CAP = 500
_KINDS = {"price": "range", "currency": "values", "collection": "values", "title": "text", "description": "text", "product": "text"}


def failing_fields(filters: Iterable[Filter], types: Mapping[str, str]) -> Column:
    """The distinct fields one or more of whose filters an item fails; an item that lacks a filtered key fails there."""
    checks = []
    for f in filters:
        compiled = compile_filter(f, types)
        if compiled.kind in ("pending", "skip"):
            continue
        passed = F.lit(True) if compiled.condition is None else F.coalesce(compiled.condition, F.lit(False))
        if f.key not in STRICT:
            passed = passed & has_value(f.key, LISTING_TYPES.get(f.key) or types[f.key])
        checks.append(F.when(~passed, F.lit(f.key)))
    return F.array_distinct(F.array_compact(F.array(*checks))) if checks else F.array().cast("array<string>")


def _long(items: DataFrame, registry: Sequence[Key]) -> DataFrame:
    """(id, fails, key, num, flag, txt) for listing fields and registered attributes with a value."""
    nothing = {"num": F.lit(None).cast("double"), "flag": F.lit(None).cast("boolean"), "txt": F.lit(None).cast("string")}
    cell = lambda key, **v: F.struct(F.lit(key).alias("key"), *((v.get(n) if n in v else c).alias(n) for n, c in nothing.items()))
    filled = lambda c: F.nullif(c, F.lit(""))
    listing = [
        cell("price", num=F.col("price")),
        cell("title", txt=filled(F.col("title"))),
        cell("description", txt=filled(F.col("description"))),
        cell("product", txt=filled(F.coalesce(filled(F.col("identity")), F.col("title")))),
        cell("currency", txt=F.col("currency")),
        cell("collection", num=F.col("collection_id").cast("double")),
    ]
    bag = F.transform(F.map_entries("specs"), lambda e: F.struct(e["key"].alias("key"), e["value"]["num"].alias("num"), e["value"]["flag"].alias("flag"), e["value"]["txt"].alias("txt")))
    cells = F.concat(F.array(*listing), F.coalesce(bag, F.array().cast(bag_type)))
    rows = items.select("id", "fails", F.explode(cells).alias("c")).select("id", "fails", "c.*")
    present = F.coalesce(F.col("num").isNotNull() | F.col("flag").isNotNull() | F.col("txt").isNotNull(), F.lit(False))
    known = [*LISTING_TYPES, *(k.key for k in registry if k.key not in LISTING_TYPES)]
    return rows.where(present & F.col("key").isin(known))


bag_type = "array<struct<key:string,num:double,flag:boolean,txt:string>>"


def facet_cells(items: DataFrame, filters: Sequence[Filter], registry: Sequence[Key]) -> DataFrame:
    """(id, key, num, flag, txt, counted): every value of a scoped item; `counted` if the item passes all other fields' filters."""
    types = {k.key: k.type for k in registry}
    marked = items.withColumn("fails", failing_fields(filters, types))
    cells = _long(marked, registry)
    n = F.size("fails")
    return cells.withColumn("counted", (n == 0) | ((n == 1) & (F.get("fails", F.lit(0)) == F.col("key")))).drop("fails")


def facet_summary(items: DataFrame, filters: Sequence[Filter], registry: Sequence[Key]) -> DataFrame:
    """One row per field that any scoped item has: key, kind, count, missing, low, high, unit, yes, no, place (in the list).

    `missing` is the number of items the field is counted over without a usable value. A price has a unit only if all priced items
    agree on it (a missing currency counting as one).
    """
    types = {k.key: k.type for k in registry}
    cells = facet_cells(items, filters, registry)
    kinds = _KINDS | {k.key: {"number": "range", "boolean": "boolean"}.get(k.type, "values") for k in registry if k.key not in LISTING_TYPES}
    order = {k: i for i, k in enumerate([*LISTING_TYPES, *(k.key for k in registry if k.key not in LISTING_TYPES)])}
    spark = items.sparkSession
    fields = spark.createDataFrame([(k, kinds[k], order[k], next((r.unit for r in registry if r.key == k), None)) for k in order], "key string, kind string, place int, key_unit string")
    usable = (
        F.when(F.col("kind") == "range", F.coalesce("num", F.col("txt").try_cast("double")).isNotNull())
        .when(F.col("kind") == "boolean", F.col("flag").isNotNull())
        .when(F.col("kind") == "values", F.col("num").isNotNull() | F.col("txt").isNotNull())
        .otherwise(True)
    )
    used = F.col("counted") & usable
    number = F.when(used & (F.col("kind") == "range"), F.coalesce("num", F.col("txt").try_cast("double")))
    grouped = cells.join(F.broadcast(fields), "key").groupBy("key", "kind", "place", "key_unit").agg(
        F.count_if(used).alias("count"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.count_if(used & (F.col("kind") == "boolean") & F.col("flag")).alias("yes"), F.count_if(used & (F.col("kind") == "boolean") & ~F.col("flag")).alias("no"),
    )
    fails = items.select(failing_fields(filters, types).alias("fails"), "price", "currency")
    currencies = F.collect_set(F.when(F.col("price").isNotNull(), F.coalesce("currency", F.lit(""))))
    whole = fails.agg(
        F.count_if(F.size("fails") == 0).alias("pass_all"), F.when(F.size(currencies) == 1, F.nullif(F.get(currencies, F.lit(0)), F.lit(""))).alias("price_unit"),
        *(F.count_if((F.size("fails") == 1) & (F.get("fails", F.lit(0)) == k)).alias(f"only_{i}") for i, k in enumerate(order)),
    )
    only = F.lit(0)
    for i, k in enumerate(order):
        only = F.when(F.col("key") == k, F.col(f"only_{i}")).otherwise(only)
    joined = grouped.crossJoin(F.broadcast(whole))  # one row
    unit = F.when(F.col("key") == "price", F.col("price_unit")).otherwise(F.col("key_unit"))
    boolean = F.col("kind") == "boolean"
    return joined.select("key", "kind", "place", "count", (F.col("pass_all") + only - F.col("count")).alias("missing"), "low", "high", F.when(F.col("kind") == "range", unit).alias("unit"), F.when(boolean, F.col("yes")).alias("yes"), F.when(boolean, F.col("no")).alias("no"))


def facet_values(items: DataFrame, filters: Sequence[Filter], registry: Sequence[Key], cap: int = VALUE_CAP) -> DataFrame:
    """(key, value, count, more): the options of `values` fields, most frequent first up to `cap`, and the ticked ones in any case.

    Spellings that differ in case are one option, under its most frequent spelling (of equals, the one seen first by id).
    `more` is the number of options of the field that are not listed.
    """
    kinds = [k.key for k in registry if k.type == "string" and k.key not in LISTING_TYPES] + ["currency", "collection"]
    cells = facet_cells(items, filters, registry).where(F.col("counted") & F.col("key").isin(kinds) & (F.col("num").isNotNull() | F.col("txt").isNotNull()))
    spelling = F.coalesce("txt", number_text(F.col("num")))
    spelled = cells.groupBy("key", F.lower(spelling).alias("option"), spelling.alias("spelling")).agg(F.count("*").alias("n"), F.min("id").alias("seen"))
    options = spelled.groupBy("key", "option").agg(F.max_by("spelling", F.struct("n", -F.col("seen"))).alias("value"), F.sum("n").alias("count"))
    ticked = [(f.key, as_text(v), str(v)) for f in filters if f.key in kinds and f.op in ("eq", "in") for v in (f.value if isinstance(f.value, list | tuple) else [f.value]) if v is not None and not isinstance(v, bool)]
    # a rank with a limit is cut before its shuffle already, so a field of very many options sends `cap` of each task
    place = Window.partitionBy("key").orderBy(F.desc("count"), "value", "option")
    listed = options.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap).drop("place").withColumn("shown", F.lit(1))
    if ticked:
        chosen = F.broadcast(items.sparkSession.createDataFrame(list({t[:2]: t for t in ticked}.values()), "key string, option string, as_typed string"))  # a request's filters
        counted = options.join(chosen, ["key", "option"], "right").select("key", "option", F.coalesce("value", "as_typed").alias("value"), F.coalesce("count", F.lit(0)).alias("count"), F.col("count").isNotNull().cast("int").alias("shown"))
        listed = listed.unionByName(counted.join(listed.select("key", "option"), ["key", "option"], "left_anti"))
    # rows a field, of which a registry has few
    sizes = options.groupBy("key").agg(F.count("*").alias("options"))
    shown = listed.groupBy("key").agg(F.sum("shown").alias("shown"))
    more = F.coalesce("options", F.lit(0)) - F.col("shown")
    return listed.drop("shown").join(shown, "key").join(sizes, "key", "left").select("key", "value", "count", more.alias("more"))
