"""The attribute registry: what keys items have, of which type and unit, and how keys are merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import PLAN_VERSION
from ..session import written
from ..sources.items import long_form
from .products import names_related

TOP_SAMPLES = 12
TOP_CURRENCIES = 10
#: Circles of aliases whose keys are broadcast; more meet the names by a shuffle.
MOST_BROADCAST = 50_000


def recount(items: DataFrame) -> DataFrame:
    """(collection_id, key, count): items that have each key."""
    return items.select("collection_id", F.explode(F.map_keys("specs")).alias("key")).groupBy("collection_id", "key").agg(F.count("*").alias("count"))


def upsert(registry: DataFrame, found: DataFrame) -> DataFrame:
    """`registry` with `found` rows (same columns) added: a known key keeps its type and label, counts add up, the first unit and example
    stand, and a key once stated by a page stays so."""
    both = registry.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("new", c))).alias(c)
    return both.groupBy("collection_id", "key").agg(first("type"), first("unit"), first("label"), first("example"), F.sum("count").alias("count"), F.min("origin").alias("origin"))


def merged(registry: DataFrame) -> DataFrame:
    """One row per key over all collections; keys of several types get the first by name and are marked."""
    return registry.groupBy("key").agg(
        F.min("type").alias("type"), F.max("unit").alias("unit"), F.max("label").alias("label"), F.max("example").alias("example"), F.sum("count").alias("count"), F.min("origin").alias("origin"),
        (F.min("type") != F.max("type")).alias("conflict"),
    )


def samples(items: DataFrame, top: int = TOP_SAMPLES) -> DataFrame:
    """(key, value, n): each key's most frequent text values, ties by value."""
    counted = long_form(items).where("txt IS NOT NULL").groupBy("key", F.col("txt").alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value"))).where(F.col("r") <= top).drop("r")


def ranges(items: DataFrame) -> DataFrame:
    """(key, low, high) of numbers."""
    return long_form(items).where("num IS NOT NULL").groupBy("key").agg(F.min("num").alias("low"), F.max("num").alias("high"))


def price_stats(items: DataFrame) -> DataFrame:
    return items.agg(F.min("price").alias("low"), F.max("price").alias("high"), F.any_value("currency", True).alias("currency"))


def currencies(items: DataFrame, top: int = TOP_CURRENCIES) -> DataFrame:
    counted = items.where("currency IS NOT NULL").groupBy("currency").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "currency").limit(top)


def apply_merges(items: DataFrame, merges: DataFrame) -> DataFrame:
    """`items` with bag keys renamed by `merges(from_key, to_key, factor)`.

    A value moves, times the factor and rounded to one decimal if it is a number, unless the item has the target already; the source
    goes in any case. Of several sources of one target, the first by name is taken. Merges are few, so they are broadcast as one map.
    """
    plan = merges.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("from_key", F.struct("to_key", "factor"))))).alias("plan"))
    rows = items.crossJoin(F.broadcast(plan))  # one row

    def moved(e: Column) -> Column:
        target = F.col("plan")[e["key"]]
        value = e["value"].withField("num", F.round(e["value"]["num"] * target["factor"], 1))
        return F.struct(target["to_key"].alias("key"), value.alias("value"))

    entries = F.map_entries("specs")
    old = F.filter(entries, lambda e: F.col("plan")[e["key"]].isNull())
    new = F.transform(F.array_sort(F.filter(entries, lambda e: F.col("plan")[e["key"]].isNotNull()), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), moved)
    kept = F.aggregate(new, old, lambda have, e: F.when(F.exists(have, lambda h: h["key"] == e["key"]), have).otherwise(F.concat(have, F.array(e))))
    return rows.withColumn("specs", F.when(F.col("plan").isNull() | F.col("specs").isNull(), F.col("specs")).otherwise(F.map_from_entries(kept))).drop("plan")


def _plan(merges: DataFrame) -> DataFrame:
    return merges.select(F.col("from_key").alias("key"), "to_key", "factor")


def merge_results(items: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, key, to_key, moved): the values that `apply_merges` takes from each item, and which of them it moves."""
    cells = items.select("id", "specs", F.explode(F.map_keys("specs")).alias("key")).join(F.broadcast(_plan(merges)), "key")  # merges are few
    free = ~F.map_contains_key(F.col("specs"), F.col("to_key"))
    first = F.row_number().over(Window.partitionBy("id", "to_key").orderBy("key")) == 1
    return cells.select("id", "key", "to_key", (free & first).alias("moved"))


def merged_sources(sources: DataFrame, items: DataFrame, merges: DataFrame) -> DataFrame:
    """Sources of values (id, key, ...) after a merge: they follow values that move, and go with those that don't."""
    found = merge_results(items, merges)
    joined = sources.join(found, ["id", "key"], "left").where(F.coalesce("moved", F.lit(True)))
    return joined.select(*(F.coalesce("to_key", "key").alias(c) if c == "key" else F.col(c) for c in sources.columns))


def merged_registry(registry: DataFrame, merges: DataFrame) -> DataFrame:
    """The registry without merged keys."""
    return registry.join(F.broadcast(_plan(merges).select("key")), "key", "left_anti")


def signatures(registry: DataFrame) -> DataFrame:
    """(collection_id, signature) of registry rows (collection_id, key, type, unit), as `plans.model.registry_signature` has it."""
    line = F.concat_ws(":", "key", "type", F.coalesce("unit", F.lit("")))
    lines = F.array_sort(F.collect_set(line))
    return registry.groupBy("collection_id").agg(F.sha1(F.array_join(F.concat(F.array(F.lit(f"v{PLAN_VERSION}")), lines), "\n").cast("binary")).alias("signature"))


def merge_aliases(merges: DataFrame) -> DataFrame:
    """(alias, key): merges that only rename, which hold for later extractions too."""
    return merges.where("factor = 1").select(F.col("from_key").alias("alias"), F.col("to_key").alias("key"))


def checked_merges(proposed: DataFrame, registry: DataFrame) -> DataFrame:
    """(from_key, to_key, factor) of `proposed(ordinal, from_key, to_key, factor)` that may be done, by `registry(key, type, count)`.

    Both keys are known, differ, have one type and related names. The key that more items have stands (then the shorter name, then the proposed
    one), with the factor turned round if need be; only numbers have one. A key is merged away once, and nothing is merged into such a key.
    """
    a = registry.select(F.col("key").alias("from_key"), F.col("type").alias("from_type"), F.col("count").alias("from_count"))
    b = registry.select(F.col("key").alias("to_key"), F.col("type").alias("to_type"), F.col("count").alias("to_count"))
    rows = proposed.join(a, "from_key").join(b, "to_key").where("from_key <> to_key AND from_type = to_type")
    rows = rows.where(names_related(F.col("from_key"), F.col("to_key"), F.col("from_type") == "boolean"))
    factor = F.when(F.col("from_type") == "number", F.coalesce("factor", F.lit(1.0))).otherwise(F.lit(1.0))
    turn = (F.col("to_count") < F.col("from_count")) | ((F.col("to_count") == F.col("from_count")) & (F.length("to_key") > F.length("from_key")))
    rows = rows.select(
        "ordinal", F.when(turn, F.col("to_key")).otherwise(F.col("from_key")).alias("from_key"), F.when(turn, F.col("from_key")).otherwise(F.col("to_key")).alias("to_key"),
        F.when(turn & (factor != 1), 1 / factor).otherwise(factor).alias("factor"),
    )
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("from_key").orderBy("ordinal"))).where("r = 1").drop("r", "ordinal")
    return first.join(first.select(F.col("from_key").alias("to_key")), "to_key", "left_anti").select("from_key", "to_key", "factor")


def searched_synonyms(merges: DataFrame, asked: DataFrame, registry: DataFrame) -> DataFrame:
    """(alias, key): checked merges which say that an `asked(key)` is a field the registry has, in the same unit."""
    found = merges.where("factor = 1").join(asked.select(F.col("key").alias("from_key")), "from_key", "left_semi").join(registry.select(F.col("key").alias("to_key")), "to_key", "left_semi")
    return found.select(F.col("from_key").alias("alias"), F.col("to_key").alias("key"))


def unchecked(asked: DataFrame, checks: DataFrame, sizes: DataFrame) -> DataFrame:
    """`asked(key)` not yet compared with each collection's registry at its present size; checks (key, collection_id, size), sizes (collection_id, size)."""
    compared = checks.join(sizes, ["collection_id", "size"]).groupBy("key").agg(F.count_distinct("collection_id").alias("compared"))
    all_ = sizes.agg(F.count_distinct("collection_id").alias("all"))
    rows = asked.join(compared, "key", "left").crossJoin(F.broadcast(all_))  # one row
    return rows.where(F.coalesce("compared", F.lit(0)) < F.col("all")).select(asked.columns)


def flat_aliases(pairs: DataFrame) -> DataFrame:
    """(alias, key) of `pairs(alias, canonical, ordinal)`: every name under the key that its chain of pairs ends at, keys under themselves.

    Of several pairs of one alias the last by `ordinal` counts. A pair that closes a circle, its last one, is refused. Each round joins the names
    that are under no key yet with the table, which doubles the steps they have gone, so the longest chain or circle of n pairs takes about
    log2(n) rounds. A name that meets itself as the least name on its way has gone round a circle; its last pair then gives the key of all
    names that came by there. Names under a key already take no part in a join, so a key of very many names is no single task's load.
    No side of a join is taken to be small for what its files weigh. Pairs with a null are ignored.
    """
    pairs = pairs.where("alias IS NOT NULL AND canonical IS NOT NULL").groupBy("alias").agg(F.max_by("canonical", F.struct("ordinal", "canonical")).alias("up"), F.max("ordinal").alias("ordinal"))
    pairs = written(pairs.where("alias <> up"))
    # low: the least name of those stepped on; top: the last pair of the steps, of several the first by name
    way = pairs.select("alias", "up", F.col("up").alias("low"), F.struct("ordinal", "alias").alias("top"))
    known = []
    while True:
        there = way.select(F.col("alias").alias("up"), F.col("up").alias("further"), F.col("low").alias("low_there"), F.col("top").alias("top_there"), F.lit(None).cast(pairs.schema["alias"].dataType).alias("key"))
        for more in known:
            there = there.unionByName(more.withColumnRenamed("alias", "up"), allowMissingColumns=True)
        met = way.join(there.withColumn("met", F.lit(True)).hint("merge"), "up", "left")
        key = F.when(F.col("met").isNull(), F.col("up")).otherwise(F.col("key"))  # what is no alias is a key
        later = (F.col("top_there.ordinal") > F.col("top.ordinal")) | ((F.col("top_there.ordinal") == F.col("top.ordinal")) & (F.col("top_there.alias") < F.col("top.alias")))
        top = F.when(later, F.col("top_there")).otherwise(F.col("top"))
        moved = written(met.select("alias", F.col("further").alias("up"), F.least("low", "low_there").alias("low"), top.alias("top"), key.alias("key")))
        on = moved.where("key IS NULL").drop("key")
        known.append(moved.where("key IS NOT NULL").select("alias", "key"))
        circles = on.where("alias = low").select("low", F.col("top.alias").alias("refused"))
        if n := circles.count():
            chosen = F.broadcast(circles) if n <= MOST_BROADCAST else circles.hint("merge")
            led = written(on.join(chosen, "low", "left"))
            known.append(led.where("refused IS NOT NULL").select("alias", F.col("refused").alias("key")))
            on = led.where("refused IS NULL").drop("refused")
        if on.isEmpty():
            break
        way = on
    flat = reduce(DataFrame.unionByName, known)
    alone = pairs.select("up").distinct().join(pairs.select(F.col("alias").alias("up")).hint("merge"), "up", "left_anti")
    return flat.unionByName(alone.select(F.col("up").alias("alias"), F.col("up").alias("key")))


def near_keys(facts: DataFrame, top: int = 300) -> DataFrame:
    """(key, products, unit, kind): looked-up keys by the number of products that have them."""
    grouped = facts.where("found").groupBy("key").agg(F.count_distinct("identity").alias("products"), F.max("unit").alias("unit"), F.max("kind").alias("kind"))
    return grouped.orderBy(F.desc("products"), "key").limit(top)
