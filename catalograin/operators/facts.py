"""Facts about products: the cache, values of sibling listings, filling items, and what to look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import visible

CONFIDENT = 0.6
OTHER_BRAND_CAP = 0.3
SIBLING_CONFIDENCE = 0.95
NOT_FOUND_DAYS = 30
MAX_LOOKUPS = 15
MAX_EXTRAS = 12


def usable(facts: DataFrame, now: Column, not_found_days: int = NOT_FOUND_DAYS) -> DataFrame:
    """Facts that count: found ones, and not-found ones younger than the days given (0: of any age). fetched_at and now are timestamps."""
    if not_found_days == 0:
        return facts
    return facts.where(F.col("found") | (F.col("fetched_at") > now - F.expr(f"INTERVAL {not_found_days} DAYS")))


def cached(wanted: DataFrame, facts: DataFrame, aliases: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(identity, key, value, found, ...): the best cached fact for each `wanted(identity, key)`.

    Facts of any name of the product (aliases: identity, canonical) and any synonym of the key (synonyms: key, synonym) count. A found
    fact goes before a not-found one, the asked key before its synonyms, then the product's own name, then by name.
    """
    names = aliases.select("identity", "canonical")
    asked = wanted.select("identity", "key").distinct().join(names, "identity", "left").withColumn("canonical", F.coalesce("canonical", "identity"))
    own = asked.select("identity", "key", F.col("identity").alias("name"), F.lit(0).alias("name_rank"))
    root = asked.select("identity", "key", F.col("canonical").alias("name"), F.lit(1).alias("name_rank"))
    others = asked.join(names.select(F.col("identity").alias("name"), "canonical"), "canonical").select("identity", "key", "name", F.lit(2).alias("name_rank"))
    by_name = own.unionByName(root).unionByName(others).groupBy("identity", "key", "name").agg(F.min("name_rank").alias("name_rank"))
    same = by_name.select("*", F.col("key").alias("fact_key"), F.lit(0).alias("key_rank"))
    alike = by_name.join(synonyms.select("key", F.col("synonym").alias("fact_key")), "key").where("key <> fact_key").withColumn("key_rank", F.lit(1))
    probes = same.unionByName(alike.select(same.columns))
    found = probes.join(facts.withColumnRenamed("identity", "name").withColumnRenamed("key", "fact_key"), ["name", "fact_key"])
    best = Window.partitionBy("identity", "key").orderBy(F.col("found").desc(), "key_rank", "fact_key", "name_rank", "name")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "key_rank", "name_rank", "name", "fact_key")


def sibling_values(items: DataFrame, aliases: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(canonical, key, value, url, confidence): a value stated on the page of some listing of the product, of those that nobody imported or read in a browser of their own.

    Zero, blank text and values that came from elsewhere (sources: id, key) don't count; the oldest listing's is taken.
    """
    named = visible(items).join(aliases, "identity", "left").withColumn("canonical", F.coalesce("canonical", "identity")).where(F.coalesce("canonical", F.lit("")) != "")
    cells = named.select("id", "canonical", "url", F.explode("specs").alias("key", "value"))
    stated = cells.where(F.col("value.flag").isNotNull() | (F.coalesce(F.col("value.num"), F.lit(0.0)) != 0) | (F.btrim(F.coalesce("value.txt", F.lit(""))) != ""))
    if sources is not None:
        stated = stated.join(sources.select("id", "key"), ["id", "key"], "left_anti")
    first = F.min_by(F.struct("value", "url"), "id")
    return stated.groupBy("canonical", "key").agg(first.alias("s")).select("canonical", "key", "s.value", "s.url", F.lit(SIBLING_CONFIDENCE).alias("confidence"))


def _names_of(keys: list[str], synonyms: DataFrame | None) -> dict[str, list[str]]:
    """Each of the asked keys with its synonyms, itself first."""
    names = {k: [k] for k in keys}
    if synonyms is not None:  # rows of the few keys that are asked for
        for r in synonyms.where(F.col("key").isin(keys)).select("key", "synonym").distinct().orderBy("key", "synonym").collect():
            names[r["key"]] += [r["synonym"]] if r["synonym"] not in names[r["key"]] else []
    return names


def fill(items: DataFrame, facts: DataFrame, keys: list[str], synonyms: DataFrame | None = None) -> DataFrame:
    """`items` with found facts (identity, key, value, found) put into bags that lack the key, and `need`: keys still without an answer.

    synonyms: (key, synonym); a value or a fact under a synonym counts as one of the key. Of several facts of a product and key a found one counts before one
    that says there is none, one of the key itself before those of synonyms, then the first by synonym and value.
    """
    names = _names_of(keys, synonyms)
    spelt = [(name, k, place) for k, all_names in names.items() for place, name in enumerate(all_names)]
    own = F.broadcast(items.sparkSession.createDataFrame(spelt, "key string, asked string, place int"))  # the keys of one request
    best = F.min_by(F.struct("value", "found"), F.struct(~F.col("found"), "place", F.to_json("value")))
    asked = facts.join(own, "key").withColumn("found", F.coalesce("found", F.lit(False))).groupBy("identity", "asked").agg(best.alias("f"))
    asked = asked.groupBy("identity").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("f.found"), F.struct("asked", "f.value")))).alias("have"), F.collect_set("asked").alias("answered")
    )
    joined = items.join(asked, "identity", "left")
    none = F.create_map().cast(items.schema["specs"].dataType)
    bag = F.coalesce("specs", none)
    has = F.array_compact(F.array(*(F.when(F.arrays_overlap(F.map_keys(bag), F.array(*map(F.lit, all_names))), F.lit(k)) for k, all_names in names.items())))
    new = F.map_filter(F.coalesce("have", none), lambda k, _: ~F.array_contains(has, k))
    lacking = F.array_except(F.array_except(F.array(*map(F.lit, keys)), F.array_union(has, F.map_keys(new))), F.coalesce("answered", F.array().cast("array<string>")))
    return joined.select(*(c for c in items.columns if c != "specs"), F.map_concat(bag, new).alias("specs"), lacking.alias("need"))


def accepted(answers: DataFrame, least: float = CONFIDENT) -> DataFrame:
    """Looked-up answers as facts: another brand's source lowers the confidence and voids the value, and only confident ones are found.

    answers: identity, key, value, confidence, source_brand_ok (boolean), asked (boolean). Extras, which nobody asked for, are kept only
    if found.
    """
    confidence = F.when(F.col("source_brand_ok"), F.col("confidence")).otherwise(F.least("confidence", F.lit(OTHER_BRAND_CAP)))
    found = F.col("source_brand_ok") & F.col("value").isNotNull() & (F.col("confidence") >= least)
    rows = answers.withColumn("found", F.coalesce(found, F.lit(False))).withColumn("confidence", confidence)
    return rows.withColumn("value", F.when(F.col("found"), F.col("value"))).where(F.col("found") | F.col("asked"))


def lookup_order(items: DataFrame, aliases: DataFrame, most: int = MAX_LOOKUPS) -> DataFrame:
    """(canonical, listings): products to look up now, those with most listings first (a top-k)."""
    named = items.join(aliases, "identity", "left").withColumn("canonical", F.coalesce("canonical", F.nullif("identity", F.lit("")), F.lower("title"))).where("canonical IS NOT NULL")
    return named.groupBy("canonical").agg(F.count("*").alias("listings")).orderBy(F.desc("listings"), "canonical").limit(most)


def lookup_stats(items: DataFrame, aliases: DataFrame, keys: list[str], known: DataFrame, siblings: DataFrame, most: int = MAX_LOOKUPS) -> DataFrame:
    """One row about the items that lack some of `keys`: listings, products, merged (names other than their product's), cached (products that need no
    lookup), from_siblings (values of products that only another listing states), to_look_up (at most `most`) and remaining products.

    known: (canonical, key) of cached facts, found or not; siblings: (canonical, key) of values that other listings state.
    """
    name = F.coalesce(F.nullif("identity", F.lit("")), F.lower("title"))
    wanted = F.array(*map(F.lit, keys))
    lacking = F.array_except(wanted, F.coalesce(F.map_keys("specs"), F.array().cast("array<string>")))
    named = items.join(aliases, "identity", "left").select(name.alias("name"), F.coalesce("canonical", name).alias("canonical"), lacking.alias("lacking")).where(F.size("lacking") > 0)
    counted = named.agg(F.count("*").alias("listings"), F.count_distinct("canonical").alias("products"), F.count_distinct(F.when(F.col("name") != F.col("canonical"), F.struct("name", "canonical"))).alias("merged"))
    pairs = named.select("canonical", F.explode("lacking").alias("key")).distinct()
    open_ = pairs.join(known.select("canonical", "key"), ["canonical", "key"], "left_anti")
    stated = open_.join(siblings.select("canonical", "key"), ["canonical", "key"], "left_semi").agg(F.count("*").alias("from_siblings"))
    asked = open_.join(siblings.select("canonical", "key"), ["canonical", "key"], "left_anti").agg(F.count_distinct("canonical").alias("asked"))
    rows = counted.crossJoin(stated).crossJoin(asked)  # one row each
    return rows.select(
        "listings", "products", "merged", (F.col("products") - F.col("asked")).alias("cached"), "from_siblings", F.least("asked", F.lit(most)).alias("to_look_up"), F.greatest(F.col("asked") - most, F.lit(0)).alias("remaining")
    )


def to_ask(wanted: DataFrame, in_flight: DataFrame, aliases: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(canonical, key): each product and key of `wanted(identity, key)` once, without those that some job is asking for already.

    aliases: (identity, canonical); synonyms: (key, synonym), a key standing for its synonyms.
    """
    own = synonyms.select(F.col("synonym").alias("key"), F.col("key").alias("own"))
    named = lambda df: df.join(aliases, "identity", "left").join(own, "key", "left").select(F.coalesce("canonical", "identity").alias("canonical"), F.coalesce("own", "key").alias("key")).distinct()
    return named(wanted).join(named(in_flight), ["canonical", "key"], "left_anti")


def extras(ranked: DataFrame, asked: DataFrame, stated: DataFrame, known: DataFrame, most: int = MAX_EXTRAS) -> DataFrame:
    """(identity, key): further keys worth asking for on the same lookup, from `ranked(identity, key, rank)`, without those asked, stated or cached."""
    rest = ranked
    for other in (asked, stated, known):
        rest = rest.join(other.select("identity", "key"), ["identity", "key"], "left_anti")
    order = Window.partitionBy("identity").orderBy("rank", "key")
    return rest.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("identity", "key")
