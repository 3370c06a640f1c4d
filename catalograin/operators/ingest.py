"""Ingest: merging crawled items, reusing extractions, classifying cards and marking what vanished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.change import removed_share
from ..functions.text import attribute_key, coerced

GONE_SHARE = 0.5
GONE_LEAST = 4
RELOAD_SHARE, REJECT_SHARE = 0.1, 0.3


def upsert(old: DataFrame, new: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """Items after a walk: `new` rows replace `old` ones of the same collection and url (one row each).

    The page's attributes replace the old ones, but values from the web (web: collection_id, url, key) stay where the page says
    nothing. Hashes stand if the new ones are null; an item that is seen is not gone. Rows of only one side stay as they are.
    """
    if web is None:
        web = old.select("collection_id", "url").where("false").withColumn("key", F.lit(""))
    kept = web.groupBy("collection_id", "url").agg(F.collect_set("key").alias("web_keys"))
    keys = ["collection_id", "url"]
    n = new.select(*keys, F.struct(*(F.col(c) for c in new.columns if c not in keys)).alias("n"))
    o = old.select(*keys, F.struct(*(F.col(c) for c in old.columns if c not in keys)).alias("o"))
    both = o.join(n, keys, "full").join(kept, keys, "left")
    empty = F.create_map().cast(old.schema["specs"].dataType)
    from_web = F.map_filter(F.coalesce("o.specs", empty), lambda k, _: F.coalesce(F.array_contains("web_keys", k), F.lit(False)))
    page = F.coalesce("n.specs", empty)
    specs = F.map_concat(F.map_filter(from_web, lambda k, _: ~F.map_contains_key(page, k)), page)

    def column(c: str):
        if c in keys:
            return F.col(c)
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        if c == "specs":
            value = specs
        elif c == "gone_at":
            value = F.lit(None).cast(old.schema[c].dataType)
        elif c.endswith("_hash") or c == "id":
            value = F.coalesce(f"o.{c}", f"n.{c}") if c == "id" else F.coalesce(f"n.{c}", f"o.{c}")
        else:
            value = F.col(f"n.{c}")
        return F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(value).alias(c)

    return both.select(*(column(c) for c in old.columns))


def mark_gone(items: DataFrame, seen: DataFrame, now: int, complete: bool = True) -> DataFrame:
    """`items` (of one collection) with gone_at set for active ones whose url was not seen.

    Nothing is marked if the walk was incomplete, or if of four or more active items over half would vanish.
    """
    if not complete:
        return items
    urls = seen.select(F.col("url").alias("seen_url")).distinct()
    flagged = items.join(urls, F.col("url") == F.col("seen_url"), "left").withColumn("lost", F.col("gone_at").isNull() & F.col("seen_url").isNull())
    share = flagged.agg(F.count_if(F.col("gone_at").isNull()).alias("active"), F.count_if("lost").alias("lost_n"))
    unsafe = (F.col("active") >= GONE_LEAST) & (F.col("lost_n") > GONE_SHARE * F.col("active"))
    marked = flagged.crossJoin(F.broadcast(share))  # one row
    return marked.select(*(F.when(F.col("lost") & ~unsafe, F.lit(now)).otherwise(F.col("gone_at")).alias(c) if c == "gone_at" else F.col(c) for c in items.columns))


def classify(cards: DataFrame, known: DataFrame, deep: bool = False) -> DataFrame:
    """`cards(url, card_hash)` with `kind` by `known(url, card_hash, gone_at)`: new, returned, changed, check (deep walks look again) or unchanged."""
    k = known.select("url", F.col("card_hash").alias("old_hash"), F.col("gone_at").isNotNull().alias("gone"))
    kind = (
        F.when(F.col("gone").isNull(), "new")
        .when(F.col("gone"), "returned")
        .when(~F.col("card_hash").eqNullSafe(F.col("old_hash")), "changed")
        .otherwise("check" if deep else "unchanged")
    )
    return cards.join(k, "url", "left").withColumn("kind", kind).drop("old_hash", "gone")


def render_verdict(share: str = "removed_share"):
    """What to do with a page of which that share of the known words is missing: reject it, load it again, or take it."""
    return F.when(F.col(share) > REJECT_SHARE, "reject").when(F.col(share) > RELOAD_SHARE, "reload").otherwise("take")


def visible(items: DataFrame, viewer_id: int | None = None) -> DataFrame:
    """Items whose page anyone may rely on: not `imported`, and of those read in someone's own browser (`browser_user`) only the viewer's. Columns that are absent say nothing."""
    if "imported" in items.columns:
        items = items.where(~F.coalesce("imported", F.lit(False)))
    if "browser_user" in items.columns:
        items = items.where(F.col("browser_user").isNull() | (F.col("browser_user") == F.lit(viewer_id)))
    return items


def reusable(wanted: DataFrame, items: DataFrame, sources: DataFrame | None = None, viewer_id: int | None = None) -> DataFrame:
    """For each `wanted(url, content_hash)` the newest `visible` extraction of the same page elsewhere: its id and the values its page states."""
    items = visible(items, viewer_id)
    best = items.where("content_hash IS NOT NULL").groupBy("url", "content_hash").agg(F.max_by(F.struct("id", "specs"), F.struct("indexed_at", "id")).alias("b"))
    found = wanted.select("url", "content_hash").distinct().join(best, ["url", "content_hash"]).select("url", "content_hash", "b.id", "b.specs")
    if sources is None:
        return found
    other = sources.groupBy("id").agg(F.collect_set("key").alias("other"))
    stated = F.map_filter("specs", lambda k, _: ~F.coalesce(F.array_contains("other", k), F.lit(False)))
    return found.join(other, "id", "left").select("url", "content_hash", "id", stated.alias("specs"))


def adopted(donor: DataFrame, registry: DataFrame, synonyms: DataFrame, skip: str = "focus") -> DataFrame:
    """(id, ordinal, key, value, type, unit) of a donor's attributes (also label), fitted to the `registry(key, type, unit)` that takes them over.

    A key that the registry lacks takes the first name (by `synonyms(key, synonym)`) that it has; values take the registry's type, and go
    if they can't. Of several for one key the first stays; the donor's own answer to another question (`skip`) goes.
    """
    known = registry.select(F.col("key").alias("own"), F.col("type").alias("own_type"), F.col("unit").alias("own_unit"))
    other = synonyms.join(known.select(F.col("own").alias("synonym")), "synonym", "left_semi").groupBy("key").agg(F.min("synonym").alias("synonym"))
    named = donor.join(known.select(F.col("own").alias("key"), F.lit(True).alias("has")), "key", "left").join(other, "key", "left")
    named = named.withColumn("own", F.when(F.col("has"), F.col("key")).otherwise(F.coalesce("synonym", "key"))).drop("key")
    fitted = named.join(known, "own", "left").withColumn("kind", F.coalesce("own_type", "type"))
    fitted = fitted.withColumn("value", coerced(F.col("value"), F.col("kind"))).where(F.col("value").isNotNull() & (F.col("own") != skip))
    first = fitted.withColumn("r", F.row_number().over(Window.partitionBy("id", "own").orderBy("ordinal"))).where("r = 1")
    return first.select("id", "ordinal", F.col("own").alias("key"), "value", F.col("kind").alias("type"), F.coalesce("own_unit", "unit").alias("unit"))


def normalized(tuples: DataFrame, registry: DataFrame, skip: str = "focus") -> DataFrame:
    """(id, place, key, value, type) of extracted `tuples(id, ordinal, name, value, type)`: keys in normal form, the registry's types, the last of several at the first one's place."""
    keyed = tuples.withColumn("key", attribute_key(F.col("name"))).where((F.col("key") != "") & (F.col("key") != skip))
    typed = keyed.join(registry.select("key", F.col("type").alias("own_type")), "key", "left").withColumn("kind", F.coalesce("own_type", "type"))
    typed = typed.withColumn("value", coerced(F.col("value"), F.col("kind"))).where("value IS NOT NULL")
    return last_wins(typed.select("id", "ordinal", "key", "value", F.col("kind").alias("type")), "id").select("id", "place", "key", "value", "type")


def last_wins(tuples: DataFrame, *groups: str) -> DataFrame:
    """Attribute tuples (groups, key, ordinal, ...) with one row per key: the last, at the first one's place."""
    each = Window.partitionBy(*groups, "key")
    placed = tuples.withColumn("place", F.min("ordinal").over(each)).withColumn("r", F.row_number().over(each.orderBy(F.desc("ordinal"))))
    return placed.where("r = 1").drop("r", "ordinal")


def walk_end(pages: DataFrame) -> DataFrame:
    """(walk_id, last_page, complete) of `pages(walk_id, page, new_items, items)`: a walk ends at an empty page or the second page in a row without news."""
    order = Window.partitionBy("walk_id").orderBy("page")
    stale = (F.col("new_items") == 0) & (F.coalesce(F.lag("new_items").over(order), F.lit(1)) == 0)
    ends = pages.withColumn("end", (F.col("items") == 0) | stale)
    return ends.groupBy("walk_id").agg(F.coalesce(F.min(F.when(F.col("end"), F.col("page"))), F.max("page")).alias("last_page"), F.max("end").alias("complete"))


def accepted_versions(visits: DataFrame) -> DataFrame:
    """(page, at, tries, share, verdict) of every visit in time order: what became of it, given the last version of its page that was accepted.

    visits: (page, at, attempt, tokens), tokens sorted and distinct as `change.tokens` has them; attempt 0 is the first load, and 1 a second one. Where more than RELOAD_SHARE of
    the known tokens are missing, the second load counts if less is missing from it; more than REJECT_SHARE missing then keeps what is known
    (`reject`), else the version is `same` or `changed`. The first version is `first`. `share` is what was missing of the load that counted, tries how many loads were needed.

    Whether a version counts depends on the last accepted one, not on the one before it, so a page's versions are folded in order: one page's versions meet in
    one row, and nothing else does.
    """
    loads = visits.groupBy("page", "at").agg(F.array_sort(F.collect_list(F.struct("attempt", "tokens"))).alias("loads"))
    pages = loads.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "loads"))).alias("visits"))
    verdicts = "array<struct<at:bigint,tries:int,share:double,verdict:string>>"
    start = F.struct(F.lit(None).cast("array<string>").alias("known"), F.array().cast(verdicts).alias("out"))

    def told(known: Column, visit: Column, load: Column, share: Column, tries: int) -> Column:
        tokens = load["tokens"]
        verdict = F.when(known.isNull(), "first").when(share > REJECT_SHARE, "reject").when(tokens == known, "same").otherwise("changed")
        row = F.struct(visit["at"].cast("bigint").alias("at"), F.lit(tries).alias("tries"), share.alias("share"), verdict.alias("verdict"))
        return F.struct(F.when(verdict == "reject", known).otherwise(tokens).alias("known"), row.alias("row"))

    def step(acc: Column, visit: Column) -> Column:
        known, first = acc["known"], visit["loads"][0]
        second = F.get(visit["loads"], F.lit(1))
        missing = lambda load: F.coalesce(removed_share(known, load["tokens"]), F.lit(0.0))
        lost = missing(first)
        again = (lost > RELOAD_SHARE) & second.isNotNull()
        better = again & (missing(second) < lost)
        one = F.when(better, told(known, visit, second, missing(second), 2)).when(again, told(known, visit, first, lost, 2)).otherwise(told(known, visit, first, lost, 1))
        return F.struct(one["known"].alias("known"), F.concat(acc["out"], F.array(one["row"])).alias("out"))

    return pages.select("page", F.explode(F.aggregate("visits", start, step)["out"]).alias("v")).select("page", "v.*")
