"""State around searches and walks: plan cache, search history, provenance, single values, cards and hints, as table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = 10
QUOTE = 300


def cached_plans(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """`wanted(collection_id, query, signature)` with `plan` and `own`: the plan cached for that very collection, else the newest
    one of any collection for the same query and signature (used_at decides), to be copied."""
    keys = ["query", "signature"]
    best = cache.groupBy(*keys).agg(F.max_by("plan", F.struct("used_at", "collection_id")).alias("any_plan"))
    exact = cache.groupBy("collection_id", *keys).agg(F.max_by("plan", "used_at").alias("own_plan"))
    found = wanted.join(exact, ["collection_id", *keys], "left").join(best, keys, "left")
    return found.select("collection_id", *keys, F.coalesce("own_plan", "any_plan").alias("plan"), F.col("own_plan").isNotNull().alias("own"))


def used_plans(cache: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The cache (collection_id, query, signature, plan, hits, used_at) after `wanted` was looked up: own plans are hit once more, plans of others are copied."""
    keys = ["collection_id", "query", "signature"]
    found = cached_plans(wanted.select(*keys).distinct(), cache)
    hit = found.where("own").select(*keys, F.lit(True).alias("hit"))
    bumped = cache.join(hit, keys, "left").select(*keys, "plan", (F.col("hits") + F.when(F.col("hit"), 1).otherwise(0)).alias("hits"), F.when(F.col("hit"), now).otherwise(F.col("used_at")).alias("used_at"))
    return bumped.unionByName(found.where("NOT own AND plan IS NOT NULL").select(*keys, "plan", F.lit(1).cast("long").alias("hits"), now.alias("used_at")))


def slot(collection: Column, group: Column) -> Column:
    """Where a search belongs in a user's history: its collection, its group (negative), or everywhere (0)."""
    return F.coalesce(collection, -group, F.lit(0))


def history(searches: DataFrame) -> DataFrame:
    """(user_id, slot, query, hits, used_at) of single searches with `at`."""
    return searches.groupBy("user_id", "slot", "query").agg(F.count("*").alias("hits"), F.max("at").alias("used_at"))


def recent(searches: DataFrame, most: int = RECENT) -> DataFrame:
    """The newest queries of each user and slot."""
    place = F.row_number().over(Window.partitionBy("user_id", "slot").orderBy(F.desc("used_at"), "query"))
    return searches.withColumn("place", place).where(F.col("place") <= most)


def with_sources(items: DataFrame, sources: DataFrame) -> DataFrame:
    """`items` with `sources`: a map from key to where its value comes from (origin, url, confidence), for values not from the page."""
    nested = sources.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("origin", "url", "confidence"))))).alias("sources"))
    return items.join(nested, "id", "left")


def set_values(items: DataFrame, values: DataFrame) -> DataFrame:
    """`items` with `values(id, key, value)` put into their bags, new values before old ones; of several for one key the last by `ordinal`."""
    last = values.groupBy("id", "key").agg(F.max_by("value", "ordinal").alias("value"))
    new = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("new"))
    empty = F.create_map().cast(items.schema["specs"].dataType)
    put = F.map_concat(F.map_filter(F.coalesce("specs", empty), lambda k, _: ~F.map_contains_key(F.col("new"), k)), F.col("new"))
    joined = items.join(new, "id", "left")
    return joined.select(*(F.when(F.col("new").isNull(), F.col("specs")).otherwise(put).alias(c) if c == "specs" else F.col(c) for c in items.columns))


def set_sources(sources: DataFrame, values: DataFrame) -> DataFrame:
    """Sources (id, key, origin, url, confidence) after `values(id, key, ordinal, origin, url, confidence)` were set: the last of each replaces what was there."""
    last = values.groupBy("id", "key").agg(F.max_by(F.struct("origin", "url", "confidence"), "ordinal").alias("s")).select("id", "key", "s.*")
    return sources.join(last.select("id", "key"), ["id", "key"], "left_anti").select("id", "key", "origin", "url", "confidence").unionByName(last)


def without_key(items: DataFrame, key: str, collections: list[int] | None = None) -> DataFrame:
    """`items` without a key, in some collections or all: what a changed focus does to its answers."""
    dropped = F.map_filter("specs", lambda k, _: k != key)
    here = F.lit(True) if collections is None else F.col("collection_id").isin(collections)
    return items.withColumn("specs", F.when(here, dropped).otherwise(F.col("specs")))


def focus_answers(answers: DataFrame) -> DataFrame:
    """`answers(id, match, evidence)` as stored: a note only with a yes or no, its white space collapsed, at most QUOTE characters."""
    note = F.nullif(F.substring(F.btrim(F.regexp_replace("evidence", r"\s+", " ")), 1, QUOTE), F.lit(""))
    return answers.withColumn("evidence", F.when(F.col("match").isNotNull(), note))


def touch(items: DataFrame, seen: DataFrame) -> DataFrame:
    """`items` that a walk saw again (url, card_hash, content_hash) without extracting them: not gone, and new hashes where there are any."""
    s = seen.groupBy("url").agg(F.max("card_hash").alias("new_card"), F.max("content_hash").alias("new_content"), F.lit(True).alias("seen"))
    joined = items.join(s, "url", "left")
    new = {"gone_at": F.when(F.col("seen").isNull(), F.col("gone_at")), "card_hash": F.coalesce("new_card", "card_hash"), "content_hash": F.coalesce("new_content", "content_hash")}
    return joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in items.columns))


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (id, ...) with those of `new` in place of old ones."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def delete_vectors(old: DataFrame, ids: DataFrame) -> DataFrame:
    """Vectors without those of `ids(id)`."""
    return old.join(ids.select("id"), "id", "left_anti")


def focus_pending(items: DataFrame, collections: DataFrame) -> DataFrame:
    """Items whose answer is for another focus than their collection's (null counts as a focus of its own)."""
    c = collections.select(F.col("id").alias("c_id"), F.col("focus").alias("c_focus"))
    return items.join(c, F.col("collection_id") == F.col("c_id")).where(~F.col("focus_for").eqNullSafe(F.col("c_focus"))).select(*items.columns)


def save_cards(saved: DataFrame, job_id: int, cards: DataFrame) -> DataFrame:
    """A job's cards (pos, url, text) replaced by new ones, in order, none picked yet."""
    return saved.where(F.col("job_id") != job_id).unionByName(cards.select(F.lit(job_id).cast("long").alias("job_id"), "pos", "url", "text", F.lit(None).cast("boolean").alias("picked")))


def pick_cards(saved: DataFrame, job_id: int, urls: DataFrame) -> DataFrame:
    """A job's cards with exactly the chosen urls picked."""
    chosen = urls.select(F.col("url").alias("chosen")).distinct()
    marked = saved.join(chosen, F.col("url") == F.col("chosen"), "left")
    picked = F.when(F.col("job_id") == job_id, F.col("chosen").isNotNull()).otherwise(F.col("picked"))
    return marked.select("job_id", "pos", "url", "text", picked.alias("picked"))


def recrawl_hints(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(collection_id, max_items, max_pages, pages_seen, active_items) of every collection with walks or items: the largest limits that past listing walks
    asked for, the most pages that one saw, and how many items are still listed; 0 where there are none.

    jobs: (collection_id, type, params as JSON, pages_seen); a limit that isn't a number counts as none. items: (collection_id, gone_at).
    """
    params = F.try_parse_json("params")

    def asked(name: str) -> Column:
        number = F.schema_of_variant(F.try_variant_get(params, f"$.{name}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return F.coalesce(F.max(F.when(number, F.try_variant_get(params, f"$.{name}", "long"))), F.lit(0)).alias(name)

    walks = jobs.where("type = 'listing'").groupBy("collection_id").agg(asked("max_items"), asked("max_pages"), F.coalesce(F.max("pages_seen"), F.lit(0)).alias("pages_seen"))
    active = items.groupBy("collection_id").agg(F.count_if(F.col("gone_at").isNull()).alias("active_items"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return walks.join(active, "collection_id", "full").select("collection_id", *map(zero, ("max_items", "max_pages", "pages_seen", "active_items")))


def category_of_crumbs(crumbs: Column, host: str, page: str) -> Column:
    """The deepest linked breadcrumb (array of struct<name, url>) of the same host that is neither its home nor the page itself."""
    fits = F.filter(crumbs, lambda c: (F.try_parse_url(c["url"], F.lit("HOST")) == host) & (F.coalesce(F.try_parse_url(c["url"], F.lit("PATH")), F.lit("")).rlike("^/.+")) & (c["url"] != page))
    return F.try_element_at(fits, F.lit(-1))


def prompt_text(html: Column, head: int = 160_000, tail: int = 40_000) -> Column:
    """Markup made short for a reader: no scripts, styles or comments, attributes only where they identify, white space collapsed; of a long page its head and tail."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    plain = F.regexp_replace(plain, r"""(?i)\s(?!(?:class|id|href|src|rel|alt|title|type|property|content|itemprop|data-testid)=)[a-z][a-z0-9:_-]*=("[^"]*"|'[^']*')""", "")
    plain = F.btrim(F.regexp_replace(plain, r"\s+", " "))
    return F.when(F.length(plain) <= head + tail, plain).otherwise(F.concat(F.substring(plain, 1, head), F.lit(" … "), F.right(plain, F.lit(tail))))


def card_url_scores(links: DataFrame, pattern: str | None = None, cards: DataFrame | None = None) -> DataFrame:
    """(page_id, card, url, score, first): how likely each link of a card is the item's own; the best is the item. first: its first place in the card.

    links: (page_id, card, pos, url, in_title, has_image). Each time that a link stands in the card counts one, two more in a title, one more with an image,
    a half more if nothing stands before it. Once a link, a hundred for the pattern of item URLs, minus five if it stands in a third
    of the page's cards (three at least). cards: (page_id, cards), how many cards a page has; without it, those with links.
    """
    if cards is None:
        cards = links.groupBy("page_id").agg(F.count_distinct("card").alias("cards"))
    point = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    own = F.lit(1.0) + point(F.col("in_title"), 2) + point(F.col("has_image"), 1)
    first = links.groupBy("page_id", "card").agg(F.min("pos").alias("start"))
    each = links.withColumn("own", own).groupBy("page_id", "card", "url").agg(F.sum("own").alias("own"), F.min("pos").alias("first"))
    shared = each.groupBy("page_id", "url").agg(F.count("*").alias("in_cards"))
    rows = each.join(first, ["page_id", "card"]).join(shared, ["page_id", "url"]).join(cards, "page_id")
    score = F.col("own") + point(F.col("first") == F.col("start"), 0.5) - point(F.col("in_cards") >= F.greatest(F.lit(3.0), F.ceil(0.3 * F.col("cards"))), 5)
    if pattern:
        score = score + point(F.col("url").rlike(pattern), 100)
    return rows.select("page_id", "card", "url", score.alias("score"), "first")
