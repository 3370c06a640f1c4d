"""Changes to products and collections by hand or by proposal: merging and splitting names, checking proposed groups, and who owns what."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .products import FEATURES, POWER_TOLERANCE, with_features

MOST_KNOWN = 200


def merge_canonical(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """`aliases(identity, canonical)` after `merges(source, target)`: every name of a product `source`, and that name itself, is one of `target`.

    The target names itself from then on, if it was no name yet. Sources are distinct and no targets; merges of a name with itself do nothing.
    """
    merges = merges.where("source <> target")
    moved = aliases.join(merges.withColumnRenamed("source", "canonical"), "canonical", "left").select("identity", F.coalesce("target", "canonical").alias("canonical"))
    moved = moved.join(merges.select(F.col("source").alias("identity")), "identity", "left_anti").unionByName(merges.select(F.col("source").alias("identity"), F.col("target").alias("canonical")))
    own = merges.select(F.col("target").alias("identity")).distinct().join(moved, "identity", "left_anti")
    return moved.unionByName(own.select("identity", F.col("identity").alias("canonical")))


def split_identity(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """`aliases` in which each of `names(identity)` is a product of its own again."""
    names = names.select("identity").distinct()
    return aliases.join(names, "identity", "left_anti").unionByName(names.select("identity", F.col("identity").alias("canonical")))


def reject_pairs(rejections: DataFrame, pairs: DataFrame) -> DataFrame:
    """`rejections(a, b)`, a < b, with `pairs(x, y)` that are told apart, each once whatever its order."""
    new = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return rejections.select("a", "b").unionByName(new).distinct()


def known_names(aliases: DataFrame, facts: DataFrame, brands: DataFrame, most: int = MOST_KNOWN) -> DataFrame:
    """(brand, identity): at most `most` names known for each of `brands(brand)`: products grouped or looked up, the first by name.

    A name belongs to the brand that is its first word, if more follows. Joined on that word, not by comparing each name with each brand.
    """
    names = aliases.select(F.col("canonical").alias("identity")).union(facts.select("identity")).distinct()
    named = names.where(F.col("identity").contains(" ")).withColumn("brand", F.substring_index("identity", " ", 1)).join(brands.select("brand").distinct(), "brand", "left_semi")
    return named.withColumn("r", F.row_number().over(Window.partitionBy("brand").orderBy("identity"))).where(F.col("r") <= most).select("brand", "identity")


def checked_groups(proposed: DataFrame, aliases: DataFrame, rejections: DataFrame) -> DataFrame:
    """(identity, canonical) of groups that a model proposed, as far as the rules allow.

    proposed: (call, grp, pos, name, fresh, first): names of a group in order; `fresh` for names never grouped, else they are known products; `first` for
    the name proposed as canonical. A known product goes before a fresh one as canonical, and stands for its own canonical name. A fresh
    name joins if it is certainly the same product as the canonical and as all accepted before it, and was not told apart from
    the canonical; it joins one group at most. A fresh name that others join stays on its own. A call has a bounded number of names.
    """
    roots = aliases.select(F.col("identity").alias("name"), "canonical")
    rows = proposed.join(roots, "name", "left").withColumn("root", F.coalesce("canonical", "name")).drop("canonical")
    names = rows.select("name").union(rows.select(F.col("root"))).distinct().select(F.col("name").alias("identity"))
    told = rejections.select(F.col("a").alias("identity"), F.col("b").alias("other")).union(rejections.select("b", "a")).groupBy("identity").agg(F.collect_set("other").alias("rejected"))
    features = with_features(names).join(told, "identity", "left")
    own = features.select(F.col("identity").alias("name"), *("brand", *FEATURES, "rejected"))
    root = features.select(F.col("identity").alias("root"), F.struct("identity", "brand", *FEATURES, "rejected").alias("root_features"))
    rows = rows.join(own, "name").join(root, "root").withColumnRenamed("name", "identity")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, str] = {}
        for _, members in group.sort_values(["grp", "pos"]).groupby("grp", sort=True):
            listed = list(members.itertuples())
            known = [m for m in listed if not m.fresh]
            head = known[0] if known else next((m for m in listed if m.first), listed[0])
            main, accepted = _Row(head.root_features), []
            for m in listed:
                if not m.fresh or m.identity in out or m.identity == main.identity:
                    continue
                if _same(m, main) and all(_same(m, a) for a in accepted):
                    out[m.identity] = main.identity
                    accepted.append(m)
        for target in set(out.values()):
            out.pop(target, None)
        return pd.DataFrame({"identity": list(out), "canonical": list(out.values())}, dtype=object)

    return rows.groupBy("call").applyInPandas(check, "identity string, canonical string")


class _Row:
    def __init__(self, fields):
        self.__dict__.update(fields if isinstance(fields, dict) else fields.asDict())


def _compatible(a, b) -> bool:
    """Two rows of one brand with equal words: neither told apart nor contradicting."""
    if any(b.identity == r for r in (a.rejected if a.rejected is not None else ())) or not a.brand:
        return False
    for c in ("years", "disp", "gear", "combustion", "electrified"):
        x, y = list(getattr(a, c)), list(getattr(b, c))
        if x and y and x != y:
            return False
    near = lambda xs, ys: all(any(abs(x - y) <= POWER_TOLERANCE * max(x, y) for y in ys) for x in xs)
    p, q = list(a.power), list(b.power)
    return not p or not q or near(p, q) and near(q, p)


def _same(a, b) -> bool:
    return a.brand == b.brand and list(a.words) == list(b.words) and _compatible(a, b)


def collections_with_owners(collections: DataFrame, users: DataFrame) -> DataFrame:
    """`collections` with `owner`, the name of the user they belong to, or null."""
    return collections.join(users.select(F.col("id").alias("owner_id"), F.col("name").alias("owner")), "owner_id", "left")


def group_scope(members: DataFrame, readable: DataFrame, groups: Sequence[int]) -> DataFrame:
    """(collection_id): collections of `members(group_id, collection_id)` of some groups that the viewer can read (`readable(collection_id)`)."""
    return members.where(F.col("group_id").isin(list(groups))).select("collection_id").distinct().join(readable.select("collection_id"), "collection_id", "left_semi")


def group_counts(members: DataFrame, readable: DataFrame, items: DataFrame) -> DataFrame:
    """(group_id, items): active items in the collections of each group that the viewer can read; a group without any has 0."""
    counts = items.where("gone_at IS NULL").groupBy("collection_id").agg(F.count("*").alias("n"))
    seen = members.select("group_id", "collection_id").distinct().join(readable.select("collection_id").distinct().withColumn("ok", F.lit(True)), "collection_id", "left").join(counts, "collection_id", "left")
    return seen.groupBy("group_id").agg(F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("items"))


def collection_summary(items: DataFrame, aliases: DataFrame, costs: DataFrame, focus: DataFrame) -> DataFrame:
    """(collection_id, items, active, manual, priced, products, cost, pending) of each collection that has items.

    items also has `manual` and `focus_for`; aliases: (identity, canonical); costs: (collection_id, cost); focus: (collection_id, focus). Products are
    those of active items; pending are active items whose answer is for another focus than the collection's.
    """
    named = items.join(aliases, "identity", "left").join(focus, "collection_id", "left")
    product = F.coalesce("canonical", F.nullif("identity", F.lit("")), F.lower(F.btrim("title")))
    active = F.col("gone_at").isNull()
    counted = named.groupBy("collection_id").agg(
        F.count("*").alias("items"), F.count_if(active).alias("active"), F.count_if("manual").alias("manual"), F.count("price").alias("priced"),
        F.count_distinct(F.when(active, product)).alias("products"), F.count_if(active & F.col("focus").isNotNull() & ~F.col("focus_for").eqNullSafe(F.col("focus"))).alias("pending"),
    )
    spent = costs.groupBy("collection_id").agg(F.sum("cost").alias("cost"))
    return counted.join(spent, "collection_id", "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def cards_of_jobs(cards: DataFrame, jobs: DataFrame, items: DataFrame) -> DataFrame:
    """`cards(job_id, url, ...)` with their job's collection and whether that has an item of this url already (`saved`)."""
    joined = cards.join(jobs.select(F.col("id").alias("job_id"), "collection_id"), "job_id")
    have = items.select("collection_id", "url").distinct().withColumn("has", F.lit(True))
    return joined.join(have, ["collection_id", "url"], "left").withColumn("saved", F.col("has").isNotNull()).drop("has")
