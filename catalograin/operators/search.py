"""Search: candidates, buckets, meaning, order and two pages, in one lineage."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, relevance
from ..plans.model import LISTING_TYPES, Key, Plan, Request, Sort, effective, highlight
from .compile import bucketed, candidates, has_value, scoped, typed_value
from .facets import facet_summary, facet_values
from .facts import fill

COVERAGE = 0.8
MAX_OFFERED = 5


def _types(registry: Iterable[Key]) -> dict[str, str]:
    return {k.key: k.type for k in registry}


def order_by(sort: Sort | None, types: dict[str, str], semantic: bool) -> list[Column]:
    """The sort key with missing values last either way, then score or recency, then id. A key nobody knows is ignored.

    Texts are in the order of readers: letters of either case and with accents side by side.
    """
    order = []
    kind = sort and (LISTING_TYPES.get(sort.key) or types.get(sort.key))
    if kind:
        column = typed_value(sort.key, kind)
        column = F.collate(column, "UNICODE") if kind == "string" else column.cast("double") if kind == "number" else column.cast("int")
        order.append(column.asc_nulls_last() if sort.dir == "asc" else column.desc_nulls_last())
    order.append(F.coalesce(F.col("score"), F.lit(-1.0)).desc() if semantic else F.col("indexed_at").desc())
    return [*order, F.col("id").asc()]


def matches(items: DataFrame, plan: Plan, registry: Sequence[Key], vectors: DataFrame | None = None, query: Sequence[float] | None = None) -> DataFrame:
    """Candidates with bucket, score and relevance (null unless the plan means something and a query vector is given).

    vectors: (id, vector). Only candidates are scored; only matched ones get a grade.
    """
    types = _types(registry)
    rows, active, _ = candidates(items, plan.filters, types)
    rows = bucketed(rows, active, types)
    if plan.semantic_text and query is not None and vectors is not None:
        rows = rows.join(vectors.select("id", "vector"), "id", "left")
        rows = rows.withColumn("score", F.when(F.col("bucket") == "matched", cosine(F.col("vector"), query))).drop("vector")
        best = rows.agg(F.max("score").alias("best"))  # one row
        rows = rows.crossJoin(F.broadcast(best)).withColumn("relevance", F.when(F.col("bucket") == "matched", relevance(F.col("score"), F.col("best")))).drop("best")
        return rows
    return rows.withColumn("score", F.lit(None).cast("double")).withColumn("relevance", F.lit(None).cast("string"))


def pages(rows: DataFrame, request: Request, plan: Plan, registry: Sequence[Key]) -> tuple[DataFrame, DataFrame]:
    """The page of matches and that of items that can't be judged yet; each a top-k, so no total sort is needed."""
    types = _types(registry)
    matched = rows.where("bucket = 'matched'").orderBy(*order_by(plan.sort, types, bool(plan.semantic_text)))
    unknown = rows.where("bucket = 'unknown'").orderBy(F.col("indexed_at").desc(), "id")
    return matched.offset(request.offset).limit(request.limit), unknown.offset(request.unknown_offset).limit(request.limit)


def totals(rows: DataFrame) -> DataFrame:
    """One row: total, unknown_total, strong_count (matches of high or medium relevance; null without meaning)."""
    strong = F.count_if(F.col("relevance").isin("high", "medium"))
    return rows.agg(
        F.count_if(F.col("bucket") == "matched").alias("total"),
        F.count_if(F.col("bucket") == "unknown").alias("unknown_total"),
        F.when(F.count("relevance") > 0, strong).alias("strong_count"),
    )


def search(items: DataFrame, request: Request, registry: Sequence[Key], collections: int | list[int] | None = None, vectors: DataFrame | None = None, query: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The page of matches, that of unknown items, and the totals."""
    plan = effective(request, registry)
    rows = matches(scoped(items, collections, request.include_gone), plan, registry, vectors, query)
    return *pages(rows, request, plan, registry), totals(rows)


def coverage(rows: DataFrame, keys: Iterable[str], registry: Sequence[Key], synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, covered, pool, poor): how many rows have each key or a synonym of it, in one pass."""
    types, keys = _types(registry), list(keys)
    seen = {}
    for key in keys:
        present = F.lit(False)
        for name in [key, *(synonyms or {}).get(key, ())]:
            present = present | has_value(name, types.get(name, types.get(key, "string")))
        seen[key] = F.count_if(present)
    counted = rows.agg(F.count("*").alias("pool"), *(c.alias(f"n{i}") for i, c in enumerate(seen.values())))
    listed = counted.select("pool", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"n{i}").alias("covered")) for i, k in enumerate(keys)))).alias("c"))
    return listed.select("c.key", "c.covered", "pool", ((F.col("pool") > 0) & (F.col("c.covered") < COVERAGE * F.col("pool"))).alias("poor"))


def offer(filled: DataFrame, aliases: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """One row: what a lookup is offered for: at most MAX_OFFERED attributes, and the listings, and distinct products, that still `need` one of them.

    filled: items as `facts.fill` returns them for these attributes.
    """
    asked = F.array(*map(F.lit, attributes[:MAX_OFFERED])).cast("array<string>")
    lacking = filled.where(F.arrays_overlap("need", asked)).join(aliases, "identity", "left")
    product = F.coalesce("canonical", F.nullif("identity", F.lit("")), F.lower("title"))
    return lacking.agg(F.count_distinct(product).alias("products"), F.count("*").alias("listings")).select(asked.alias("attributes"), "products", "listings")


@dataclass(frozen=True)
class Response:
    """What a request asks for: two pages and totals; with `facets` (fields, options of fields); with `enrich` the offer of a lookup, if there is one."""

    page: DataFrame
    unknown: DataFrame
    totals: DataFrame
    facets: tuple[DataFrame, DataFrame] | None = None
    offer: DataFrame | None = None


def respond(items: DataFrame, request: Request, registry: Sequence[Key], facts: DataFrame, aliases: DataFrame, collections: int | list[int] | None = None, vectors: DataFrame | None = None, query: Sequence[float] | None = None) -> Response:
    """`search`, with the facets of its scope and an offer where the request asks for them.

    An attribute is offered if the plan asks for it and the registry doesn't have it, or if less than COVERAGE of the items that match, or can't be judged yet, have it;
    facts (identity, key, value, found) and aliases (identity, canonical) tell what needs no lookup.
    """
    plan = effective(request, registry)
    scope = scoped(items, collections, request.include_gone)
    rows = matches(scope, plan, registry, vectors, query)
    listed = (facet_summary(scope, plan.filters, registry), facet_values(scope, plan.filters, registry)) if request.facets else None
    offered = None
    if request.enrich:
        pool = rows.where("bucket IN ('matched', 'unknown')")
        wanted, missing = [k for k in highlight(plan) if k not in LISTING_TYPES], {k.key for k in plan.missing}
        known = [k for k in wanted if k not in missing]
        poor = {r["key"] for r in coverage(pool, known, registry).where("poor").collect()} if known else set()  # keys of one plan
        asked = [k for k in wanted if k in missing or k in poor][:MAX_OFFERED]
        if asked:
            offered = offer(fill(pool, facts, asked), aliases, asked)
    return Response(*pages(rows, request, plan, registry), totals(rows), listed, offered)


def weak_divider(ranked: DataFrame) -> DataFrame:
    """One row: place of the first `low` row among matches in order (`place`, from 0) and the number of such rows."""
    low = F.col("relevance") == "low"
    return ranked.agg(F.min(F.when(low, F.col("place"))).alias("first_weak"), F.count_if(low).alias("weak"))


def ranked(rows: DataFrame, plan: Plan, registry: Sequence[Key], groups: Sequence[str] = ("collection_id",)) -> DataFrame:
    """Matches with their `place` (from 0) within each group."""
    order = Window.partitionBy(*groups).orderBy(*order_by(plan.sort, _types(registry), bool(plan.semantic_text)))
    return rows.where("bucket = 'matched'").withColumn("place", F.row_number().over(order) - 1)


def comparison(rows: DataFrame, keys: Iterable[str], registry: Sequence[Key]) -> DataFrame:
    """A table with one typed column for each key, the price first."""
    types = _types(registry)
    known = [k for k in dict.fromkeys(["price", *keys]) if k in types or k in LISTING_TYPES]
    return rows.select("id", "title", *(typed_value(k, types.get(k, LISTING_TYPES.get(k))).alias(k) for k in known if k != "title"))


def mixed_currency(page: DataFrame, sort: Sort | None) -> DataFrame:
    """One row: whether a page sorted by price holds several currencies."""
    return page.agg((F.lit(bool(sort and sort.key == "price")) & (F.count_distinct("currency") > 1)).alias("mixed"))


def by_ids(items: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Items in the order of their ids; unknown ids are left out. `ids` is a request's short list."""
    wanted = items.sparkSession.createDataFrame([(int(i), n) for n, i in enumerate(ids)], "id long, pos int")
    return items.join(F.broadcast(wanted), "id").orderBy("pos").drop("pos")
