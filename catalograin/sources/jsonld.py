"""What JSON-LD bodies of pages say: their nodes, products, breadcrumbs and values to start from.

A body is a VARIANT. It is taken apart level by level with `variant_explode`, so each level of nesting is one step over all pages at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import with_checkpoints
from .tree import text_content

PRODUCT = r"(?i)^(Product|Vehicle|Car|IndividualProduct|ProductModel|Motorcycle)$"
CRUMBS = r"(?i)^BreadcrumbList$"
#: Types by a part of their name, of which a page's own values are taken.
SOLD = r"(?i)Product|Vehicle|Car|IndividualProduct"
DESCRIPTION = 2_000


def bodies(nodes: DataFrame) -> DataFrame:
    """(page_id, body, v): the JSON-LD scripts among `page_nodes`, by their number, as VARIANT; what is not JSON is left out."""
    text = nodes.where("tag = '#text' AND attrs['type'] = 'application/ld+json'")
    return text.select("page_id", F.col("parent").alias("body"), F.try_parse_json("text").alias("v")).where("v IS NOT NULL")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text_at(v: Column, path: str) -> Column:
    """The string at `path`; null if there is none or something else."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(_kind(found) == "STRING", F.try_variant_get(v, path, "string"))


def types_of(v: Column) -> Column:
    """The strings of `@type`, one or a list."""
    found = F.try_variant_get(v, "$['@type']", "variant")
    many = F.transform(F.coalesce(F.try_variant_get(v, "$['@type']", "array<variant>"), F.array()), lambda x: text_at(x, "$"))
    one = text_at(v, "$['@type']")
    return F.when(one.isNotNull(), F.array(one)).when(_kind(found) == "ARRAY", F.filter(many, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def _typed(pattern: str) -> Column:
    return F.exists("types", lambda t: t.rlike(pattern))


def _trimmed(text: Column) -> Column:
    """Without white space at its ends; nothing left is null."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def _children(level: DataFrame) -> DataFrame:
    """`level` with pos, key and value of each entry of its lists and objects; pos counts entries, and an object's in the order of their names."""
    return level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer())).withColumnsRenamed({"pos": "entry", "key": "name", "value": "child"})


def walk(bodies: DataFrame) -> DataFrame:
    """(page_id, body, at, depth, types, times, root, v): every object that a walk through the bodies meets.

    at: the numbers of the entries that lead to it, outermost first; times: how often the walk meets it, since a `@graph` is walked for itself and
    as an entry, in objects without a type that ends the walk. Products and breadcrumbs aren't walked further: related products don't make a page a list.
    root: whether only lists and graphs lie around it.
    """
    with_checkpoints(bodies.sparkSession)
    level = bodies.select("page_id", "body", F.array().cast("array<int>").alias("at"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("root"), "v")
    found = None
    while True:
        level = level.withColumn("kind", _kind(F.col("v"))).where("kind IN ('OBJECT', 'ARRAY')").withColumn("types", types_of(F.col("v"))).checkpoint()
        if level.isEmpty():
            break
        objects = level.where("kind = 'OBJECT'")
        found = objects if found is None else found.unionByName(objects)
        product, crumbs = _typed(PRODUCT), _typed(CRUMBS)
        listed = F.coalesce(_kind(F.try_variant_get("v", "$.itemListElement", "variant")) == "ARRAY", F.lit(False))
        ends = (F.col("kind") == "OBJECT") & (product | crumbs & listed)
        inner = _children(level.withColumn("ends", ends))
        graph = F.coalesce((F.col("kind") == "OBJECT") & (F.col("name") == "@graph"), F.lit(False))
        inner = inner.where(~F.col("ends") | graph)
        times = F.col("times") * F.when(graph & ~F.col("ends"), 2).otherwise(1)
        root = F.col("root") & ((F.col("kind") == "ARRAY") | graph)
        level = inner.select("page_id", "body", F.concat("at", F.array(F.col("entry").cast("int"))).alias("at"), times.alias("times"), root.alias("root"), F.col("child").alias("v"))
    if found is None:
        found = level
    return found.select("page_id", "body", "at", F.size("at").alias("depth"), "types", "times", "root", "v")


def page_types(found: DataFrame) -> DataFrame:
    """(page_id, ld_types, product_nodes, product_name) of walked objects: types by name with repeats, how many products, and the first one's name."""
    product = _typed(PRODUCT)
    types = F.flatten(F.transform(F.sequence(F.lit(1), F.col("times")), lambda _: F.col("types")))
    rows = found.select("page_id", "body", "at", types.alias("types"), F.when(product, F.col("times")).otherwise(0).alias("products"), F.when(product, text_at(F.col("v"), "$.name")).alias("name"))
    named = F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("body", "at")))
    return rows.groupBy("page_id").agg(F.array_sort(F.flatten(F.collect_list("types"))).alias("ld_types"), F.sum("products").alias("product_nodes"), named.alias("product_name"))


def crumbs(found: DataFrame) -> DataFrame:
    """(page_id, place, position, name, url): the entries of breadcrumb lists by position (their own number, else their place), then by place.

    An entry's name is its own or its item's; its address is its item itself, or the item's `@id` or `url`.
    """
    lists = found.where(_typed(CRUMBS) & F.coalesce(_kind(F.try_variant_get("v", "$.itemListElement", "variant")) == "ARRAY", F.lit(False)))
    entries = F.try_variant_get("v", "$.itemListElement", "array<variant>")
    rows = lists.select("page_id", "body", "at", F.posexplode(entries).alias("entry", "e"))
    e = F.col("e")
    name = F.coalesce(text_at(e, "$.name"), text_at(e, "$.item.name"), F.lit(""))
    url = F.coalesce(text_at(e, "$.item"), text_at(e, "$.item['@id']"), text_at(e, "$.item.url"))
    own = F.try_variant_get(e, "$.position", "double")
    together = F.array_sort(F.collect_list(F.struct("body", "at", "entry", name.alias("name"), url.alias("url"), F.when(own != 0, own).alias("own"))))
    by_page = rows.groupBy("page_id").agg(together.alias("c")).select("page_id", F.posexplode("c").alias("n", "c"))
    placed = by_page.select("page_id", (F.col("n") + 1).alias("place"), F.coalesce("c.own", F.col("n") + F.lit(1.0)).alias("position"), "c.name", "c.url")
    return placed


def sold_values(found: DataFrame) -> DataFrame:
    """(page_id, title, price, currency, image, description): of products at the root of a page's bodies, each value of the last that has it.

    Of several offers or images the first counts; a product in a graph comes before the object around it.
    """
    v = F.col("v")
    rows = found.where("root").where(F.array_join("types", ",").rlike(SOLD))
    first = lambda path: F.coalesce(F.try_variant_get(v, f"{path}[0]", "variant"), F.try_variant_get(v, path, "variant"))
    offer, image = first("$.offers"), first("$.image")
    values = {
        "title": text_at(v, "$.name"),
        "price": F.try_variant_get(offer, "$.price", "double"),
        "currency": text_at(offer, "$.priceCurrency"),
        "image": F.coalesce(text_at(image, "$"), text_at(image, "$.url")),
        "description": F.substring(text_at(v, "$.description"), 1, DESCRIPTION),
    }
    # an object follows what its graph holds: its own number ends with what is greater than any entry's
    order = F.struct("body", F.concat("at", F.array(F.lit(2**31 - 1))))
    rows = rows.select("page_id", order.alias("order"), *(c.alias(n) for n, c in values.items()))
    return rows.groupBy("page_id").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("order"))).alias(n) for n in values))


def prefill(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, title, price, currency, image, description): what a page says of itself, by JSON-LD, else OpenGraph, else its first heading.

    pages: (page_id); a price that is no number counts as none.
    """
    ld = sold_values(walk(bodies(nodes)))
    attrs = F.col("attrs")
    meta = nodes.where("tag = 'meta'").select("page_id", "pos", F.coalesce(attrs["property"], F.lit("")).alias("property"), F.coalesce(attrs["name"], F.lit("")).alias("name"), _trimmed(attrs["content"]).alias("content"))
    # the first element of a name counts, even if it says nothing
    said = lambda test, name: F.min_by(F.struct("content"), F.when(test, F.col("pos")))["content"].alias(name)
    of = lambda p: F.col("property") == p
    og = meta.groupBy("page_id").agg(
        said(of("og:title"), "og_title"), said(of("product:price:amount"), "og_price"), said(of("product:price:currency"), "og_currency"), said(of("og:image"), "og_image"),
        F.coalesce(said(of("og:description"), "d"), said(F.col("name") == "description", "n")).alias("og_description"),
    )
    first = nodes.where("tag = 'h1'").groupBy("page_id").agg(F.min("pos").alias("pos"))
    h1 = text_content(nodes, first).select("page_id", _trimmed(F.col("content")).alias("h1"))
    rows = pages.select("page_id")
    for part in (ld, og, h1):  # pages weigh more than the tables they are made from: none is broadcast by estimate
        rows = rows.join(part.hint("merge"), "page_id", "left")
    number = F.expr("try_cast(og_price AS double)")
    return rows.select(
        "page_id", F.coalesce("title", "og_title", "h1").alias("title"), F.coalesce("price", number).alias("price"), F.coalesce("currency", "og_currency").alias("currency"),
        F.coalesce("image", "og_image").alias("image"), F.coalesce("description", "og_description").alias("description"),
    )
