"""Named queries over the driver's tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import change, urls
from .functions.text import loose_number
from .functions.vectors import cosine, relevance
from .operators import compile as cf
from .operators import facets, facts, ingest, keys, ledger, products, search
from .plans.model import Filter, Key, Plan, Request, Sort
from .sources import html, portable
from .sources.items import items_of_parts, long_form
from .streaming import events as feed

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

REGISTRY = [Key("size", "number", "cm"), Key("type", "string"), Key("promo", "boolean")]
TYPES = {k.key: k.type for k in REGISTRY}
#: A query vector: alternating weights over the 64 dimensions of the test data.
VECTOR = [(-1) ** i * (1 + i % 5) / 5 for i in range(64)]

ITEMS = """items AS (SELECT p_partkey AS id, p_partkey % 5 AS collection_id, p_name AS title, CASE WHEN p_partkey % 6 <> 0 THEN p_type || ' ' || p_name END AS description,
  CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE lower(p_brand || ' ' || p_name) END AS identity, p_partkey * 7919 % 100003 AS indexed_at,
  CASE WHEN p_partkey % 13 = 0 THEN p_partkey END AS gone_at, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
  CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_type[1]) || lower(p_type[2:]) ELSE p_type END END AS type,
  CASE WHEN p_partkey % 5 <> 0 THEN p_type = 'PROMO' END AS promo FROM part)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cf.scoped(items_of_parts(spark, sf_dir))


# Search -------------------------------------------------------------------------------------------------------------------------------

PLAN = Plan((Filter("type", "in", ("PROMO", "Large")), Filter("size", "gt", 20)), Sort("price"))
_PASS = "gone_at IS NULL AND (type IS NULL OR lower(type) IN ('promo', 'large')) AND (size IS NULL OR size > 20)"
_MATCHED = "type IS NOT NULL AND size IS NOT NULL"


@query(f"WITH {ITEMS} SELECT id, title, price FROM items WHERE {_PASS} AND {_MATCHED} ORDER BY price NULLS LAST, indexed_at DESC, id LIMIT 60")
def search_page(spark, sf_dir):
    page, _, _ = search.search(items_of_parts(spark, sf_dir), Request(PLAN), REGISTRY)
    return page.select("id", "title", "price")


@query(f"WITH {ITEMS} SELECT id, title FROM items WHERE gone_at IS NULL ORDER BY indexed_at DESC, id LIMIT 60 OFFSET 30")
def search_default_order(spark, sf_dir):
    page, _, _ = search.search(items_of_parts(spark, sf_dir), Request(offset=30), REGISTRY)
    return page.select("id", "title")


@query(f"WITH {ITEMS} SELECT id, size FROM items WHERE gone_at IS NULL AND collection_id = 2 ORDER BY size DESC NULLS LAST, indexed_at DESC, id LIMIT 200")
def search_nulls_last_desc(spark, sf_dir):
    page, _, _ = search.search(items_of_parts(spark, sf_dir), Request(Plan(sort=Sort("size", "desc")), limit=200), REGISTRY, 2)
    return page.select("id", cf.typed_value("size", "number").alias("size"))


@query(f"WITH {ITEMS} SELECT count(*) FILTER ({_MATCHED}) AS total, count(*) FILTER (NOT ({_MATCHED})) AS unknown_total FROM items WHERE {_PASS}")
def search_bucket_counts(spark, sf_dir):
    return search.search(items_of_parts(spark, sf_dir), Request(PLAN), REGISTRY)[2].select("total", "unknown_total")


@query(f"WITH {ITEMS} SELECT id FROM items WHERE {_PASS} AND NOT ({_MATCHED}) ORDER BY indexed_at DESC, id LIMIT 60 OFFSET 10")
def search_unknown_page(spark, sf_dir):
    return search.search(items_of_parts(spark, sf_dir), Request(PLAN, unknown_offset=10), REGISTRY)[1].select("id")


@query(f"WITH {ITEMS} SELECT collection_id, id, row_number() OVER (PARTITION BY collection_id ORDER BY price NULLS LAST, indexed_at DESC, id) - 1 AS place FROM items WHERE {_PASS} AND {_MATCHED}")
def search_ranked(spark, sf_dir):
    rows = search.matches(_items(spark, sf_dir), PLAN, REGISTRY)
    return search.ranked(rows, PLAN, REGISTRY).select("collection_id", "id", F.col("place").cast("long").alias("place"))


@query(f"WITH {ITEMS} SELECT id, title, price, size, type, promo FROM items WHERE {_PASS} AND {_MATCHED}")
def comparison_table(spark, sf_dir):
    rows = search.matches(_items(spark, sf_dir), PLAN, REGISTRY).where("bucket = 'matched'")
    return search.comparison(rows, ["size", "type", "promo"], REGISTRY)


@query(f"WITH {ITEMS} SELECT k.key, k.covered, k.pool, k.covered < 0.8 * k.pool AS poor FROM (SELECT count(*) AS pool, count(size) AS s, count(type) AS t, count(promo) AS p FROM items WHERE gone_at IS NULL), LATERAL (SELECT * FROM (VALUES ('size', s, pool), ('type', t, pool), ('promo', p, pool)) v(key, covered, pool)) k")
def coverage(spark, sf_dir):
    return search.coverage(_items(spark, sf_dir), ["size", "type", "promo"], REGISTRY)


_FILTERS = {
    "filter_eq_string": (Filter("type", "eq", "promo"), "lower(type) = 'promo'", "type"),
    "filter_neq_number": (Filter("size", "neq", "11"), "size <> 11", "size"),
    "filter_gte_number": (Filter("price", "gte", 950), "price >= 950", "price"),
    "filter_lt_string": (Filter("type", "lt", "Medium"), "lower(type) < 'medium'", "type"),
    "filter_eq_bool": (Filter("promo", "eq", "yes"), "promo", "promo"),
    "filter_contains_literal": (Filter("title", "contains", "RED"), "contains(lower(title), 'red')", None),
    "filter_contains_number": (Filter("size", "contains", "1"), "contains(CAST(CAST(size AS BIGINT) AS VARCHAR), '1')", "size"),
    "filter_in_string": (Filter("type", "in", ["Promo", "small"]), "lower(type) IN ('promo', 'small')", "type"),
    "filter_in_number": (Filter("size", "in", [3, "7", "x"]), "size IN (3, 7)", "size"),
    "filter_exists_strict": (Filter("description", "exists"), "description <> ''", None),
    "filter_exists_unknown": (Filter("size", "exists"), "TRUE", "size"),
    "filter_strict_missing": (Filter("product", "contains", "brand#1"), "contains(lower(CASE WHEN identity = '' THEN title ELSE identity END), 'brand#1')", None),
    "filter_skip_bool_in": (Filter("promo", "in", [True]), "TRUE", None),
}


def _filter_query(f: Filter) -> Query:
    def run(spark, sf_dir):
        rows, active, _ = cf.candidates(_items(spark, sf_dir), [f], TYPES)
        return cf.bucketed(rows, active, TYPES).select("id", "bucket")

    return run


for _name, (_f, _sql, _key) in _FILTERS.items():
    _lax = f"({_key} IS NULL OR {_sql})" if _key else _sql
    _bucket = f"CASE WHEN {_key} IS NULL THEN 'unknown' ELSE 'matched' END" if _key else "'matched'"
    query(f"WITH {ITEMS} SELECT id, {_bucket} AS bucket FROM items WHERE gone_at IS NULL AND {_lax}", _name)(_filter_query(_f))


# Facets -------------------------------------------------------------------------------------------------------------------------------

FACET_FILTERS = [Filter("type", "in", ["PROMO", "Large"]), Filter("size", "gt", 20), Filter("currency", "eq", "usd")]
_FLAGS = f"""{ITEMS}, f AS (SELECT *, NOT coalesce(lower(type) IN ('promo', 'large'), FALSE) AS ft, NOT coalesce(size > 20, FALSE) AS fs, NOT coalesce(lower(currency) = 'usd', FALSE) AS fc FROM items WHERE gone_at IS NULL)"""


@query(f"""WITH {_FLAGS}, v AS (SELECT 'type' AS key, type AS value, id FROM f WHERE NOT fs AND NOT fc AND type IS NOT NULL UNION ALL SELECT 'currency', currency, id FROM f WHERE NOT ft AND NOT fs UNION ALL
  SELECT 'collection', CAST(collection_id AS VARCHAR), id FROM f WHERE NOT ft AND NOT fs AND NOT fc),
s AS (SELECT key, lower(value) AS option, value, count(*) AS n, min(id) AS seen FROM v GROUP BY ALL)
SELECT key, arg_max(value, n * 1000000000 - seen) AS value, CAST(sum(n) AS BIGINT) AS count, 0 AS more FROM s GROUP BY key, option""")
def facet_values_loo(spark, sf_dir):
    return facets.facet_values(_items(spark, sf_dir), FACET_FILTERS, REGISTRY)


@query(f"""WITH {_FLAGS}
SELECT 'price' AS key, 'range' AS kind, count(price) AS count, count(*) - count(price) AS missing, min(price) AS low, max(price) AS high FROM f WHERE NOT (ft OR fs OR fc) UNION ALL
SELECT 'size', 'range', count(size), count(*) - count(size), min(size), max(size) FROM f WHERE NOT (ft OR fc) UNION ALL
SELECT 'title', 'text', count(title), count(*) - count(title), NULL, NULL FROM f WHERE NOT (ft OR fs OR fc) UNION ALL
SELECT 'description', 'text', count(description), count(*) - count(description), NULL, NULL FROM f WHERE NOT (ft OR fs OR fc) UNION ALL
SELECT 'product', 'text', count(*), 0, NULL, NULL FROM f WHERE NOT (ft OR fs OR fc) UNION ALL
SELECT 'currency', 'values', count(currency), 0, NULL, NULL FROM f WHERE NOT (ft OR fs) UNION ALL
SELECT 'collection', 'values', count(*), 0, NULL, NULL FROM f WHERE NOT (ft OR fs OR fc) UNION ALL
SELECT 'type', 'values', count(type), count(*) - count(type), NULL, NULL FROM f WHERE NOT (fs OR fc) UNION ALL
SELECT 'promo', 'boolean', count(promo), count(*) - count(promo), NULL, NULL FROM f WHERE NOT (ft OR fs OR fc)""")
def facet_summary_loo(spark, sf_dir):
    return facets.facet_summary(_items(spark, sf_dir), FACET_FILTERS, REGISTRY).select("key", "kind", "count", "missing", "low", "high")


@query(f"WITH {_FLAGS} SELECT count(*) FILTER (promo) AS yes, count(*) FILTER (NOT promo) AS no FROM f WHERE NOT (ft OR fs OR fc)")
def facet_boolean_loo(spark, sf_dir):
    return facets.facet_summary(_items(spark, sf_dir), FACET_FILTERS, REGISTRY).where("key = 'promo'").select("yes", "no")


@query(f"WITH {ITEMS} SELECT 'price' AS key, CASE WHEN count(DISTINCT currency) FILTER (price IS NOT NULL) = 1 THEN max(currency) END AS unit FROM items WHERE gone_at IS NULL AND id % 3 = 0")
def facet_price_unit(spark, sf_dir):
    return facets.facet_summary(_items(spark, sf_dir).where("id % 3 = 0"), [], REGISTRY).where("key = 'price'").select("key", "unit")


# Meaning ------------------------------------------------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST([" + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in VECTOR) + "] AS DOUBLE[])) AS score FROM embeddings)"


def _vectors(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _semantic(spark, sf_dir, plan):
    return search.matches(_items(spark, sf_dir), plan, REGISTRY, _vectors(spark, sf_dir), VECTOR)


@query(f"WITH {_SCORED} SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 20")
def semantic_topk(spark, sf_dir):
    scored = _vectors(spark, sf_dir).select("id", cosine(F.col("vector"), VECTOR).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


_GRADE = "CASE WHEN score >= greatest(0.35, best - 0.08) THEN 'high' WHEN score >= greatest(0.25, best - 0.18) THEN 'medium' ELSE 'low' END"
_HYBRID = f"""{ITEMS}, {_SCORED}, m AS (SELECT items.*, s.score, max(s.score) OVER () AS best FROM items LEFT JOIN s USING (id) WHERE gone_at IS NULL AND lower(type) IN ('promo', 'large')), g AS (SELECT *, {_GRADE} AS relevance FROM m)"""
HYBRID = Plan((Filter("type", "in", ("PROMO", "large")),), Sort("currency"), "something meant")


@query(f"WITH {_HYBRID} SELECT id, relevance FROM g")
def semantic_relevance(spark, sf_dir):
    return _semantic(spark, sf_dir, HYBRID).where("bucket = 'matched'").select("id", "relevance")


@query(f"WITH {_HYBRID} SELECT count(*) AS total, count(*) FILTER (relevance <> 'low') AS strong_count FROM g")
def semantic_strong_count(spark, sf_dir):
    return search.totals(_semantic(spark, sf_dir, HYBRID)).select("total", "strong_count")


@query(f"WITH {_HYBRID} SELECT id FROM g ORDER BY lower(currency), coalesce(score, -1) DESC, id LIMIT 60")
def hybrid_sort_tiebreak(spark, sf_dir):
    return search.pages(_semantic(spark, sf_dir, HYBRID), Request(HYBRID), HYBRID, REGISTRY)[0].select("id")


@query(f"WITH {_SCORED}, l AS (SELECT label, id, score, max(score) OVER (PARTITION BY label) AS best FROM s JOIN embeddings ON id = vec_id) SELECT label, {_GRADE} AS relevance, count(*) AS n FROM l GROUP BY ALL")
def relevance_by_label(spark, sf_dir):
    scored = _table(spark, sf_dir, "embeddings").select("label", cosine(F.col("embedding"), VECTOR).alias("score"))
    best = F.max("score").over(Window.partitionBy("label"))
    return scored.withColumn("relevance", relevance(F.col("score"), best)).groupBy("label", "relevance").agg(F.count("*").alias("n"))


# Registry -----------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {ITEMS} SELECT * FROM (SELECT collection_id, 'size' AS key, count(size) AS count FROM items GROUP BY ALL UNION ALL SELECT collection_id, 'type', count(type) FROM items GROUP BY ALL UNION ALL SELECT collection_id, 'promo', count(promo) FROM items GROUP BY ALL) WHERE count > 0")
def registry_recount(spark, sf_dir):
    return keys.recount(items_of_parts(spark, sf_dir))


@query(f"""WITH {ITEMS}, r AS (SELECT collection_id, 'size' AS key, CASE WHEN collection_id = 3 THEN 'string' ELSE 'number' END AS type, 'cm' AS unit, count(size) AS count FROM items GROUP BY ALL
  UNION ALL SELECT collection_id, 'type', 'string', NULL, count(type) FROM items GROUP BY ALL) SELECT key, min(type) AS type, max(unit) AS unit, CAST(sum(count) AS BIGINT) AS count, min(type) <> max(type) AS conflict FROM r GROUP BY key""")
def registry_merged(spark, sf_dir):
    counted = keys.recount(items_of_parts(spark, sf_dir)).where("key <> 'promo'")
    kind = F.when((F.col("key") == "size") & (F.col("collection_id") != 3), "number").otherwise("string")
    registry = counted.select("collection_id", "key", kind.alias("type"), F.when(F.col("key") == "size", "cm").alias("unit"), F.col("key").alias("label"), F.lit(None).cast("string").alias("example"), "count", F.lit("page").alias("origin"))
    return keys.merged(registry).select("key", "type", "unit", "count", "conflict")


@query(f"WITH {ITEMS} SELECT 'type' AS key, type AS value, count(*) AS n FROM items WHERE type IS NOT NULL GROUP BY type ORDER BY n DESC, value LIMIT 12")
def registry_samples(spark, sf_dir):
    return keys.samples(items_of_parts(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT 'size' AS key, min(size) AS low, max(size) AS high FROM items")
def registry_ranges(spark, sf_dir):
    return keys.ranges(items_of_parts(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT id, round(size * 0.3937, 1) AS size_inch FROM items WHERE size IS NOT NULL")
def key_merge_factor(spark, sf_dir):
    merges = spark.createDataFrame([("size", "size_inch", 0.3937)], "from_key string, to_key string, factor double")
    moved = keys.apply_merges(items_of_parts(spark, sf_dir), merges)
    return long_form(moved).where("key = 'size_inch'").select("id", F.col("num").alias("size_inch"))


@query("SELECT event_type, CAST(avg(CAST(json_extract(props, '$.k') AS DOUBLE)) AS DOUBLE) AS mean_k, count(*) AS n FROM events GROUP BY event_type")
def bag_from_json(spark, sf_dir):
    from .sources.items import bag_from_json as parse

    rows = _table(spark, sf_dir, "events").select("event_type", parse(F.col("props"))["k"]["num"].alias("k"))
    return rows.groupBy("event_type").agg(F.avg("k").alias("mean_k"), F.count("*").alias("n"))


# Scopes -------------------------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey % 4 = 0)")
def scope_readable(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("owner_id"), (F.col("n_nationkey") % 4 == 0).alias("shared"))
    customers = _table(spark, sf_dir, "customer")
    return customers.join(cf.readable(nations, 1), F.col("c_nationkey") == F.col("id"), "left_semi").select("c_custkey", "c_name")


@query(f"""WITH {ITEMS}, a AS (SELECT *, coalesce(nullif(identity, ''), lower(title)) AS product FROM items WHERE gone_at IS NULL), p AS (SELECT * FROM a WHERE size IS NULL OR size >= 20), n AS (SELECT * FROM p WHERE NOT contains(product, 'red'))
SELECT 'total' AS part, 'matched' AS key, count(*) AS n FROM a WHERE size >= 20 UNION ALL SELECT 'total', 'unknown', count(*) FROM a WHERE size IS NULL UNION ALL SELECT 'page', 'matched', least(200, count(*)) FROM a WHERE size >= 20
UNION ALL SELECT 'facet', 'size', count(size) FROM a UNION ALL SELECT 'offer', 'size,weight', count(*) FROM n UNION ALL SELECT 'offer', 'products', count(DISTINCT product) FROM n""")
def search_response(spark, sf_dir):
    """Pages, totals, facets and the offer of one request: size is poorly covered, weight in no registry; of red things both are looked up already."""
    items = items_of_parts(spark, sf_dir)
    red = items.select(F.coalesce(F.nullif("identity", F.lit("")), F.lower("title")).alias("identity")).where("identity LIKE '%red%'").distinct()
    cache = red.select("identity", F.explode(F.array(F.lit("size"), F.lit("weight"))).alias("key"), F.lit(None).cast("struct<num:double,flag:boolean,txt:string>").alias("value"), F.lit(False).alias("found"))
    found = search.respond(items.withColumn("identity", F.coalesce(F.nullif("identity", F.lit("")), F.lower("title"))), Request(Plan((Filter("size", "gte", 20),), missing=(Key("weight", "number"),)), limit=200, facets=True, enrich=True), REGISTRY, cache, spark.createDataFrame([], "identity string, canonical string"))
    row = lambda df, part, key, n: df.select(F.lit(part).alias("part"), key.alias("key"), n.cast("long").alias("n"))
    parts = [
        row(found.totals, "total", F.lit("matched"), F.col("total")), row(found.totals, "total", F.lit("unknown"), F.col("unknown_total")), row(found.page.agg(F.count("*").alias("n")), "page", F.lit("matched"), F.col("n")),
        row(found.facets[0].where("key = 'size'"), "facet", F.col("key"), F.col("count")), row(found.offer, "offer", F.array_join("attributes", ","), F.col("listings")), row(found.offer, "offer", F.lit("products"), F.col("products")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey IN (0, 2)) AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0)")
def scope_group(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation")
    members = nations.join(_table(spark, sf_dir, "region").where("r_regionkey IN (0, 2)"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    members = members.join(nations.where("n_nationkey % 3 = 0").select("n_nationkey"), "n_nationkey", "left_anti")
    return _table(spark, sf_dir, "supplier").join(members, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query(f"""WITH {ITEMS} SELECT collection_id, count(*) AS items, count(*) FILTER (gone_at IS NULL) AS active,
  count(DISTINCT CASE WHEN gone_at IS NULL THEN coalesce(nullif(identity, ''), lower(trim(title))) END) AS products, count(price) AS priced FROM items GROUP BY collection_id""")
def collection_summary(spark, sf_dir):
    product = F.coalesce(F.nullif("identity", F.lit("")), F.lower(F.btrim("title")))
    return items_of_parts(spark, sf_dir).groupBy("collection_id").agg(
        F.count("*").alias("items"), F.count_if(F.col("gone_at").isNull()).alias("active"), F.count_distinct(F.when(F.col("gone_at").isNull(), product)).alias("products"), F.count("price").alias("priced")
    )


# Ledger -------------------------------------------------------------------------------------------------------------------------------


def _usage(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("ts", "user_id", F.col("event_type").alias("purpose"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("cost"))


@query("SELECT event_type AS purpose, count(*) AS calls, round(sum(CASE WHEN event_id % 10 <> 0 THEN value END), 4) AS cost, count(*) FILTER (event_id % 10 = 0) AS unpriced FROM events GROUP BY event_type")
def usage_by_purpose(spark, sf_dir):
    return ledger.usage_by(_usage(spark, sf_dir), "purpose").withColumn("cost", F.round("cost", 4))


@query("""SELECT round(sum(c) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00'), 4) AS today, round(sum(c) FILTER (ts >= TIMESTAMP '2024-01-13 12:00:00'), 4) AS recent, round(sum(c), 4) AS all_time,
  count(*) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00') AS calls_today, count(*) AS calls, count(*) FILTER (c IS NULL) AS unpriced FROM (SELECT ts, CASE WHEN event_id % 10 <> 0 THEN value END AS c FROM events)""")
def usage_windows(spark, sf_dir):
    rows = ledger.usage_windows(_usage(spark, sf_dir), F.lit("2024-01-20 12:00:00").cast("timestamp"), 7)
    return rows.select(*(F.round(c, 4).alias(c) for c in ("today", "recent", "all_time")), "calls_today", "calls", "unpriced")


@query("""WITH u AS (SELECT ts, event_type AS purpose, CASE WHEN event_id % 5 > 0 THEN 'p' || event_id % 3 ELSE 'openrouter' END AS provider, 'm' || user_id % 4 AS model, CASE event_id % 4 WHEN 0 THEN 'own' WHEN 1 THEN NULL ELSE 'platform' END AS funding, CASE WHEN event_id % 10 <> 0 THEN value END AS cost,
  event_id % 2 = 0 AS cost_estimated, event_id % 100 AS pt, event_id % 7 AS ct FROM events)
SELECT CASE GROUPING(purpose, provider, model, funding) WHEN 15 THEN 'all' WHEN 7 THEN 'purpose' WHEN 9 THEN 'model' ELSE 'funding' END AS part, purpose, provider, model, funding, count(*) AS calls, count(*) FILTER (cost IS NULL) AS unpriced, round(coalesce(sum(cost), 0), 4) AS cost,
  round(coalesce(sum(cost) FILTER (cost_estimated), 0), 4) AS estimated, round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-20 00:00:00'), 0), 4) AS today, round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-13 12:00:00'), 0), 4) AS recent, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens
FROM u GROUP BY GROUPING SETS ((), (purpose), (provider, model), (funding))""")
def usage_summary(spark, sf_dir):
    """All figures of a usage page from one pass over the calls."""
    k = F.col("event_id")
    usage = _table(spark, sf_dir, "events").select(
        "ts", F.col("event_type").alias("purpose"), F.when(k % 5 > 0, F.concat(F.lit("p"), k % 3)).alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 4).alias("model"), F.when(k % 4 == 0, "own").when(k % 4 > 1, "platform").alias("funding"),
        F.when(k % 10 != 0, F.col("value")).alias("cost"), (k % 2 == 0).alias("cost_estimated"), (k % 100).alias("prompt_tokens"), (k % 7).alias("completion_tokens"),
    )
    rows = ledger.usage_summary(usage, F.lit("2024-01-20 12:00:00").cast("timestamp"), 7)
    return rows.select(*(F.round(c, 4).alias(c) if c in ("cost", "estimated", "today", "recent") else F.col(c) for c in rows.columns))


@query("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY ALL")
def usage_by_user_day(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.col("value").alias("cost"))
    return ledger.usage_by(rows, "user_id", "day").select("user_id", "day", "calls", F.round("cost", 4).alias("cost"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(ledger.nearest_rank("value", 0.5).alias("p50"), ledger.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT event_type, v[least(len(v) - 1, CAST(floor(0.95 * len(v)) AS BIGINT)) + 1] AS value FROM (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)")
def percentile_floor_index(spark, sf_dir):
    return ledger.floor_index(_table(spark, sf_dir, "events"), "value", 0.95, "event_type")


@query("""SELECT l_shipmode, n, round(share, 2) AS share FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, sum(l_extendedprice * s / w) AS share FROM (
  SELECT l_returnflag, l_extendedprice, date_diff('second', greatest(o_orderdate, TIMESTAMP '1997-01-01'), least(l_shipdate, TIMESTAMP '1998-01-01')) AS s, date_diff('second', o_orderdate, l_shipdate) AS w
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE s > 0 GROUP BY l_returnflag)""")
def prorated_usage(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda d: F.lit(d).cast("timestamp")
    shared = ledger.prorated(rows, "o_orderdate", "l_shipdate", "l_extendedprice", day("1997-01-01"), day("1998-01-01"))
    return shared.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"), F.round(F.sum("share"), 2).alias("share"))


@query("""WITH s AS (SELECT l_linenumber AS run_id, CAST(l_quantity AS BIGINT) AS tabs, avg(l_extendedprice) AS r, count(*) FILTER (l_discount > 0.099 AND l_orderkey % 50 = 0) AS errors FROM lineitem GROUP BY ALL)
SELECT run_id, min(tabs) FILTER (errors = 0 AND r >= 0.95 * best) AS knee FROM (SELECT *, max(r) FILTER (errors = 0) OVER (PARTITION BY run_id) AS best FROM s) GROUP BY run_id""")
def capacity_knee(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("run_id"), F.col("l_quantity").cast("long").alias("tabs")).agg(
        F.avg("l_extendedprice").alias("pages_per_min"), F.count_if((F.col("l_discount") > 0.099) & (F.col("l_orderkey") % 50 == 0)).alias("errors")
    )
    return ledger.knee(rows)


@query("SELECT o_orderstatus AS bucket, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def timing_rollup(spark, sf_dir):
    rows = ledger.timings(_table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("bucket"), F.col("o_totalprice").alias("ms")))
    return rows.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query("""SELECT event_type, CASE WHEN event_type <> 'error' THEN round(sum((300 * a + 100 * b + 7 * c) / 1e6), 6) END AS cost FROM (SELECT event_type, event_id % 900 AS n, CASE event_type WHEN 'view' THEN 1.0 ELSE 2.0 END AS a, 0.5 AS b, n * 4.0 AS c FROM events) GROUP BY event_type""")
def estimated_cost(spark, sf_dir):
    used = _table(spark, sf_dir, "events").select("event_type", F.lit("p").alias("provider"), F.concat(F.when(F.col("event_id") % 2 == 0, "models/").otherwise(""), "event_type", F.when(F.col("event_id") % 3 == 0, ":free").otherwise("")).alias("model"), F.lit(400).alias("prompt_tokens"), F.lit(100).alias("cached_tokens"), (F.col("event_id") % 900 * 7).alias("completion_tokens"))
    prices = spark.createDataFrame([("p", m, 1.0 if m == "view" else 2.0, 4.0, 0.5, None) for m in ("view", "signup", "click", "purchase")], "provider string, model string, input double, output double, cache_read double, cache_write double")
    return ledger.with_cost(used, prices).groupBy("event_type").agg(F.round(F.sum("estimate"), 6).alias("cost"))


# Change detection and ingest ----------------------------------------------------------------------------------------------------------

_TOKENS = r"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[^\p{L}\p{N}.,]+'), lambda w: trim(w, '.,')), lambda w: w <> '')))"


_SQL_VOLATILE = " OR ".join("regexp_matches(x, '{}', 'i')".format(p.replace("(?:", "(").replace("'", "''")) for p in change.VOLATILE)
_SQL_STABLE = f"""list_filter(list_transform(range(1, len(l) + 1), lambda i: struct_pack(x := l[i], above := CASE WHEN i > 1 THEN l[i - 1] ELSE '' END)), lambda p: NOT regexp_matches(p.x, '{change.VOLATILE_LABEL}', 'i')
  AND NOT (regexp_matches(p.above, '{change.VOLATILE_LABEL}', 'i') AND length(p.x) <= 40 AND regexp_matches(p.x, '{change.VALUE}', 'i')) AND NOT (length(p.x) <= 120 AND ({_SQL_VOLATILE.replace("(x, ", "(p.x, ")})))"""


@query(rf"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, array_to_string(list_transform({_SQL_STABLE}, lambda p: p.x), chr(10)) AS text FROM d) SELECT doc_id, sha256(array_to_string({_TOKENS}, ' ')) AS fingerprint FROM s UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""")
def fingerprint_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", change.fingerprint(F.col("text")).alias("fingerprint"))


@query("WITH r AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, max(other) AS reused FROM (SELECT a.doc_id, b.doc_id AS other FROM r a JOIN r b ON a.h = b.h AND b.doc_id % 2 = 1 WHERE a.doc_id % 2 = 0) GROUP BY doc_id")
def reuse_by_hash(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("u").alias("url"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("indexed_at"), F.lit(None).cast("map<string,string>").alias("specs"))
    wanted = docs.where("id % 2 = 0")
    found = ingest.reusable(wanted, docs.where("id % 2 = 1")).select("content_hash", F.col("id").alias("reused"))
    return wanted.select(F.col("id").alias("doc_id"), "content_hash").join(found, "content_hash").select("doc_id", "reused")


_PAIRS = r"p AS (SELECT a.doc_id, a.t AS old, b.t AS new FROM (SELECT doc_id, list_distinct(regexp_split_to_array(lower(trim(text)), '\s+')) AS t FROM documents) a JOIN (SELECT doc_id, list_distinct(regexp_split_to_array(lower(trim(text)), '\s+')) AS t FROM documents) b ON b.doc_id = a.doc_id + 1)"


@query(f"WITH {_PAIRS} SELECT doc_id, round(CAST(len(list_filter(old, lambda x: NOT list_contains(new, x))) AS DOUBLE) / len(old), 6) AS share FROM p")
def removed_share(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower(F.btrim("text")), r"\s+")).alias("t"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("new"))
    return docs.join(after, "doc_id").select("doc_id", F.round(change.removed_share(F.col("t"), F.col("new")), 6).alias("share"))


@query(f"WITH {ITEMS} SELECT id, CASE WHEN gone_at IS NOT NULL THEN gone_at WHEN id % 8 = 5 THEN 777 END AS gone_at FROM items")
def mark_gone(spark, sf_dir):
    items = items_of_parts(spark, sf_dir)
    return ingest.mark_gone(items, items.where("id % 8 <> 5"), 777).select("id", F.col("gone_at").cast("long").alias("gone_at"))


@query(f"""WITH {ITEMS}, n AS (SELECT id, size + 1 AS size FROM items WHERE id % 3 = 0)
SELECT i.id, CASE WHEN i.id % 3 = 0 THEN n.size ELSE i.size END AS size, CASE WHEN i.id % 3 = 0 AND i.id % 2 = 1 THEN NULL ELSE i.type END AS type, CASE WHEN i.id % 3 <> 0 THEN i.gone_at END AS gone_at FROM items i LEFT JOIN n USING (id)""")
def upsert_merge(spark, sf_dir):
    old = items_of_parts(spark, sf_dir)
    bag = F.map_filter("specs", lambda k, _: k == "size")
    new = old.where("id % 3 = 0").withColumn("specs", F.transform_values(bag, lambda _, v: v.withField("num", v["num"] + 1)))
    web = old.where("id % 2 = 0").select("collection_id", "url", F.lit("type").alias("key"))
    merged = ingest.upsert(old, new, web)
    return merged.select("id", cf.typed_value("size", "number").alias("size"), cf.typed_value("type", "string").alias("type"), "gone_at")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'returned' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS kind FROM documents""")
def crawl_classify(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.sha2("text", 256).alias("card_hash"))
    known = docs.where("doc_id % 3 <> 0").select("url", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("card_hash")).alias("card_hash"), F.when(F.col("doc_id") % 7 == 0, 1).alias("gone_at"))
    return ingest.classify(docs, known).select("doc_id", "kind")


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_[^=&]*|ref)=[^&]*', '\1', 'g'), '[?&]+$', '') AS item_url FROM pages")
def url_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", urls.item_url(F.col("url")).alias("item_url"))


@query(r"""WITH u AS (SELECT DISTINCT url, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-zA-Z][^:]*://([^?#]*)', 1) AS path FROM pages),
p AS (SELECT host, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM u),
s AS (SELECT host, array_to_string(list_transform(s, lambda x, i: CASE WHEN i > 1 AND (i = len(s) OR regexp_matches(x, '\d{3,}')) THEN '*' ELSE x END), '/') AS shape, count(*) AS links FROM p GROUP BY ALL HAVING count(*) >= 5)
SELECT host, arg_max(shape, (links, shape)) AS shape, max(links) AS links FROM s GROUP BY host""")
def link_shape(spark, sf_dir):
    return urls.common_shape(_table(spark, sf_dir, "pages"))


@query("""WITH c AS (SELECT unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages), n AS (SELECT unnest(regexp_split_to_array(c, '\\s+')) AS name FROM c) SELECT name, count(*) AS n FROM n WHERE name <> '' GROUP BY name HAVING count(*) >= 3 ORDER BY n DESC, name LIMIT 40""")
def class_frequency(spark, sf_dir):
    return html.class_names(_table(spark, sf_dir, "pages"))


@query("SELECT page_id, true AS parsed, CASE WHEN len(regexp_extract_all(html, '<p>')) >= 10 THEN 'listing' END AS kind FROM pages")
def page_kind(spark, sf_dir):
    """The given pages say nothing of themselves; here each paragraph counts as a card."""
    pages = _table(spark, sf_dir, "pages")
    seen = html.snapshots(pages).join(pages.select("page_id", F.regexp_count("html", F.lit("<p>")).alias("cards")), "page_id")
    return seen.select("page_id", F.col("text").isNotNull().alias("parsed"), html.page_kind(F.col("cards"), F.col("ld_types"), F.col("og")["type"]).alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n % 2 = 0 THEN n / 100.0 ELSE CAST(n AS DOUBLE) END AS number FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS BIGINT) AS n FROM lineitem)")
def loose_numbers(spark, sf_dir):
    n = F.col("l_partkey")
    text = F.when(n % 2 == 0, F.concat(F.lit("ca. "), F.floor(n / 100), F.lit(","), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(" kg"))).otherwise(F.concat(F.format_number(n, 0), F.lit(" pcs")))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", loose_number(text).alias("number"))


# Products and facts -------------------------------------------------------------------------------------------------------------------

_NAME = "lower('b' || p_partkey % 7 || ' ' || split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 3 = 0 THEN ' ' || split_part(p_name, ' ', 2) ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN ' ' || (70 + p_size) || ' kw' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' 2024' ELSE '' END)"
_WORDS = "list_sort(list_filter(list_distinct([split_part(p_name, ' ', 1)] || CASE WHEN p_partkey % 3 = 0 THEN [split_part(p_name, ' ', 2)] ELSE [] END), lambda x: x <> 'new'))"
_FEATURES = f"""f AS (SELECT DISTINCT {_NAME} AS identity, 'b' || p_partkey % 7 AS brand, {_WORDS} AS words, CASE WHEN p_partkey % 4 = 0 THEN 70.0 + p_size END AS power, p_partkey % 5 = 0 AS y FROM part)"""


def _names(spark, sf_dir):
    part = F.split("p_name", " ")
    k = F.col("p_partkey")
    name = F.concat_ws(" ", F.concat(F.lit("b"), k % 7), F.get(part, F.lit(0)), F.when(k % 3 == 0, F.get(part, F.lit(1))), F.when(k % 4 == 0, F.concat(70 + F.col("p_size"), F.lit(" kw"))), F.when(k % 5 == 0, "2024"))
    return _table(spark, sf_dir, "part").select(F.lower(name).alias("identity")).distinct()


@query(f"WITH {_FEATURES} SELECT identity, brand, array_to_string(words, ' ') AS words, coalesce(power, 0) AS power, 1 - 1 + CAST(len(words) + (power IS NOT NULL)::INT + y::INT AS INT) AS detail FROM f")
def identity_features(spark, sf_dir):
    rows = products.with_features(_names(spark, sf_dir))
    return rows.select("identity", "brand", F.array_join("words", " ").alias("words"), F.coalesce(F.get("power", F.lit(0)), F.lit(0.0)).alias("power"), "detail")


_NEAR = "(a.power IS NULL OR b.power IS NULL OR abs(a.power - b.power) <= 0.04 * greatest(a.power, b.power))"


@query(f"WITH {_FEATURES} SELECT a.identity AS a, b.identity AS b FROM f a JOIN f b ON a.brand = b.brand AND a.words = b.words AND a.identity < b.identity AND {_NEAR}")
def same_product_pairs(spark, sf_dir):
    return products.same_pairs(products.with_features(_names(spark, sf_dir)))


@query(f"WITH {_FEATURES} SELECT a.identity AS general, b.identity AS specific FROM f a JOIN f b ON a.brand = b.brand AND len(a.words) BETWEEN 1 AND len(b.words) - 1 AND list_has_all(b.words, a.words) AND {_NEAR}")
def maybe_same_pairs(spark, sf_dir):
    return products.maybe_pairs(products.with_features(_names(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_FEATURES}, o AS (SELECT *, row_number() OVER (PARTITION BY brand, words ORDER BY len(words) + (power IS NOT NULL)::INT + y::INT DESC, length(identity) DESC, identity) AS r FROM f),
g AS (SELECT brand, words, 0 AS r, CAST([] AS INT[]) AS c, CAST([] AS DOUBLE[]) AS p, CAST([] AS VARCHAR[]) AS n FROM (SELECT DISTINCT brand, words FROM o)
  UNION ALL SELECT o.brand, o.words, o.r, list_append(g.c, list_min(list_filter(range(0, len(g.c) + 1), lambda k: NOT list_contains(list_transform(list_filter(list_zip(g.c, g.p), lambda z: z[2] IS NOT NULL AND o.power IS NOT NULL AND abs(z[2] - o.power) > 0.04 * greatest(z[2], o.power)), lambda z: z[1]), k)))::INT),
    list_append(g.p, o.power), list_append(g.n, o.identity) FROM g JOIN o ON o.brand = g.brand AND o.words = g.words AND o.r = g.r + 1),
l AS (SELECT arg_max(c, r) AS c, arg_max(n, r) AS n FROM g GROUP BY brand, words), u AS (SELECT unnest(n) AS identity, unnest(c) AS k, c, n FROM l)
SELECT identity, n[list_position(c, k)] AS canonical FROM u""")
def product_clusters(spark, sf_dir):
    return products.regroup(_names(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT coalesce(nullif(identity, ''), lower(trim(title))) AS canonical, count(*) AS listings FROM items GROUP BY 1")
def product_groups(spark, sf_dir):
    aliases = spark.createDataFrame([], "identity string, canonical string")
    return products.product_groups(items_of_parts(spark, sf_dir), aliases).select("canonical", "listings")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 1 THEN 'own' WHEN s_suppkey % 4 = 2 THEN 'synonym' WHEN s_suppkey % 4 = 3 THEN 'canonical' END AS value FROM supplier WHERE s_suppkey % 4 > 0""")
def cached_fact_priority(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), "s_suppkey").alias("identity"))
    root = F.concat(F.lit("root "), "identity")
    fact = lambda where, name, key, value, found=True: s.where(where).select(name.alias("identity"), F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(found).alias("found"))
    own = F.col("identity")
    cache = fact("id % 4 = 1", own, "power", "own").union(fact("id % 4 = 1", root, "power", "late")).union(fact("id % 4 = 2", own, "power", None, False)).union(fact("id % 4 = 2", own, "kw", "synonym")).union(fact("id % 4 = 3", root, "power", "canonical"))
    found = facts.cached(s.select("identity", F.lit("power").alias("key")), cache, s.select("identity", root.alias("canonical")), spark.createDataFrame([("power", "kw")], "key string, synonym string"))
    return found.join(s, "identity").select("id", "value")


@query(f"WITH {ITEMS} SELECT identity AS canonical, arg_min(size, id) AS size FROM items WHERE identity <> '' AND size <> 0 GROUP BY identity")
def sibling_value(spark, sf_dir):
    aliases = spark.createDataFrame([], "identity string, canonical string")
    return facts.sibling_values(items_of_parts(spark, sf_dir), aliases).where("key = 'size'").select("canonical", F.col("value.num").alias("size"))


@query(f"WITH {ITEMS} SELECT coalesce(nullif(identity, ''), lower(title)) AS canonical, count(*) AS listings FROM items GROUP BY 1 ORDER BY listings DESC, canonical LIMIT 15")
def lookup_cap(spark, sf_dir):
    return facts.lookup_order(items_of_parts(spark, sf_dir), spark.createDataFrame([], "identity string, canonical string"))


# Events -------------------------------------------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("channel"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.col("text").alias("message"))


@query("SELECT conv_id AS channel, turn AS seq FROM conversations a WHERE turn > 2 OR (SELECT max(turn) FROM conversations b WHERE b.conv_id = a.conv_id) < 2")
def replay_after(spark, sf_dir):
    return feed.replay_after(_events(spark, sf_dir), "boot1", F.lit("boot1-2")).select("channel", "seq")


@query("SELECT conv_id AS channel, max(turn) AS seq, arg_max(role, turn) AS type FROM conversations GROUP BY conv_id")
def latest_snapshot(spark, sf_dir):
    return feed.latest(_events(spark, sf_dir), "channel").select("channel", "seq", "type")


@query("SELECT channel, seq FROM (SELECT conv_id AS channel, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def ring_buffer_tail(spark, sf_dir):
    return feed.tail(_events(spark, sf_dir), 3).select("channel", "seq")


@query("SELECT date_trunc('minute', ts) AS start, user_id, count(*) AS n FROM events GROUP BY ALL")
def rate_per_minute(spark, sf_dir):
    return feed.rates(_table(spark, sf_dir, "events"))


@query(f"WITH {ITEMS} SELECT collection_id, count(*) AS items, count(DISTINCT nullif(identity, '')) AS facts FROM items GROUP BY collection_id")
def export_documents(spark, sf_dir):
    items = items_of_parts(spark, sf_dir)
    collections = items.select("collection_id", F.concat(F.lit("c"), "collection_id").alias("name")).distinct()
    registry = keys.recount(items).select("collection_id", "key", F.lit("string").alias("type"), F.lit(None).cast("string").alias("unit"), F.col("key").alias("label"), F.lit(None).cast("string").alias("example"), F.lit("page").alias("origin"))
    cache = items.where("identity <> ''").select("identity").distinct().select("identity", F.lit("k").alias("key"), F.lit(None).cast("struct<num:double,flag:boolean,txt:string>").alias("value"), F.lit(0.9).alias("confidence"), F.lit(True).alias("found"))
    docs = portable.documents(collections, items, registry, spark.createDataFrame([], "identity string, canonical string"), cache)
    return docs.select("collection_id", F.size("items").cast("long").alias("items"), F.size("facts").cast("long").alias("facts"))
