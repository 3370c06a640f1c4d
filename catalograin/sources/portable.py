"""Portable documents: collections with their items, keys and facts as nested JSON, written and read again."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import safe_link
from .items import VALUE

FORMAT_VERSION = 1
MAX_SPECS = 500
MAX_VALUE = 5000
_ITEM = f"struct<url:string,title:string,description:string,price:double,currency:string,identity:string,indexed_at:long,gone_at:long,specs:map<string,{VALUE}>>"
SCHEMA = f"version int, name string, items array<{_ITEM}>, keys array<struct<key:string,type:string,unit:string,label:string,example:string,origin:string>>, aliases array<struct<identity:string,canonical:string>>, facts array<struct<identity:string,key:string,value:{VALUE},confidence:double,found:boolean>>"


def documents(collections: DataFrame, items: DataFrame, keys: DataFrame, aliases: DataFrame, facts: DataFrame) -> DataFrame:
    """One nested row for each collection (collection_id, name), with only the aliases and facts that its products touch, over two hops."""
    names = items.where("identity <> ''").select("collection_id", "identity").distinct()
    mine = names.join(aliases, "identity").select("collection_id", "canonical").distinct()
    around = mine.join(aliases, "canonical").select("collection_id", "identity", "canonical").distinct()
    touched = names.union(mine.select("collection_id", "canonical")).union(around.select("collection_id", "identity")).distinct()
    nested = lambda df, name, *fields: df.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*fields)))).alias(name))
    parts = [
        items.groupBy("collection_id").agg(F.collect_list(F.struct("url", "title", "description", "price", "currency", "identity", "indexed_at", "gone_at", "specs")).alias("items")),
        keys.groupBy("collection_id").agg(F.collect_list(F.struct("key", "type", "unit", "label", "example", "origin")).alias("keys")),
        around.groupBy("collection_id").agg(F.collect_list(F.struct("identity", "canonical")).alias("aliases")),
        touched.join(facts, "identity").groupBy("collection_id").agg(F.collect_list(F.struct("identity", "key", "value", "confidence", "found")).alias("facts")),
    ]
    out = collections.select("collection_id", F.lit(FORMAT_VERSION).alias("version"), "name")
    for part in parts:
        out = out.join(part, "collection_id", "left")
    return out


def lines(collections: DataFrame, items: DataFrame, keys: DataFrame, aliases: DataFrame, facts: DataFrame) -> DataFrame:
    """(collection_id, kind, body): the same content as `documents`, one JSON text for each collection, item, key, alias and fact.

    For collections of any size: no row holds more than one of these, and no task a whole collection.
    """
    names = items.where("identity <> ''").select("collection_id", "identity").distinct()
    mine = names.join(aliases, "identity").select("collection_id", "canonical").distinct()
    around = mine.join(aliases, "canonical").select("collection_id", "identity", "canonical").distinct()
    touched = names.union(mine.select("collection_id", "canonical")).union(around.select("collection_id", "identity")).distinct()
    line = lambda df, kind, *fields: df.select("collection_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*fields)).alias("body"))
    parts = [
        line(collections, "collection", F.lit(FORMAT_VERSION).alias("version"), "name"), line(items, "item", "url", "title", "description", "price", "currency", "identity", "indexed_at", "gone_at", "specs"),
        line(keys, "key", "key", "type", "unit", "label", "example", "origin"), line(around, "alias", "identity", "canonical"), line(touched.join(facts, "identity"), "fact", "identity", "key", "value", "confidence", "found"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("collection_id", "kind").text(path)


def read_items(spark: SparkSession, path: str, collection_id: int) -> DataFrame:
    """The items of one exported collection, by the fixed schema."""
    rows = spark.read.text(f"{path}/collection_id={collection_id}/kind=item")
    return rows.select(F.from_json("value", _ITEM).alias("i")).select("i.*")


def write(docs: DataFrame, path: str) -> None:
    docs.drop("collection_id").write.mode("overwrite").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a path, by the fixed schema; unknown fields are ignored, fields of old files default to null."""
    return spark.read.schema(SCHEMA).json(path)


def import_names(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """`docs` with ` (imported)` after names that exist already."""
    taken = existing.select(F.col("name").alias("taken")).distinct()
    return docs.join(taken, F.col("name") == F.col("taken"), "left").withColumn("name", F.when(F.col("taken").isNotNull(), F.concat("name", F.lit(" (imported)"))).otherwise(F.col("name"))).drop("taken")


def imported_items(docs: DataFrame, now: Column) -> DataFrame:
    """Items of documents: the first of each url in a document, links made safe, times of the future set to now, oversized bags cut off at the import limit."""
    rows = docs.select("name", F.posexplode("items").alias("pos", "i")).select("name", "pos", "i.*")
    rows = rows.withColumn("url", safe_link(F.col("url"))).where("url IS NOT NULL")
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("name", "url").orderBy("pos"))).where("r = 1").drop("r")
    fits = F.map_filter("specs", lambda _, v: F.coalesce(F.length(v["txt"]) <= MAX_VALUE, F.lit(True)))
    return first.withColumn("indexed_at", F.least("indexed_at", now)).withColumn("gone_at", F.when(F.col("gone_at").isNotNull(), F.least("gone_at", now))).withColumn("specs", F.when(F.size("specs") <= MAX_SPECS, fits))


def insert_new(existing: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """`existing` and those of `more` whose keys it doesn't have."""
    return existing.unionByName(more.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))
