"""Items: listings with fixed columns and a bag of typed attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value of the bag: exactly one of the three is set.
VALUE = "struct<num:double,flag:boolean,txt:string>"
ITEM = (
    "id long, collection_id long, url string, title string, description string, price double, currency string, identity string, "
    f"indexed_at long, gone_at long, specs map<string,{VALUE}>"
)


def number(value: Column) -> Column:
    return F.struct(value.cast("double").alias("num"), F.lit(None).cast("boolean").alias("flag"), F.lit(None).cast("string").alias("txt"))


def flag(value: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("num"), value.cast("boolean").alias("flag"), F.lit(None).cast("string").alias("txt"))


def text(value: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("boolean").alias("flag"), value.cast("string").alias("txt"))


def bag(**values: Column) -> Column:
    """A bag of typed values (from `number`, `flag`, `text`), without those that are null."""
    whole = F.create_map(*(part for key, value in values.items() for part in (F.lit(key), value)))
    return F.map_filter(whole, lambda _, v: v["num"].isNotNull() | v["flag"].isNotNull() | v["txt"].isNotNull())


def bag_from_json(json: Column) -> Column:
    """A JSON object as a bag: numbers, booleans and strings; other values and nulls are left out."""
    raw = F.from_json(json, "map<string,variant>")
    typed = F.transform_values(
        raw,
        lambda _, v: F.struct(
            F.when(F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double")).alias("num"),
            F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).alias("flag"),
            F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("txt"),
        ),
    )
    return F.map_filter(typed, lambda _, v: v["num"].isNotNull() | v["flag"].isNotNull() | v["txt"].isNotNull())


def items_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `part` table as items: attributes `size` (number), `type` (string) and `promo` (boolean), some missing."""
    k = F.col("p_partkey")
    size = F.when(k % 4 != 0, F.col("p_size"))
    kind = F.when(k % 9 != 0, F.when(k % 2 == 0, F.initcap("p_type")).otherwise(F.col("p_type")))
    promo = F.when(k % 5 != 0, F.col("p_type") == "PROMO")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"),
        (k % 5).alias("collection_id"),
        F.concat(F.lit("https://shop.example/"), k).alias("url"),
        F.col("p_name").alias("title"),
        F.when(k % 6 != 0, F.concat_ws(" ", "p_type", "p_name")).alias("description"),
        F.when(k % 7 != 0, F.col("p_retailprice")).alias("price"),
        F.when(k % 3 == 0, "EUR").otherwise("USD").alias("currency"),
        F.when(k % 11 == 0, "").otherwise(F.lower(F.concat_ws(" ", "p_brand", "p_name"))).alias("identity"),
        (k * 7919 % 100003).alias("indexed_at"),
        F.when(k % 13 == 0, k).alias("gone_at"),
        bag(size=number(size), type=text(kind), promo=flag(promo)).alias("specs"),
    )


def long_form(items: DataFrame, *keep: str) -> DataFrame:
    """One row for each item and attribute: (id, collection_id, kept columns, key, num, flag, txt)."""
    return items.select("id", "collection_id", *keep, F.explode("specs").alias("key", "value")).select("id", "collection_id", *keep, "key", "value.num", "value.flag", "value.txt")
