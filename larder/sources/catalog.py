"""The domain tables over the retail test tables, and scans of them.

Joins carry no broadcast hints: the optimizer broadcasts a side by its size, at run time too.

The catalogue has no tables of its own there, so products, stock and change events are derived from
part, lineitem and events with integer arithmetic, which any engine can repeat.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.codes import ean13

INDEX = "products"
EPOCH = dt.date(2001, 11, 4)
PRICE, STOCK, EVERYTHING = 1, 2, 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days_before(days: Column) -> Column:
    return F.date_sub(F.lit(EPOCH), days).cast("timestamp_ntz")


def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring_index("p_brand", "#", -1).cast("int")
    names = read(spark, sf_dir, "part").select("p_brand", number.alias("n")).distinct()
    return names.select(F.col("p_brand").alias("brand_name"), _days_before(F.col("n") * 7 % 90).alias("brand_updated_at"))


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = product(spark, sf_dir).select("slug_path").distinct()
    return paths.select("slug_path", _days_before(F.length("slug_path") * 11 % 120).alias("category_updated_at"))


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, words = F.col("p_partkey"), F.split("p_name", " ")
    return read(spark, sf_dir, "part").select(
        key.alias("id"),
        F.concat(F.lit("PRT-"), F.lpad(key.cast("string"), 7, "0")).alias("sku"),
        F.col("p_name").alias("name"),
        F.concat(F.col("p_name"), F.lit(" by "), F.col("p_brand")).alias("description"),
        F.col("p_brand").alias("brand"),
        F.concat_ws("/", F.lower("p_type"), words[1], words[0]).alias("slug_path"),
        F.round(F.col("p_retailprice") * 100).cast("int").alias("price_in_minor_units"),
        F.when(key % 8 == 0, 0).otherwise(1 + key * 37 % 400).cast("int").alias("stock_quantity"),
        (key % 50 != 0).alias("visible"),
        ean13(key).alias("ean"),
        _days_before((key % 400).cast("int")).alias("updated_at"),
    )


def daily_store_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily sales; the triple repeats in the source, so quantities add up."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity")
    stores = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("store_number"))
    sold = lines.join(stores, "l_suppkey")
    return sold.groupBy("store_number", F.col("l_partkey").alias("product_id"), F.col("l_shipdate").cast("date").alias("sales_date")).agg(F.sum("l_quantity").cast("bigint").alias("quantity"))


def store_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock of the pairs that ever sold, a fifth of them left out."""
    store, item = F.col("store_number"), F.col("product_id")
    pairs = daily_store_sales(spark, sf_dir).select("store_number", "product_id").distinct().where((store + item) % 5 != 0)
    return pairs.select("store_number", "product_id", (1 + (store * 31 + item * 17) % 40).cast("bigint").alias("quantity_on_hand"), F.when((store * 7 + item) % 4 == 0, 10).otherwise(0).cast("bigint").alias("quantity_on_order"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox marks from the events: what each event type touches, in order of event_id."""
    kind = F.col("event_type")
    scope = F.when(kind == "click", PRICE).when(kind == "view", STOCK).when(kind == "purchase", PRICE | STOCK).otherwise(EVERYTHING)
    return read(spark, sf_dir, "events").select(
        F.lit(INDEX).alias("index_name"),
        F.col("user_id").alias("product_id"),
        scope.alias("scope_mask"),
        F.when(kind == "error", "delete").otherwise("write").alias("operation"),
        F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("marked_at"),
        F.col("event_id").alias("seq"),
    )


def changed_since(products: DataFrame, brands: DataFrame, categories: DataFrame, since: dt.datetime) -> DataFrame:
    """Ids of products of which the row, the brand or the category changed at or after since."""
    joined = products.join(brands, products["brand"] == brands["brand_name"]).join(categories, "slug_path")
    at = F.lit(since).cast("timestamp_ntz")
    return joined.where((F.col("updated_at") >= at) | (F.col("brand_updated_at") >= at) | (F.col("category_updated_at") >= at)).select("id")


def recently_changed(products: DataFrame, limit: int) -> DataFrame:
    return products.orderBy(F.desc("updated_at"), "id").limit(limit).select("id", "updated_at")


def deleted_since(tombstones: DataFrame, since: dt.datetime) -> DataFrame:
    return tombstones.where(F.col("deleted_at") >= F.lit(since).cast("timestamp_ntz")).select("id")


class NotFound(LookupError):
    """No row of that key."""


def by_id(products: DataFrame, key: int | str) -> DataFrame:
    found = products.where(F.col("id") == key)
    if found.isEmpty():
        raise NotFound(f"no product {key}")
    return found
