"""The change queue: one merged row an index and product, released only if it wasn't marked again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.catalog import EVERYTHING, PRICE, STOCK

KEY = ["index_name", "product_id"]
COLUMNS = [*KEY, "scope_mask", "operation", "marked_at"]
SCOPES = {"PRICE": PRICE, "STOCK": STOCK, "EVERYTHING": EVERYTHING}
DRAIN_LIMIT = 1000


def has_scope(bit: int, mask: str = "scope_mask") -> Column:
    return F.col(mask).bitwiseAND(bit) != 0


def scopes(mask: str = "scope_mask") -> Column:
    """Names of the mask's scopes in the order of their bits."""
    return F.array_compact(F.array(*[F.when(has_scope(bit, mask), name) for name, bit in SCOPES.items()]))


def fold(events: DataFrame) -> DataFrame:
    """Merge marks in order of arrival (seq): scopes are united, operation and time are the last ones."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    return events.groupBy(*KEY).agg(F.bit_or("scope_mask").alias("scope_mask"), last("operation"), last("marked_at"))


def enqueue(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """The queue after further marks; what it holds already counts as earlier than any of them."""
    stored = outbox.select(*COLUMNS, F.lit(None).cast("bigint").alias("seq"))
    earlier = stored.withColumn("seq", F.lit(-(2**63)).cast("bigint"))
    return fold(earlier.unionByName(events.select(*COLUMNS, "seq")))


def pending(outbox: DataFrame, index_name: str, limit: int = DRAIN_LIMIT) -> DataFrame:
    """The rows longest marked; ties by product."""
    return outbox.where(F.col("index_name") == index_name).orderBy("marked_at", "product_id").limit(limit)


def release(outbox: DataFrame, processed: DataFrame) -> DataFrame:
    """The queue without the processed rows whose mark is still the one that was read."""
    return outbox.join(processed.select(*KEY, "marked_at"), [*KEY, "marked_at"], "left_anti").select(*COLUMNS)


def released_count(outbox: DataFrame, processed: DataFrame) -> DataFrame:
    same = outbox.join(processed.select(*KEY, "marked_at"), [*KEY, "marked_at"], "left_semi")
    return same.agg(F.count("*").alias("released"))


def depth(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("index_name").agg(F.count("*").alias("pending"))


def tombstones(stored: DataFrame, deletions: DataFrame) -> DataFrame:
    """Deleted ids (id, deleted_at) after further deletions (with seq); the latest one stays."""
    all_rows = stored.select("id", "deleted_at", F.lit(-(2**63)).cast("bigint").alias("seq")).unionByName(deletions.select("id", "deleted_at", "seq"))
    return all_rows.groupBy("id").agg(F.max_by("deleted_at", "seq").alias("deleted_at"))


def update_product(products: DataFrame, outbox: DataFrame, product_id: int | str, index_name: str, marked_at: dt.datetime, price_in_minor_units: int | None = None, stock_quantity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(products, outbox) after changing one product and marking what changed; with nothing to change, both as they were."""
    for name, value in (("price_in_minor_units", price_in_minor_units), ("stock_quantity", stock_quantity)):
        if value is not None and not 0 <= value <= 2**31 - 1:
            raise ValueError(f"{name} must lie in 0..2147483647")
    if price_in_minor_units is None and stock_quantity is None:
        return products, outbox
    this, at = F.col("id") == product_id, F.lit(marked_at).cast(products.schema["updated_at"].dataType)
    changed = {"updated_at": F.when(this, at).otherwise(F.col("updated_at"))}
    mask = 0
    for name, value, bit in (("price_in_minor_units", price_in_minor_units, PRICE), ("stock_quantity", stock_quantity, STOCK)):
        if value is not None:
            changed[name] = F.when(this, F.lit(value)).otherwise(F.col(name)).cast("int")
            mask |= bit
    mark = products.where(this).select(F.lit(index_name).alias("index_name"), F.col("id").alias("product_id"), F.lit(mask).alias("scope_mask"), F.lit("write").alias("operation"), F.date_trunc("millisecond", F.lit(marked_at)).cast(outbox.schema["marked_at"].dataType).alias("marked_at"), F.lit(0).cast("bigint").alias("seq"))
    return products.withColumns(changed), enqueue(outbox, mark)
