"""Self-excluding facet counts in one scan: each dimension under the other dimensions' selections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 20


def availability(value: str) -> Column:
    """In stock above zero, out of stock at zero; a negative quantity is neither."""
    return F.col("stock_quantity") > 0 if value == "in_stock" else F.col("stock_quantity") == 0


def selections(brands: tuple[str, ...] = (), category: str | None = None, available: str | None = None) -> dict[str, Column]:
    """Each dimension's condition; true without a selection."""
    return {
        "brand": F.col("brand").isin(*brands) if brands else F.lit(True),
        "category": F.array_contains("category.path", category) if category else F.lit(True),
        "availability": availability(available) if available else F.lit(True),
    }


def child_pattern(category: str | None) -> str:
    """Anchored pattern of the paths one level below the selection, or of the roots."""
    return f"^({re.escape(category)}/)[^/]+$" if category else "^[^/]+$"


def facet_rows(found: DataFrame, brands: tuple[str, ...] = (), category: str | None = None, available: str | None = None) -> DataFrame:
    """(dimension, value) rows of one scan, a row for each count."""
    chosen = selections(brands, category, available)
    none = F.array().cast("array<struct<dimension:string,value:string>>")
    pair = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))
    below = F.filter("category.path", lambda p: p.rlike(child_pattern(category)))
    bucket = F.when(availability("in_stock"), "in_stock").when(availability("out_of_stock"), "out_of_stock")
    rows = F.concat(
        F.when(chosen["category"] & chosen["availability"], F.array(pair("brand", F.col("brand")))).otherwise(none),
        F.when(chosen["brand"] & chosen["availability"], F.transform(below, lambda p: pair("category", p))).otherwise(none),
        F.when(chosen["brand"] & chosen["category"] & bucket.isNotNull(), F.array(pair("availability", bucket))).otherwise(none),
    )
    return found.select(F.inline(rows))


def facet_counts(found: DataFrame, brands: tuple[str, ...] = (), category: str | None = None, available: str | None = None, top: int = TOP) -> DataFrame:
    """(dimension, value, n, place): the top values by count, then value; both availability buckets, zeros included."""
    counted = facet_rows(found, brands, category, available).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    always = found.sparkSession.range(1).select(F.explode(F.array(F.lit("in_stock"), F.lit("out_of_stock"))).alias("value")).select(F.lit("availability").alias("dimension"), "value", F.lit(0).cast("bigint").alias("n"))
    whole = counted.unionByName(always).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    listed = F.when(F.col("dimension") == "availability", F.lit(0)).otherwise(-F.col("n"))
    place = F.row_number().over(Window.partitionBy("dimension").orderBy(listed, "value"))
    return whole.withColumn("place", place).where(F.col("place") <= top)
