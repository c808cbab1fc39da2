"""Search documents from product rows: a fixed set of fields, category ancestors, strict schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import folded_words, stems

FIELDS = ["id", "sku", "name", "description", "brand", "category", "price", "stock_quantity", "ean", "visible", "product_updated_at"]


def ancestors(slug_path: Column) -> Column:
    """a/b/c gives [a, a/b, a/b/c]."""
    parts = F.split(slug_path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def hydrated(products: DataFrame, brands: DataFrame, categories: DataFrame, ids: DataFrame) -> DataFrame:
    """The products of ids (id), with brand and slug path: products (brand_id, category_id), brands and categories (id, name or slug_path).

    A product whose brand or category is missing is left out, as is an id without a product; an id
    that is asked for twice comes once.
    """
    asked = products.join(ids.select("id").distinct(), "id", "left_semi")
    named = asked.join(brands.select(F.col("id").alias("brand_id"), F.col("name").alias("brand")), "brand_id")
    return named.join(categories.select(F.col("id").alias("category_id"), "slug_path"), "category_id").drop("brand_id", "category_id")


def build_documents(products: DataFrame) -> DataFrame:
    """One document for each product row that already carries its brand and slug path."""
    return products.select(
        "id",
        "sku",
        "name",
        "description",
        "brand",
        F.struct(ancestors(F.col("slug_path")).alias("path")).alias("category"),
        (F.col("price_in_minor_units").cast("decimal(12,2)") / 100).cast("decimal(12,2)").alias("price"),
        "stock_quantity",
        "ean",
        "visible",
        F.col("updated_at").alias("product_updated_at"),
    )


def analysed(documents: DataFrame) -> DataFrame:
    """Documents with the derived search columns: stems of name and description, words of the name."""
    return documents.withColumns({"name_stems": stems(F.col("name")), "name_words": folded_words(F.col("name")), "description_stems": stems(F.col("description"))})
