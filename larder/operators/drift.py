"""Whether the indexed documents still say what the products say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.documents import FIELDS
from larder.sources.catalog import recently_changed

REPORTED = 20


def drifted(documents: DataFrame, index: DataFrame | None) -> DataFrame:
    """Ids whose document is missing or differs in any field; without an index, all of them."""
    if index is None:
        return documents.select("id")
    old = index.select("id", F.struct(*FIELDS).alias("old"))
    return documents.select("id", F.struct(*FIELDS).alias("new")).join(old, "id", "left").where(~F.col("new").eqNullSafe(F.col("old"))).select("id")


def drifted_in_sample(products: DataFrame, documents: DataFrame, index: DataFrame | None, limit: int) -> DataFrame:
    """One row: how many of the products that changed last have drifted."""
    sample = documents.join(F.broadcast(recently_changed(products, limit).select("id")), "id", "left_semi")
    return drifted(sample, index).agg(F.count("*").alias("drifted"))


def surplus(documents: DataFrame, index: DataFrame | None) -> DataFrame:
    """One row: documents in the index less products; below zero where the index lacks some, zero without an index."""
    if index is None:
        return documents.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("surplus"))
    sides = index.select(F.lit(1).alias("side")).unionByName(documents.select(F.lit(-1).alias("side")))
    return sides.agg(F.coalesce(F.sum("side"), F.lit(0)).cast("bigint").alias("surplus"))


def report(ids: DataFrame) -> tuple[list, int]:
    """The first drifted ids, and the number of all."""
    return [r["id"] for r in ids.orderBy("id").limit(REPORTED).collect()], ids.count()
