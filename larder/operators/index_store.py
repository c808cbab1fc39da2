"""What a catch-up does to the indexed documents: changed ones in, deleted ones out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.documents import FIELDS


def caught_up(index: DataFrame, changed: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The index with changed documents in place of its own, without the deleted ids."""
    fresh = changed.select(*FIELDS)
    gone = tombstones.select("id").unionByName(fresh.select("id")).distinct()
    return index.select(*FIELDS).join(gone, "id", "left_anti").select(*FIELDS).unionByName(fresh.join(tombstones.select("id").distinct(), "id", "left_anti").select(*FIELDS))


def deleted_count(index: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: documents that the tombstones really remove; ids that the index lacks aren't counted."""
    return index.join(tombstones.select("id"), "id", "left_semi").agg(F.count("*").alias("deleted"))
