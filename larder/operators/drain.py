"""Draining the change queue into the indexed documents: partial updates, no-op detection, isolation of refused rows."""

from __future__ import annotations

import datetime as dt
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators import outbox as queue
from larder.operators.documents import FIELDS
from larder.sources.catalog import EVERYTHING, PRICE, STOCK

#: Fields that a partial update sets for a scope; the product's time is set by every update.
PARTIAL = {"price": PRICE, "stock_quantity": STOCK}


class IndexMissing(RuntimeError):
    """There is no index to write to; the rows stay pending."""


class RefusedDocuments(RuntimeError):
    """Some documents were refused; all others were released."""


def _document(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}.{c}").alias(c) for c in FIELDS])


def plan(pending: DataFrame, documents: DataFrame, index: DataFrame, refuse: Column | None = None, conflict: Column | None = None) -> DataFrame:
    """(key columns, marked_at, action, outcome, document) for each pending row.

    action: delete, insert, replace or update; outcome: deleted, not_found, created, updated, noop,
    conflict or failed. The product's present state decides, so the order of the rows doesn't matter.
    refuse and conflict are conditions over new, old and the row, for what a store would turn down.
    """
    new = documents.select(F.col("id").alias("product_id"), F.struct(*FIELDS).alias("new"))
    old = index.select(F.col("id").alias("product_id"), F.struct(*FIELDS).alias("old"))
    rows = pending.join(new, "product_id", "left").join(old, "product_id", "left")
    everything = F.col("scope_mask").bitwiseAND(EVERYTHING) != 0
    action = (
        F.when((F.col("operation") == "delete") | F.col("new").isNull(), "delete")
        .when(F.col("old").isNull(), "insert")
        .when(everything, "replace")
        .otherwise("update")
    )
    partial = F.struct(
        *[
            F.when(queue.has_scope(PARTIAL[c]), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in PARTIAL
            else (F.col("new.product_updated_at") if c == "product_updated_at" else F.col(f"old.{c}")).alias(c)
            for c in FIELDS
        ]
    )
    rows = rows.withColumn("action", action)
    rows = rows.withColumn("document", F.when(F.col("action") == "update", partial).when(F.col("action") != "delete", F.col("new")))
    refused, conflicted = (F.coalesce(c, F.lit(False)) if c is not None else F.lit(False) for c in (refuse, conflict))
    outcome = (
        F.when(conflicted, "conflict")
        .when(refused, "failed")
        .when(F.col("action") == "delete", F.when(F.col("old").isNull(), "not_found").otherwise("deleted"))
        .when(F.col("action") == "insert", "created")
        .when(F.col("document").eqNullSafe(F.col("old")), "noop")
        .otherwise("updated")
    )
    return rows.withColumn("outcome", outcome).select(*queue.KEY, "scope_mask", "operation", "marked_at", "action", "outcome", "document")


def outcome_counts(planned: DataFrame) -> DataFrame:
    """One row: written, unchanged, deleted, conflicts, failures; an absent document's deletion isn't counted."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return planned.agg(n("created", "updated").alias("written"), n("noop").alias("unchanged"), n("deleted").alias("deleted"), n("conflict").alias("conflicts"), n("failed").alias("failures"))


def applied(index: DataFrame, planned: DataFrame) -> DataFrame:
    """The documents after the planned rows that went through."""
    through = planned.where(~F.col("outcome").isin("conflict", "failed"))
    kept = index.select(*FIELDS).join(through.select(F.col("product_id").alias("id")), "id", "left_anti").select(*FIELDS)
    return kept.unionByName(through.where(F.col("document").isNotNull()).select("document.*"))


@dataclass
class DrainResult:
    written: int = 0
    unchanged: int = 0
    deleted: int = 0
    conflicts: int = 0
    failures: int = 0
    elapsed_milliseconds: int = 0
    #: Rows of the batch that stay in the queue: refused, in conflict, or marked again meanwhile.
    still_pending: int = 0
    #: Rows of the batch, and of the index in the queue after it.
    taken: int = 0
    queued: int = 0


def drain(outbox: DataFrame, documents: DataFrame, index: DataFrame | None, index_name: str, limit: int = queue.DRAIN_LIMIT, refuse: Column | None = None, conflict: Column | None = None) -> tuple[DrainResult, DataFrame, DataFrame | None]:
    """One batch: (result, outbox after, documents after). Conflicting and refused rows stay in the outbox.

    Without an index, a batch with any write raises before anything changes. The caller writes the
    returned frames, then raises RefusedDocuments where failures isn't zero (see check_refused).
    """
    began = time.monotonic_ns()
    batch = queue.pending(outbox, index_name, limit)
    if batch.isEmpty():
        return DrainResult(), outbox, index
    if index is None:
        if not batch.where("operation = 'write'").isEmpty():
            raise IndexMissing(f"there is no index {index_name}")
        index = documents.limit(0)
    planned = plan(batch, documents, index, refuse, conflict)
    counts = outcome_counts(planned).first()
    through = planned.where(~F.col("outcome").isin("conflict", "failed"))
    rest = queue.release(outbox, through)
    taken, released = batch.count(), queue.released_count(outbox, through).first()["released"]
    queued = outbox.where(F.col("index_name") == index_name).count() - released
    result = DrainResult(**counts.asDict(), elapsed_milliseconds=(time.monotonic_ns() - began) // 1_000_000, still_pending=taken - released, taken=taken, queued=queued)
    return result, rest, applied(index, planned)


def check_refused(result: DrainResult) -> None:
    if result.failures:
        raise RefusedDocuments(f"{result.failures} documents were refused and stay marked")


def run_rows(spark, results: list[DrainResult], ran_at: dt.datetime) -> DataFrame | None:
    """The run log's rows, a microsecond apart; none for empty batches."""
    rows = [(ran_at + dt.timedelta(microseconds=k), r.written, r.unchanged, r.elapsed_milliseconds) for k, r in enumerate(results) if r.taken]
    return spark.createDataFrame(rows, "ran_at timestamp, written_product_count int, unchanged_product_count int, elapsed_milliseconds int") if rows else None


def run_row(spark, result: DrainResult, ran_at) -> DataFrame | None:
    """The run log's row; none for an empty batch."""
    return run_rows(spark, [result], ran_at)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct(*runs.columns), "ran_at").alias("run")).where("run IS NOT NULL").select("run.*")
