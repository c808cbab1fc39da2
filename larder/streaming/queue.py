"""The change queue as a stream: marks are folded into the store's queue, then drained batch by batch.

A batch that is run again after a failure does no harm: marks merge to the same row, and the drain looks at
the products' present state. The stream waits for other writers, for marks must not be lost. With
``keyed.merged(stream, ...)`` as the stream, marks of a product are merged in state before they reach the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from larder.operators import drain as draining
from larder.operators import maintenance
from larder.operators import outbox as queue
from larder.operators.store import Change, Store


def changes(spark: SparkSession, folder: str, schema: str | StructType, per_batch: int | None = None) -> DataFrame:
    """The stream of marks that files of a folder bring."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def maintain(stream: DataFrame, store: Store, documents: Callable[[], DataFrame], checkpoint: str, index_name: str, owner: str = "stream", limit: int = queue.DRAIN_LIMIT, on_result: Callable[[draining.DrainResult], None] | None = None, patience: float = 3600.0, every: str | None = None) -> StreamingQuery:
    """Fold each micro-batch into the queue and drain it until a batch leaves nothing further to do.

    every: the time between micro-batches of a stream that stays; by default it ends with what there is.
    """

    def batch(arrived: DataFrame, _: int) -> None:
        marks = store.stage(arrived)  # read several times, and state may be worked out only once
        if marks.isEmpty():
            return
        lease = maintenance.wait_for_lease(store, owner, patience)
        try:
            change = Change(store, lease)
            maintenance.enqueue(store, change, marks)
            change.commit()
            for result in maintenance._drain(store, lease, documents, index_name, limit):
                if on_result:
                    on_result(result)
        finally:
            store.release(lease)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
