"""Keyed state of the change queue: one merged mark an index and product, held until its timer lets it go.

A product that is marked again and again costs one row a delay, not one a mark. Marks may come in any order:
scopes are united, operation and time are those of the highest seq, also against marks that were let go within
the time remembered. A mark is let go a fixed delay after the first one since the last release, so that steady
marking doesn't hold it back. State lies in the stream's checkpoint, and a stream started again goes on from it.

A null scope adds none; a null seq counts as the earliest; marks of equal seq go by arrival; a null product is a
key like any other; further columns aren't carried.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from larder.operators import outbox as queue

COLUMNS = [*queue.COLUMNS, "seq"]
#: What is kept of a mark, beside its key.
KEPT = [c for c in COLUMNS if c not in queue.KEY]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge(held: tuple | None, last: tuple | None, mark: tuple) -> tuple:
    """held, or nothing, united with a further mark (each as KEPT); last: what was let go, whose scopes are done."""
    mask, *rest = held or (None, *(last[1:] if last else (None, None, None)))
    if mark[0] is not None:
        mask = mark[0] | (mask or 0)
    newer = (held is None and last is None) or rest[-1] is None or (mark[-1] is not None and mark[-1] >= rest[-1])
    return (mask, *(mark[1:] if newer else rest))


class Marks(StatefulProcessor):
    """Holds a key's merged mark; times are in milliseconds."""

    def __init__(self, kept: T.StructType, delay: int, remember: int):
        self.kept, self.delay, self.remember = kept, delay, remember

    def init(self, handle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", self.kept)
        self.last = handle.getValueState("last", self.kept, self.remember)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.mark.get()
        last = self.last.get() if held is None else None
        if held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay)
        for row in rows:
            held = merge(held, last, tuple(row[c] for c in KEPT))
        self.mark.update(tuple(held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = self.mark.get()
        if mark is None:
            return
        self.mark.clear()
        self.last.update(tuple(mark))
        yield Row(**dict(zip(queue.KEY, key, strict=True)), **dict(zip(KEPT, mark, strict=True)))


def merged(stream: DataFrame, delay: float, remember: float) -> DataFrame:
    """The stream of merged marks (with seq): each let go delay seconds after its first part; released ones are remembered for so many seconds.

    Runs under a trigger by processing time; the session's state store becomes RocksDB, which keyed state needs.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    marks = stream.select(*COLUMNS)
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in marks.schema if f.name in KEPT])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in marks.schema])
    processor = Marks(T.StructType([kept[c] for c in KEPT]), round(1000 * delay), round(1000 * remember))
    return marks.groupBy(*queue.KEY).transformWithState(processor, out, "Update", "ProcessingTime")


@contextmanager
def state_partitions(spark: SparkSession, number: int) -> Iterator[None]:
    """Streams that first start meanwhile keep their state in so many partitions, for good: a store is opened for each at every batch."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, number)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The merged marks (with seq) that a stream's state holds as of its last batch."""
    rows = spark.read.format("statestore").option("stateVarName", "mark").load(checkpoint)
    return rows.select("key.*", "value.*").select(*COLUMNS)


def settle(query: StreamingQuery) -> None:
    """Wait until a batch found nothing further in the sources; timers keep batches coming, so the query itself never counts as done."""
    while True:
        if failure := query.exception():
            raise failure
        progress = query.lastProgress
        if progress and all(source["startOffset"] == source["endOffset"] for source in progress["sources"]):
            return
        time.sleep(0.1)
