"""Keyed state of the change queue: any order of arrival, timers, restarts, and the way to the store."""

import datetime as dt
import itertools
import random
import time

from larder.operators import maintenance, outbox
from larder.operators.documents import build_documents
from larder.streaming import keyed
from larder.streaming import queue as streaming

T = dt.datetime(2026, 9, 30, 12, 0, 0, 1001)
EVENT = "index_name string, product_id string, scope_mask int, operation string, marked_at timestamp, seq bigint"
DAY = 86400.0


def some_marks(number, seed=7):
    rng = random.Random(seed)
    rows = [(rng.choice(["products", "other"]), rng.choice(["a", "b", "c", None, "ä€"]), rng.choice([1, 2, 4, 3, None]), rng.choice(["write", "delete"]), T + dt.timedelta(microseconds=rng.randrange(10**9)), k) for k in range(number)]
    return rng.sample(rows, number)


def rows(frame):
    return sorted((tuple(r) for r in frame.select(*outbox.COLUMNS).collect()), key=repr)


def arrive(spark, tmp_path, part):
    spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def wait_until(done, query, seconds=90.0):
    until = time.monotonic() + seconds
    while not done():
        if query.exception():
            raise query.exception()
        assert time.monotonic() < until, "the stream did not get there"
        time.sleep(0.2)


def seen(query):
    return sum(p["numInputRows"] for p in query.recentProgress)


def start(spark, tmp_path, delay, sink, per_batch=1):
    stream = keyed.merged(streaming.changes(spark, str(tmp_path / "in"), EVENT, per_batch), delay, DAY)
    return stream.writeStream.outputMode("update").foreachBatch(lambda df, _: sink.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()


def test_merge_in_any_order_is_the_fold():
    marks = [(1, "write", T, 0), (4, "delete", T - dt.timedelta(1), 1), (None, "write", T, 2), (2, "delete", T, None)]
    for order in itertools.permutations(marks):
        got = None
        for mark in order:
            got = keyed.merge(got, None, mark)
        assert got == (7, "write", T, 2), order
    # scopes that were let go are done; what is older than they were keeps their operation and time
    assert keyed.merge(None, (4, "delete", T, 9), (1, "write", T, 5)) == (1, "delete", T, 9)
    assert keyed.merge(None, (4, "delete", T, 9), (1, "write", T, 10)) == (1, "write", T, 10)


def test_state_equals_the_fold_over_shuffled_batches_and_a_restart(spark, tmp_path):
    marks, out = some_marks(60), []
    for part in range(4):
        if part in (0, 2):
            for half in (part, part + 1):
                arrive(spark, tmp_path, marks[half * 15 : half * 15 + 15])
            query = start(spark, tmp_path, DAY, out)
            try:
                wait_until(lambda: seen(query) >= 30, query)
            finally:
                query.stop()
    assert not out
    state = keyed.held(spark, str(tmp_path / "cp"))
    assert state.columns == keyed.COLUMNS
    assert rows(state) == rows(outbox.fold(spark.createDataFrame(marks, EVENT)))


def test_timers_let_merged_marks_go_once(spark, tmp_path):
    marks, out = some_marks(40, seed=8), []
    arrive(spark, tmp_path, marks)
    query = start(spark, tmp_path, 1.0, out)
    try:
        folded = rows(outbox.fold(spark.createDataFrame(marks, EVENT)))
        wait_until(lambda: len(out) >= len(folded), query)
        assert sorted((tuple(r[c] for c in outbox.COLUMNS) for r in out), key=repr) == folded
        # a mark that comes late, of a lower seq: its scope counts, operation and time are the later ones
        newest = max((m for m in marks if m[:2] == ("products", "a")), key=lambda m: m[5])
        out.clear()
        arrive(spark, tmp_path, [("products", "a", 2, "write" if newest[3] == "delete" else "delete", T, -1)])
        wait_until(lambda: out, query)
    finally:
        query.stop()
    assert [tuple(r[c] for c in outbox.COLUMNS) for r in out] == [("products", "a", 2, newest[3], newest[4])]
    assert keyed.held(spark, str(tmp_path / "cp")).isEmpty()


def test_merged_marks_reach_the_store(spark, tmp_path):
    store = maintenance.open_store(spark, f"file://{tmp_path}/store")
    plain = "id string, sku string, name string, description string, brand string, slug_path string, price_in_minor_units int, stock_quantity int, ean string, visible boolean, updated_at timestamp"
    docs = build_documents(spark.createDataFrame([("a", "SKU-1", "Name", "d", "B", "a/b", 700, 5, "859", True, T)], plain))
    lease = store.take("test", 60)
    change = maintenance.Change(store, lease)
    change.put("documents", docs.limit(0))
    change.commit()
    store.release(lease)
    arrive(spark, tmp_path, [("products", "a", 1 << k % 3, "write", T, k) for k in range(12)])
    results = []
    stream = keyed.merged(streaming.changes(spark, str(tmp_path / "in"), EVENT), 0.5, DAY)
    query = streaming.maintain(stream, store, lambda: docs, str(tmp_path / "cp"), "products", on_result=results.append, every="1 second")
    try:
        wait_until(lambda: results, query)
        wait_until(lambda: store.take("other", 0.0) is not None, query)
    finally:
        query.stop()
    assert [(r.taken, r.written, r.still_pending) for r in results] == [(1, 1, 0)]
    assert [r["id"] for r in store.read("documents").collect()] == ["a"]


