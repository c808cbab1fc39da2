"""The change queue: merging, release, drain decisions, rebuild, drift, stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder import schemas
from larder.operators import drain, drift, outbox
from larder.operators.documents import build_documents

T = dt.datetime(2026, 9, 30, 12, 0, 0, 1000)
MS = dt.timedelta(milliseconds=1)
EVENT = "index_name string, product_id string, scope_mask int, operation string, marked_at timestamp, seq bigint"


def marks(spark, *rows):
    return spark.createDataFrame([("products", p, m, o, t, i) for i, (p, m, o, t) in enumerate(rows)], EVENT)


def docs(spark, **prices):
    rows = [(i, f"SKU-{i}", f"Name {i}", "d", "B", "a/b", 100 * p, 5, "859", True, T) for i, p in prices.items()]
    return build_documents(spark.createDataFrame(rows, "id string, sku string, name string, description string, brand string, slug_path string, price_in_minor_units int, stock_quantity int, ean string, visible boolean, updated_at timestamp"))


def test_marks_merge_and_the_last_one_wins(spark):
    rows = outbox.fold(marks(spark, ("p", 1, "write", T), ("p", 2, "write", T + MS), ("q", 4, "delete", T), ("q", 1, "write", T - MS))).withColumn("scopes", outbox.scopes())
    got = {r["product_id"]: r for r in rows.collect()}
    assert got["p"]["scopes"] == ["PRICE", "STOCK"]
    assert (got["q"]["operation"], got["q"]["scope_mask"], got["q"]["marked_at"]) == ("write", 5, T - MS)
    assert outbox.enqueue(outbox.fold(marks(spark, ("p", 1, "write", T))), marks(spark)).count() == 1


def test_release_keeps_rows_marked_again(spark):
    read = outbox.fold(marks(spark, ("p", 1, "write", T), ("q", 1, "write", T)))
    now = outbox.enqueue(read, marks(spark, ("p", 2, "write", T + 5 * MS)))
    assert [r["product_id"] for r in outbox.release(now, read).collect()] == ["p"]
    assert outbox.released_count(now, read).first()[0] == 1
    other = read.withColumn("index_name", F.lit("other"))
    assert {r["index_name"]: r["pending"] for r in outbox.depth(now.unionByName(other)).collect()} == {"products": 2, "other": 2}


def run(spark, index, now, *rows, **more):
    return drain.drain(outbox.fold(marks(spark, *rows)), now, index, "products", **more)


def test_everything_twice_is_written_once(spark):
    result, left, index = run(spark, docs(spark, a=1), docs(spark, a=2), ("a", 4, "write", T))
    assert (result.written, result.unchanged, result.still_pending, left.count()) == (1, 0, 0, 0)
    result, _, _ = run(spark, index, docs(spark, a=2), ("a", 4, "write", T))
    assert (result.written, result.unchanged) == (0, 1)


def test_partial_update_sets_only_its_scope(spark):
    new = docs(spark, a=2).withColumn("name", F.lit("Other"))
    _, _, index = run(spark, docs(spark, a=1), new, ("a", 1, "write", T))
    row = index.first()
    assert (row["name"], float(row["price"])) == ("Name a", 2.0)


def test_missing_document_is_written_whole_and_missing_product_deleted(spark):
    result, _, index = run(spark, docs(spark, a=1, b=1), docs(spark, a=1, c=3), ("c", 1, "write", T), ("b", 1, "write", T), ("d", 4, "delete", T), ("a", 4, "delete", T))
    assert (result.written, result.deleted, result.unchanged) == (1, 2, 0)
    assert [r["id"] for r in index.collect()] == ["c"]


def test_index_missing(spark):
    with pytest.raises(drain.IndexMissing):
        run(spark, None, docs(spark, a=1), ("a", 1, "write", T))
    result, left, _ = run(spark, None, docs(spark, a=1), ("a", 4, "delete", T))
    assert (result.deleted, left.count()) == (0, 0)


def test_empty_queue_leaves_no_run(spark):
    result, _, _ = run(spark, docs(spark, a=1), docs(spark, a=1))
    assert result == drain.DrainResult() and drain.run_row(spark, result, T) is None


def test_refused_and_conflicting_rows_stay(spark):
    rows = [(p, 4, "write", T) for p in "abc"]
    result, left, index = run(spark, docs(spark, a=1, b=1, c=1), docs(spark, a=2, b=2, c=2), *rows, refuse=F.col("product_id") == "a", conflict=F.col("product_id") == "b")
    assert (result.written, result.failures, result.conflicts, result.still_pending) == (1, 1, 1, 2)
    assert sorted(r["product_id"] for r in left.collect()) == ["a", "b"]
    assert {r["id"]: float(r["price"]) for r in index.collect()} == {"a": 1.0, "b": 1.0, "c": 2.0}
    with pytest.raises(drain.RefusedDocuments):
        drain.check_refused(result)


def test_update_product_marks_what_changed(spark):
    products = spark.createDataFrame([("a", 100, 5, T)], "id string, price_in_minor_units int, stock_quantity int, updated_at timestamp")
    empty = outbox.fold(marks(spark))
    changed, queue = outbox.update_product(products, empty, "a", "products", T + MS, price_in_minor_units=200)
    assert changed.first()["price_in_minor_units"] == 200 and queue.first()["scope_mask"] == 1
    same, none = outbox.update_product(products, empty, "a", "products", T)
    assert same is products and none is empty
    with pytest.raises(ValueError):
        outbox.update_product(products, empty, "a", "products", T, stock_quantity=-1)


def test_tombstones(spark):
    stored = spark.createDataFrame([("a", T)], "id string, deleted_at timestamp")
    more = spark.createDataFrame([("a", T + MS, 1), ("b", T, 2)], "id string, deleted_at timestamp, seq bigint")
    assert sorted(outbox.tombstones(stored, more).collect()) == [("a", T + MS), ("b", T)]


def test_strict_schema(spark):
    d = docs(spark, a=1)
    assert schemas.assert_schema(d, schemas.DOCUMENT).columns == schemas.DOCUMENT.names
    with pytest.raises(schemas.SchemaMismatch):
        schemas.assert_schema(d.withColumn("extra", F.lit(1)), schemas.DOCUMENT)


def test_drift(spark):
    index = docs(spark, a=1, b=1, x=1)
    now = docs(spark, a=1, b=2, c=1)
    assert sorted(r["id"] for r in drift.drifted(now, index).collect()) == ["b", "c"]
    assert drift.drifted(now, None).count() == 3
    assert drift.surplus(docs(spark, a=1), docs(spark, a=1, x=1)).first()[0] == 1
    assert drift.surplus(now, None).first()[0] == 0
    assert drift.report(drift.drifted(now, index)) == (["b", "c"], 2)
