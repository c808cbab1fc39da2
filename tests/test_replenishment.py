import datetime as dt

import pytest

from larder.operators import replenishment as r

DAY = dt.date(2026, 9, 30)
TOTALS = "store_number int, sku string, total bigint, total_squares bigint, quantity_on_hand bigint, quantity_on_order bigint"


@pytest.mark.parametrize(("hand", "order", "quantity"), [(5, 0, 39), (5, 10, 29), (44, 0, None), (43, 0, 1)])
def test_policy(spark, hand, order, quantity):
    rows = r.suggestions(spark.createDataFrame([(1, "TEST-SKU", 49, 343, hand, order)], TOTALS)).collect()
    assert [x["order_quantity"] for x in rows] == ([] if quantity is None else [quantity])
    for x in rows:
        assert x["average_daily_demand"] == 1.75 and x["safety_stock"] == pytest.approx(19.057, abs=1e-3)


def sales(spark, rows):
    return spark.createDataFrame([(1, "p1", dt.date.fromisoformat(d), q) for d, q in rows], "store_number int, product_id string, sales_date date, quantity int")


def products(spark):
    return spark.createDataFrame([("p1", "MAK-DHP484Z")], "id string, sku string")


def stock(spark, rows=()):
    return spark.createDataFrame(list(rows), "store_number int, product_id string, quantity_on_hand bigint, quantity_on_order bigint")


def test_window_totals_and_stock(spark):
    sold = sales(spark, [(f"2026-09-{d}", 7) for d in range(24, 31)] + [("2026-08-01", 100)])
    row = r.with_stock(r.window_totals(sold, DAY), products(spark), stock(spark, [(1, "p1", 5, 10), (2, "p1", 3, 0)])).collect()
    assert [(x["total"], x["total_squares"], x["quantity_on_hand"], x["quantity_on_order"]) for x in row] == [(49, 343, 5, 10)]
    edge = r.window_totals(sales(spark, [("2026-09-02", 100), ("2026-09-03", 28)]), DAY).first()
    assert edge["total"] == 28
    bare = r.with_stock(r.window_totals(sold, DAY), products(spark), stock(spark)).first()
    assert (bare["quantity_on_hand"], bare["quantity_on_order"]) == (0, 0)


def test_report(spark, tmp_path):
    out = tmp_path / "orders.csv"
    sold = sales(spark, [("2026-09-02", 1), ("2026-09-30", 28)])
    assert r.write_report(sold, products(spark), stock(spark), "2026-09-30", str(out)) == 1
    assert out.read_text().splitlines()[1] == "1,MAK-DHP484Z,1.00,32.67,0,0,47"
    before = out.read_text()
    for rows, day, error in ([("2026-09-04", 1), ("2026-09-30", 1)], "2026-09-30", r.PreconditionFailed), ([("2026-09-02", 1)], "2026-09-30", r.PreconditionFailed), ([("2026-09-02", 1)], "2026-02-30", ValueError):
        with pytest.raises(error):
            r.write_report(sales(spark, rows), products(spark), stock(spark), day, str(out))
        assert out.read_text() == before
    with pytest.raises(r.PreconditionFailed):
        r.write_report(sold, products(spark), stock(spark), "2026-09-30", str(tmp_path / "no" / "x.csv"))
    assert [f.name for f in tmp_path.iterdir()] == ["orders.csv"]


def test_rolled_totals_equal_fresh_ones(spark):
    sold = sales(spark, [("2026-09-02", 5), ("2026-09-03", 2), ("2026-09-15", 4), ("2026-09-30", 3)])
    rolled = r.rolled_totals(r.window_totals(sold, DAY - dt.timedelta(days=1)), sold, DAY)
    assert sorted(rolled.collect()) == sorted(r.window_totals(sold, DAY).collect())
