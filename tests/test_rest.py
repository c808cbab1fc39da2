"""Codes, generators, layouts, the entry points, and the rules of the code's structure."""

import ast
import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from larder.functions import codes
from larder.operators import generators, layout_bench
from larder.sources import catalog

ROOT = pathlib.Path(__file__).parents[1]


def test_codes(spark):
    row = spark.range(1).select(codes.ean13(F.lit(9)).alias("ean"), codes.two_decimals(F.lit(1234.5)).alias("two")).first()
    assert tuple(row) == ("8590000000091", "1234.50")
    assert codes.strict_date("2026-09-30") == dt.date(2026, 9, 30)
    for bad in ("2026-02-30", "2026-2-3", "x"):
        with pytest.raises(ValueError):
            codes.strict_date(bad)
    assert codes.strict_integer("-5") == -5
    for bad in ("1.0", None, True):
        with pytest.raises(ValueError):
            codes.strict_integer(bad)


def test_generators(spark):
    products = catalog.product(spark, "/root/testdata/sf0.001")
    sales = generators.sales_history(products, 2, 50, 30, dt.date(2026, 9, 30))
    low, high, last = sales.agg(F.min("quantity"), F.max("quantity"), F.max("sales_date")).first()
    assert (low, high, last) == (1, 5, dt.date(2026, 9, 29))
    assert sales.count() == sales.dropDuplicates(["store_number", "product_id", "sales_date"]).count()
    assert generators.stock(products, 2, 50).count() == 100
    for bounds in ((0, 1, 1), (65_536, 1, 1), (1, 0, 1), (1, 1, 0)):
        with pytest.raises(ValueError):
            generators.check_bounds(*bounds)


def test_feeds_change_a_share_and_stay_below_the_ceiling(spark):
    products = catalog.product(spark, "/root/testdata/sf0.001").withColumns({"updated_at": F.lit(dt.datetime(2026, 1, 1)), "price_in_minor_units": F.lit(1_990_000)})
    fed = products
    for n in range(5):
        fed = generators.feed_changes(fed, f"file{n}", dt.datetime(2026, 2, n + 1))
    assert fed.agg(F.max("price_in_minor_units")).first()[0] <= generators.MAXIMUM_PRICE
    once = generators.feed_changes(products, "file", dt.datetime(2026, 2, 1)).where("updated_at > '2026-01-15'").count()
    assert 0 < once < products.count() / 2
    after, marks, gone = generators.apply_feed(products, products.where("id % 2 = 0").select("id"), "f", dt.datetime(2026, 2, 1), "products", 7)
    assert gone.count() > 0 and after.count() == products.count() - gone.count()
    assert marks.where("operation = 'delete'").count() == gone.count()


def test_layouts(spark):
    sales = spark.range(2000).select((F.col("id") % 5).cast("int").alias("store_number"), (F.col("id") % 50).alias("product_id"), F.date_sub(F.lit(dt.date(2026, 9, 30)), (F.col("id") % 60).cast("int")).alias("sales_date"), F.lit(1).alias("quantity"))
    names = layout_bench.write_layouts(sales, buckets=4)
    day = dt.date(2026, 9, 30)
    assert not layout_bench.has_exchange(layout_bench.window_totals(spark.table(names["bucketed"]), day))
    assert layout_bench.has_exchange(layout_bench.window_totals(spark.table(names["plain"]), day))
    counts = {layout_bench.counted_totals(spark.table(n), day).first()[0] for n in names.values()}
    assert len(counts) == 1
    assert all(layout_bench.table_bytes(spark, n) > 0 for n in names.values())


def test_entry(spark):
    import __spark_entry__ as entry

    names, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(names)
    assert entry.entry(spark).columns[0] == "store_number"


def test_llm_is_optional_and_nothing_imports_it():
    for path in (ROOT / "larder").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("larder.llm" in n for n in names), path


def breaches(source: str) -> list[str]:
    """What a module does that only the store, or only update_product, may do.

    Tables are written by the store alone; rows leave the queue only with their mark; product rows are changed by update_product alone.
    """
    found = []

    def visit(node: ast.AST, function: str) -> None:
        function = node.name if isinstance(node, ast.FunctionDef) else function
        if isinstance(node, ast.Attribute) and node.attr in ("parquet", "saveAsTable") and not (isinstance(node.value, ast.Attribute) and node.value.attr in ("read", "readStream") or isinstance(node.value, ast.Name) and node.value.id == "reader"):
            found.append(f"line {node.lineno}: writes a table")
        if isinstance(node, ast.Call):
            text = ast.unparse(node)
            if isinstance(node.func, ast.Attribute) and node.func.attr == "join" and "left_anti" in text and "outbox" in ast.unparse(node.func.value) and "marked_at" not in text:
                found.append(f"line {node.lineno}: releases queue rows without their mark")
            if isinstance(node.func, ast.Attribute) and node.func.attr == "put" and node.args and isinstance(node.args[0], ast.Constant) and node.args[0].value == "products" and function != "change_product":
                found.append(f"line {node.lineno}: changes products elsewhere")
        for child in ast.iter_child_nodes(node):
            visit(child, function)

    visit(ast.parse(source), "")
    return found


def test_write_rules():
    for path in (ROOT / "larder").rglob("*.py"):
        if "llm" in path.parts or path.name in ("store.py", "layout_bench.py", "replenishment.py"):
            continue
        assert breaches(path.read_text()) == [], path


def test_write_rules_find_breaches():
    assert breaches("df.write.parquet('x')") == ["line 1: writes a table"]
    assert breaches("outbox.join(done, ['index_name', 'product_id'], 'left_anti')") == ["line 1: releases queue rows without their mark"]
    assert breaches("def f(change):\n    change.put('products', rows)") == ["line 2: changes products elsewhere"]
    assert breaches("spark.read.parquet('x')\noutbox.join(done, ['product_id', 'marked_at'], 'left_anti')\ndef change_product(c):\n    c.put('products', rows)") == []
