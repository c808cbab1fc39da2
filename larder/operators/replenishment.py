"""Order suggestions: a periodic-review, order-up-to policy over a window of sparse daily sales."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.codes import strict_date, two_decimals


#: Days of the window and of the period that an order covers (review and delivery), and the service factor.
WINDOW_DAYS, COVER_DAYS, SERVICE = 28, 14, 1.65


class PreconditionFailed(RuntimeError):
    """The history or the output folder doesn't allow a run; nothing was written."""


def window_start(as_of: dt.date) -> dt.date:
    return as_of - dt.timedelta(days=WINDOW_DAYS - 1)


def window_totals(sales: DataFrame, as_of: dt.date) -> DataFrame:
    """Sum and sum of squares by store and product over the window; pairs without sales are absent."""
    q = F.col("quantity").cast("bigint")
    inside = sales.where(F.col("sales_date").between(F.lit(window_start(as_of)), F.lit(as_of)))
    return inside.groupBy("store_number", "product_id").agg(F.sum(q).alias("total"), F.sum(q * q).alias("total_squares"))


def with_stock(totals: DataFrame, products: DataFrame, stock: DataFrame) -> DataFrame:
    """Totals of products that still exist, with stock on hand and on order, zero where there is no row.

    The totals are aggregated before they are joined, so only one row a pair meets the dimensions.
    """
    known = products.select(F.col("id").alias("product_id"), "sku")
    joined = totals.join(known, "product_id").join(stock, ["store_number", "product_id"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quantity_on_hand", "quantity_on_order")})


def suggestions(totals: DataFrame) -> DataFrame:
    """Order quantity up to mean demand over the covered days plus safety stock; rows without an order go."""
    days = F.lit(float(WINDOW_DAYS))
    mean = F.col("total") / days
    variance = (F.col("total_squares") - F.col("total") * F.col("average_daily_demand")) / F.lit(float(WINDOW_DAYS - 1))
    safety = F.lit(SERVICE) * F.sqrt(F.lit(float(COVER_DAYS))) * F.sqrt(F.greatest(F.lit(0.0), variance))
    need = F.col("average_daily_demand") * F.lit(float(COVER_DAYS)) + F.col("safety_stock") - F.col("quantity_on_hand") - F.col("quantity_on_order")
    return (
        totals.withColumn("average_daily_demand", mean)
        .withColumn("safety_stock", safety)
        .withColumn("order_quantity", F.ceil(need).cast("bigint"))
        .where(F.col("order_quantity") > 0)
        .select("store_number", "sku", "average_daily_demand", "safety_stock", "quantity_on_hand", "quantity_on_order", "order_quantity")
    )


def last_sales_date(sales: DataFrame) -> DataFrame:
    return sales.agg(F.max("sales_date").alias("last_sales_date"))


def check_history(sales: DataFrame, as_of: dt.date) -> None:
    """The day itself must have sales, and some sale must lie on or before the window's first day."""
    if sales.where(F.col("sales_date") == F.lit(as_of)).isEmpty():
        raise PreconditionFailed(f"no sales on {as_of}")
    if sales.where(F.col("sales_date") <= F.lit(window_start(as_of))).isEmpty():
        raise PreconditionFailed(f"the history doesn't reach {window_start(as_of)}")


def suggest(sales: DataFrame, products: DataFrame, stock: DataFrame, as_of: dt.date) -> DataFrame:
    return suggestions(with_stock(window_totals(sales, as_of), products, stock))


def csv_rows(found: DataFrame) -> DataFrame:
    """The report's columns, in the order of stores and SKUs."""
    return found.orderBy("store_number", "sku").select("store_number", "sku", two_decimals(F.col("average_daily_demand")).alias("average_daily_demand"), two_decimals(F.col("safety_stock")).alias("safety_stock"), "quantity_on_hand", "quantity_on_order", "order_quantity")


def write_report(sales: DataFrame, products: DataFrame, stock: DataFrame, as_of: str, output: str) -> int:
    """Write the suggestions as one CSV file, replacing an older one only when all rows are there; returns their number.

    The folder must be one that the driver and the executors share.
    """
    day = strict_date(as_of)
    folder = os.path.dirname(os.path.abspath(output))
    if not os.path.isdir(folder) or not os.access(folder, os.W_OK):
        raise PreconditionFailed(f"{folder} can't be written to")
    check_history(sales, day)
    rows = csv_rows(suggest(sales, products, stock, day))
    work = tempfile.mkdtemp(prefix=".report-", dir=folder)
    try:
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(f"file://{work}/csv")
        part = next(f"{work}/csv/{f}" for f in sorted(os.listdir(f"{work}/csv")) if f.startswith("part-"))
        with open(part, encoding="utf-8") as lines:
            number = sum(1 for _ in lines) - 1
        if number < 0:  # no row at all leaves no header
            with open(part, "w", encoding="utf-8") as out:
                out.write(",".join(rows.columns) + "\n")
            number = 0
        os.replace(part, output)
        return number
    finally:
        shutil.rmtree(work, ignore_errors=True)


def rolled_totals(previous: DataFrame, sales: DataFrame, as_of: dt.date) -> DataFrame:
    """Yesterday's window totals moved to as_of: the new day added, the day that leaves the window taken off; pairs at zero go."""
    q = F.col("quantity").cast("bigint")
    leaves = window_start(as_of) - dt.timedelta(days=1)
    sign = F.when(F.col("sales_date") == F.lit(as_of), 1).otherwise(-1)
    edges = sales.where(F.col("sales_date").isin(as_of, leaves)).select("store_number", "product_id", (sign * q).alias("total"), (sign * q * q).alias("total_squares"))
    moved = previous.select("store_number", "product_id", "total", "total_squares").unionByName(edges)
    return moved.groupBy("store_number", "product_id").agg(F.sum("total").alias("total"), F.sum("total_squares").alias("total_squares")).where("total > 0")
