"""How the layout of the daily sales decides the cost of window totals."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.replenishment import window_start, window_totals

RUNS = 3


def stock_driven_totals(stock: DataFrame, sales: DataFrame, as_of: dt.date) -> DataFrame:
    """Totals of every stocked pair, zero sales too: the window narrows the sales before they are joined."""
    q = F.col("quantity").cast("bigint")
    inside = sales.where(F.col("sales_date").between(F.lit(window_start(as_of)), F.lit(as_of)))
    joined = stock.select("store_number", "product_id").join(inside, ["store_number", "product_id"], "left")
    return joined.groupBy("store_number", "product_id").agg(F.sum(q).alias("total"), F.sum(q * q).alias("total_squares"))


def write_layouts(sales: DataFrame, database: str = "default", buckets: int = 16) -> dict[str, str]:
    """Tables of the same rows: bucketed by pair (totals need no exchange), partitioned by month, and plain."""
    names = {k: f"{database}.daily_store_sales_{k}" for k in ("bucketed", "by_month", "plain")}
    rows = sales.select("store_number", "product_id", "sales_date", "quantity")
    rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "store_number", "product_id").sortBy("store_number", "product_id", "sales_date").saveAsTable(names["bucketed"])
    rows.withColumn("month", F.trunc("sales_date", "month")).repartition("month").write.mode("overwrite").format("parquet").partitionBy("month").saveAsTable(names["by_month"])
    rows.write.mode("overwrite").format("parquet").saveAsTable(names["plain"])
    return names


def table_bytes(spark: SparkSession, name: str) -> int:
    """Size of a table's files, by the catalogue's statistics."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
    return int(str(spark._jsparkSession.table(name).queryExecution().optimizedPlan().stats().sizeInBytes()))


def has_exchange(df: DataFrame) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def counted_totals(sales: DataFrame, as_of: dt.date) -> DataFrame:
    return window_totals(sales, as_of).agg(F.count("*").alias("pairs"))


def compare(spark: SparkSession, layouts: dict[str, str], as_of: dt.date) -> list[dict]:
    """Bytes, whether the totals shuffle, and the seconds of RUNS runs after a first one, by layout."""
    out = []
    for layout, name in layouts.items():
        query = counted_totals(spark.table(name), as_of)
        query.collect()
        seconds = []
        for _ in range(RUNS):
            began = time.monotonic()
            query.collect()
            seconds.append(time.monotonic() - began)
        out.append({"layout": layout, "bytes": table_bytes(spark, name), "shuffles": has_exchange(window_totals(spark.table(name), as_of)), "seconds": seconds})
    return out
