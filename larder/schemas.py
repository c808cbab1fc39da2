"""Declared schemas, and the strict check that a frame has exactly the declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SchemaMismatch(ValueError):
    """A frame's columns aren't the declared ones."""


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "money": T.DecimalType(12, 2), "paths": T.StructType([T.StructField("path", T.ArrayType(T.StringType()))])}


def _ddl(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (column.split() for column in text.split(","))])


BRAND = _ddl("id string, name string, created_at timestamp, updated_at timestamp")
CATEGORY = _ddl("id string, name string, slug_path string, created_at timestamp, updated_at timestamp")
PRODUCT = _ddl("id string, sku string, name string, description string, ean string, price_in_minor_units int, stock_quantity int, visible boolean, brand_id string, category_id string, created_at timestamp, updated_at timestamp")
DELETED_PRODUCT = _ddl("id string, deleted_at timestamp")
OUTBOX = _ddl("index_name string, product_id string, scope_mask int, operation string, marked_at timestamp")
CHANGE_EVENT = _ddl("index_name string, product_id string, scope_mask int, operation string, marked_at timestamp, seq bigint")
SYNC_RUN = _ddl("ran_at timestamp, written_product_count int, unchanged_product_count int, elapsed_milliseconds int")
DAILY_STORE_SALES = _ddl("store_number int, product_id string, sales_date date, quantity int")
STORE_STOCK = _ddl("store_number int, product_id string, quantity_on_hand bigint, quantity_on_order bigint")
#: The indexed document; anything else is refused.
DOCUMENT = _ddl("id string, sku string, name string, description string, brand string, category paths, price money, stock_quantity int, ean string, visible boolean, product_updated_at timestamp")


def assert_schema(df: DataFrame, declared: T.StructType) -> DataFrame:
    """df with its columns in declared order; raises where a column is missing, undeclared or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in declared}
    wrong = [f"{name}: {have.get(name, 'missing')} instead of {want.get(name, 'nothing')}" for name in [*want, *(h for h in have if h not in want)] if have.get(name) != want.get(name)]
    if wrong:
        raise SchemaMismatch("; ".join(str(w) for w in wrong))
    return df.select(*declared.names)
