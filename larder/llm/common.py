"""Shared pieces of the operators: table access, shared scratch tables, Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a Python function handles at a time, so that its output stays small beside the input.
BATCH_ROWS = 1024

_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set and all tasks run in this process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_scratch:
        _local_scratch.append(tempfile.mkdtemp(prefix="larder-"))
    return f"file://{_local_scratch[0]}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet to shared storage, in folders by a column if one is named, and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/larder/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._larder_path = path
    return out


def holding(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df, which reads these materialized tables, so that release(df) deletes them too."""
    df._larder_tables = tables
    return df


def release(df: DataFrame, folder: str = "") -> None:
    """Delete the tables that materialize() wrote of df and of what holding() gave it, once nothing reads them any more; or one folder of df's."""
    for table_of in getattr(df, "_larder_tables", ()):
        release(table_of)
    if path := getattr(df, "_larder_path", None):
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}" if folder else path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, total: int, hot: int = 256, most: int = 20_000) -> DataFrame:
    """rows joined with keyed (one row a key, with n, the rows that hold it; total: the sum of n), so that no task gets a hot key.

    Keys of more rows than hot, and than total / most, are joined by a broadcast: there are at most
    that many of them. All others are joined by a shuffle.
    """
    many = max(hot, ceil(total / most))
    wide = [c for c in keyed.columns if c not in (key, "n")]
    joined = rows.join(F.broadcast(keyed.where(F.col("n") > many).withColumn("_hot", F.lit(True)).drop("n")), key, "left")
    rest = joined.where("_hot IS NULL").drop("_hot", *wide).join(keyed.where(F.col("n") <= many).drop("n"), key)
    return joined.where("_hot").drop("_hot").unionByName(rest)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it counts at most so many rows; else as it is, for a shuffled join.

    df should be cheap to count: a materialized or a small aggregated table.
    """
    return F.broadcast(df) if df.count() <= rows else df


def fields(ddl: str) -> list[T.StructField]:
    return list(T.StructType.fromDDL(ddl).fields)


def map_batches(df: DataFrame, make: Callable[[], Callable], new: str, keep: list[str] | None = None, rows: int = BATCH_ROWS) -> DataFrame:
    """Append the columns ``new`` (DDL) that make()'s function returns, as a list of Arrow arrays, for each batch.

    make() runs once in each task. Columns in ``keep`` (all by default) are carried; a carried
    column whose name clashes with a new one is replaced by it; rows: how many the function gets at a time.
    """
    added = fields(new)
    names = {f.name for f in added}
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in carried] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carried] + work(batch), names=schema.names)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 bytes; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def as_texts(column: pa.Array) -> list[str]:
    """A string column's texts; null counts as empty, bytes that aren't UTF-8 become U+FFFD."""
    return [b.decode("utf-8", "replace") for b in as_bytes(column)]


def key_hash(doc_id: str, modulus: int):
    """crc32 of an id's text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus
