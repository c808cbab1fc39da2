"""Approximate nearest neighbours by a permutation index, for the largest inner product.

Every vector is represented by the order of its nearest pivots. It is posted in the inverted files of
its POST nearest pivots, each posting with the first PREFIX pivots of its order; a file's postings lie
together, by the pivot's place in the order. A query reads the files of its READ nearest pivots only,
ranks what it reads of each by the footrule distance of the orders (pivots beyond the prefix count as
lying at its end), and ranks the nearest KEEP share, RERANK vectors at least, again by their exact
inner products. The FIRST nearest files give each query a bound, its k-th nearest so far, so that the
others return nearer vectors only. For the inner product, vectors get one more component that makes
their norms equal; queries get zero there.

The pivots are PIVOTS times the cube root of the number of vectors, so that the postings read grow by
a power of 5/3 of the input, not by its square. A file with many postings or readers is split into
cells of at most about FILE_ROWS postings and QUERY_ROWS readers, each searched by itself.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components
take no part, as do rows with a null id; ties go to the smaller id; rows that repeat an id are
separate candidates, but none of a query of that id, and separate queries; long vectors are used whole;
an empty table gives an empty one; other columns, whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import holding, materialize

PIVOTS, POST, READ, FIRST, PREFIX = 14, 4, 96, 8, 32
KEEP, RERANK = 0.5, 100
FILE_ROWS, QUERY_ROWS = 8192, 8192
#: Places compared at a time (queries x postings x PREFIX).
CHUNK = 1 << 20
ENTRY = "pivot int, place int, node bigint, id bigint, bound double, pivots binary, v binary"
FOUND = "query bigint, query_id bigint, node bigint, id bigint, score double"


@dataclass
class Index:
    """The postings (a table on shared storage), the rows they were made of, and what makes up an order."""

    postings: DataFrame
    rows: DataFrame
    pivots: np.ndarray  # with the added component
    square: float  # the largest squared norm
    kind: str  # of the stored components


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v as array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (common["size"] if common else 0))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """The count nearest pivots of each vector, nearest first (n x count); ties to the lower pivot."""
    near = vectors @ pivots.T
    if count < near.shape[1]:
        some = np.sort(np.argpartition(-near, count - 1, axis=1)[:, :count], axis=1)
    else:
        some = np.broadcast_to(np.arange(near.shape[1]), near.shape)
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.uint16)


def footrule(places: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Distance, up to a constant of each query, of queries' places (q x pivots, at most PREFIX) to orders (n x prefix).

    A pivot at place i of an order and at q of the query's adds |i - q|; against the query's pivots
    that the order lacks, each at the end, it saves end - q. So |i - q| + q is summed over the order.
    """
    own = np.arange(orders.shape[1], dtype=np.int16)
    twice = (2 * places).astype(np.int16)
    return np.maximum(np.take(twice, orders, axis=1) - own, own).sum(axis=2, dtype=np.int32)


def _entries(rows: DataFrame, lifted: bool, pivots: np.ndarray, square: float, kind: str, first: int, last: int) -> DataFrame:
    """A row of each vector of rows (node, id, v, bound) for its nearest pivots from first to last; lifted: with the added component."""
    shared, length = rows.sparkSession.sparkContext.broadcast(pivots), min(PREFIX, len(pivots))
    last = min(last, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if not part.num_rows or last <= first:
                    continue
                v = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                more = np.sqrt(np.maximum(0.0, square - (v * v).sum(axis=1))) if lifted else np.zeros(len(v))
                order = nearest_pivots(np.concatenate([v, more[:, None]], axis=1), base, max(last, length))
                rows_of = pa.array(np.repeat(np.arange(len(v)), last - first))
                raw = [pa.array([x.tobytes() for x in m], pa.binary()).take(rows_of) for m in (order[:, :length].astype("<u2"), v.astype(kind))]
                place = np.tile(np.arange(first, last, dtype=np.int32), len(v))
                columns = [pa.array(order[:, first:last].astype(np.int32).ravel()), pa.array(place), *(part.column(c).take(rows_of) for c in ("node", "id", "bound")), *raw]
                yield pa.RecordBatch.from_arrays(columns, names=["pivot", "place", "node", "id", "bound", "pivots", "v"])

    return rows.select("node", "id", "bound", "v").mapInArrow(run, ENTRY)


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Index | None:
    """The index of all vectors that take part; None where none does."""
    kind = "<f4" if vectors.schema[vector].dataType == T.ArrayType(T.FloatType()) else "<f8"
    rows = materialize(valid(vectors, key, vector).select(F.monotonically_increasing_id().alias("node"), "id", "v"), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    number, square = rows.agg(F.count("*"), F.max(norm)).first()
    if not number:
        return None
    wanted = max(16, ceil(PIVOTS * number ** (1 / 3)))
    # at most twice as many vectors as pivots
    sample = rows.orderBy(F.xxhash64("id"), "id", "node").limit(2 * wanted).select("v").dropDuplicates(["v"]).limit(wanted).collect()
    base = np.array(sorted(r["v"] for r in sample), np.float64)
    base = np.concatenate([base, np.sqrt(np.maximum(0.0, square - (base * base).sum(axis=1)))[:, None]], axis=1)
    postings = _entries(rows.withColumn("bound", F.lit(0.0)), True, base, square, kind, 0, POST)
    return Index(materialize(postings.sortWithinPartitions("pivot", "place"), "postings"), rows, base, square, kind)


class Cell:
    """One file's postings, or a part of them."""

    def __init__(self, batches: list[pa.RecordBatch], kind: str):
        whole = pa.Table.from_batches(batches).combine_chunks()
        self.node, self.id = whole.column("node").to_numpy(), whole.column("id").to_numpy()
        self.orders = np.frombuffer(b"".join(whole.column("pivots").to_pylist()), "<u2").reshape(len(self.node), -1)
        self.vectors = np.frombuffer(b"".join(whole.column("v").to_pylist()), kind).reshape(len(self.node), -1).astype(np.float64)

    def search(self, asked: pa.RecordBatch, pivots: int, k: int, kind: str) -> Iterator[pa.RecordBatch]:
        """The k nearest found for each query, of those at least as near as its bound."""
        count, length = len(self.node), self.orders.shape[1]
        kept = min(count, max(RERANK, ceil(KEEP * count)))
        step = max(1, CHUNK // (count * length))
        for at in range(0, asked.num_rows, step):
            part = asked.slice(at, step)
            n = part.num_rows
            node, own, bound = (part.column(c).to_numpy() for c in ("node", "id", "bound"))
            orders = np.frombuffer(b"".join(part.column("pivots").to_pylist()), "<u2").reshape(n, -1)
            vectors = np.frombuffer(b"".join(part.column("v").to_pylist()), kind).reshape(n, -1).astype(np.float64)
            places = np.full((n, pivots), length, np.int16)
            np.put_along_axis(places, orders.astype(np.int64), np.arange(length, dtype=np.int16)[None], 1)
            if kept < count:
                near = np.argpartition(footrule(places, self.orders), kept - 1, axis=1)[:, :kept]
            else:
                near = np.broadcast_to(np.arange(count), (n, count))
            out = []
            for q in range(n):
                some = near[q]
                score = (self.vectors[some] * vectors[q]).sum(axis=1)
                fits = np.flatnonzero((score >= bound[q]) & (self.id[some] != own[q]))
                if len(fits) > k:
                    least = np.partition(score[fits], len(fits) - k)[len(fits) - k]
                    fits = fits[score[fits] >= least]
                    fits = fits[np.lexsort((self.node[some[fits]], self.id[some[fits]], -score[fits]))[:k]]
                out.append((np.full(len(fits), q), some[fits], score[fits]))
            row, hit, score = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(node[row]), pa.array(own[row]), pa.array(self.node[hit]), pa.array(self.id[hit]), pa.array(score)], names=["query", "query_id", "node", "id", "score"])


def _visit(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """What the queries (ENTRY) find in the files of their pivots (FOUND)."""
    spark, kind, pivots = queries.sparkSession, index.kind, len(index.pivots)
    parts_of = lambda df, rows: df.groupBy("pivot").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    sizes = parts_of(index.postings, FILE_ROWS).toDF("pivot", "blocks").join(parts_of(queries, QUERY_ROWS).toDF("pivot", "chunks"), "pivot")
    # a row for each pivot at most
    sizes = F.broadcast(spark.createDataFrame(sizes.collect(), "pivot int, blocks int, chunks int"))
    entry = ["node", "id", "bound", "pivots", "v"]
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.postings.join(sizes, "pivot").select("pivot", part("blocks").alias("block"), every("chunks").alias("chunk"), F.lit(0).alias("side"), *entry)
    read = queries.join(sizes, "pivot").select("pivot", every("blocks").alias("block"), part("chunks").alias("chunk"), F.lit(1).alias("side"), *entry)
    tasks = max(2 * spark.sparkContext.defaultParallelism, ceil(pivots / 8))
    dealt = held.union(read).repartition(tasks, "pivot", "block", "chunk").sortWithinPartitions("pivot", "block", "chunk", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, postings, cell = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("pivot", "block", "chunk", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now, part = tuple(key[a, :3]), batch.slice(a, b - a)
                if now != at:
                    at, postings, cell = now, [], None
                if not key[a, 3]:
                    postings.append(part)
                elif postings:
                    cell = cell or Cell(postings, kind)
                    yield from cell.search(part, pivots, k, kind)

    return dealt.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "id", "node")
    once = found.dropDuplicates(["query", "node"])  # a vector is posted several times
    return once.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)


def search_index(index: Index, asked: DataFrame, k: int = 20, read: int = READ) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each row of asked (node, id, v), which are rows of the index."""
    entries = lambda rows, a, b: _entries(rows, False, index.pivots, index.square, index.kind, a, b)
    first = materialize(_visit(index, entries(asked.withColumn("bound", F.lit(-inf)), 0, min(FIRST, read)), k), "nearest-files")
    bounds = _ranked(first, k).where(F.col("rank") == k).select(F.col("query").alias("node"), F.col("score").alias("bound"))
    bounded = asked.join(bounds, "node", "left").select("node", "id", "v", F.coalesce("bound", F.lit(-inf)).alias("bound"))
    bounded = materialize(bounded, "bounded-queries")
    rest = _visit(index, entries(bounded, FIRST, read), k)
    return holding(_ranked(first.union(rest), k).select("query_id", "rank", "id", "score"), first, bounded, index.postings, index.rows)


def search(vectors: DataFrame, queries: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", read: int = READ) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each row for which queries (SQL over id) is true."""
    index = build(vectors, key, vector)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score double")
    return search_index(index, index.rows.where(queries), k, read)
