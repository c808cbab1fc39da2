"""Best-fit packing of tokenised documents into sequences of a fixed length.

Hierarchical residual packing: each partition packs its items best-fit (longest first, into the bin
with the least room that still holds them), nearly full bins are emitted, and underfull bins become
items of the next round, in fewer partitions, until one level holds them all or a task would hold
more than MERGE_ITEMS of them. Bins carry their members, never more than the capacity.

Null texts count as empty (their ids are the end id alone); texts over a sequence are cut into pieces,
however long; items of equal length go by the hashes of their columns; repeated rows are packed as often as
they occur; an empty table gives an empty one; other columns of the items are carried along.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.byte_bpe import byte_characters
from larder.llm.common import as_texts, fields, materialize, release

CACHE_WORDS, CACHE_PIECES = 1 << 18, 1 << 19
#: Items that one task packs at a time; bins within SLACK tokens of the capacity count as full.
WINDOW, MERGE_ITEMS, FAN_IN, SLACK = 40_000, 80_000, 8, 8


#: Fixed values of the tokenizer: how it splits normalised text, and beyond what its normalisation isn't plain lower case.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
BEYOND = regex.compile("[^\x00-\u024f]").search


class WordCodec:
    """Ids of a lower-casing tokenizer that never joins text across spaces, remembered by word and by piece."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.mapped = dict(enumerate(byte_characters()))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if BEYOND(text):
            return b"".join(np.array(got.ids, "<u4").tobytes() for got in self.tokenizer.encode_batch_fast(text.split(" "), add_special_tokens=False))
        words, known, pieces = text.lower().split(" "), self.words, self.pieces
        missing = set(words).difference(known)
        if missing:
            if len(known) > CACHE_WORDS:
                known.clear()
                missing = set(words)
            parts = {w: PIECE(w) for w in missing}
            if new := set(chain.from_iterable(parts.values())).difference(pieces):
                if len(pieces) > CACHE_PIECES:
                    pieces.clear()
                    new = set(chain.from_iterable(parts.values()))
                for piece in new:
                    mapped = piece.encode().decode("latin-1").translate(self.mapped)
                    pieces[piece] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            for word, own in parts.items():
                known[word] = b"".join([pieces[p] for p in own])
        return b"".join(map(known.__getitem__, words))


_codecs: dict[str, WordCodec] = {}


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each piece of at most capacity ids: piece, start, length and ids (little-endian unsigned 32-bit)."""
    schema = T.StructType([docs.schema[c] for c in keep] + fields("piece int, start bigint, length bigint, ids binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codecs.setdefault(tokenizer_file, None) or WordCodec(tokenizer_file)
        _codecs[tokenizer_file] = own
        end, step = np.array([end_id], "<u4").tobytes(), capacity * 4
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, piece, ids = [], [], []
                for i, value in enumerate(as_texts(part.column(text))):
                    whole = own.encode(value) + end
                    for k in range(0, len(whole), step):
                        row.append(i)
                        piece.append(k // step)
                        ids.append(whole[k : k + step])
                number = np.array(piece, np.int64)
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(row, pa.int32())) for c in keep] + [pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(lengths), pa.array(ids, pa.binary())],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the bin with the least room that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while some bin has r left
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        length = lengths[i]
        fitting = rooms >> length
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + length
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if left := room - length:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _round(bins: DataFrame, capacity: int) -> DataFrame:
    """One best-fit round within each partition; bins are (members, fill)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def packed(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            full, under = [], []
            held.sort(key=lambda b: b["members"][0]["_key"])
            for group in best_fit([b["fill"] for b in held], capacity):
                at, members = 0, []
                for i in group:
                    members += [m | {"offset": m["offset"] + at} for m in held[i]["members"]] if at else held[i]["members"]
                    at += held[i]["fill"]
                done = at >= capacity - min(SLACK, capacity // 256)
                (full if done or final else under).append({"members": members, "fill": at, "full": done})
            held = [{"members": b["members"], "fill": b["fill"]} for b in under]
            for k in range(0, len(full), 20_000):
                yield pa.RecordBatch.from_pylist(full[k : k + 20_000], schema=arrow)

        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= 2 * WINDOW:
                yield from packed(False)
                if len(held) >= WINDOW:
                    yield from packed(True)
        yield from packed(True)

    out = T.StructType([bins.schema["members"], bins.schema["fill"], T.StructField("full", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return bins.mapInArrow(run, out)


def pack(items: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """Append sequence_id and offset: items of a sequence lie gapless from 0 and fill it to capacity at most.

    Items longer than the capacity, or without a length, raise an error. Items are written out first, so
    that no task holds the Python worker that made them beside the one that packs them.
    """
    items = materialize(items, "items")
    carried = [c for c in items.columns if c not in ("sequence_id", "offset")]
    checked = F.when(F.col(length).between(1, capacity), F.col(length)).otherwise(F.raise_error(F.lit("an item doesn't fit a sequence")).cast("bigint")).cast("bigint")
    member = F.struct(*carried, F.xxhash64(*carried).alias("_key"), F.lit(0).cast("bigint").alias("offset"))
    work = items.select(F.array(member).alias("members"), checked.alias("fill"))
    done = []
    parts = max(FAN_IN, items.sparkSession.sparkContext.defaultParallelism)
    merged = False
    while True:
        table = materialize(_round(work, capacity), "packing")
        if not done:
            release(items)
        done.append(table.where("full").select("members"))
        rest = table.where("not full").select("members", "fill")
        count = rest.count()
        least = max(1, ceil(count / MERGE_ITEMS))
        if not count or merged:
            done.append(rest.select("members"))
            break
        parts = max(least, ceil(parts / FAN_IN))
        merged = parts == least
        work = rest.repartition(parts, F.col("members")[0]["_key"])
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    numbered = out.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m"))
    return numbered.select(*[F.col(f"m.{c}").alias(c) for c in carried], "sequence_id", F.col("m.offset").alias("offset"))
