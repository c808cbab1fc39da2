"""Alignment of two tokenizers' tokens over the same bytes: a byte-level one (A) and a piece model (B).

Segment deduplication: texts (a space before each) are cut before runs of white space where neither
vocabulary can merge across: A's splitting breaks there and no piece of B holds such a pair of characters,
which is tried for each white character when the vocabularies are loaded (a model with a piece that ends in a
carriage return, say, isn't cut before one). Documents are gathered into blocks
of about BLOCK characters, and become lists of numbers into the block's distinct segments. The blocks'
segments are shuffled by their text, so that equal ones meet: each is tokenised and aligned once in each
SPAN of blocks (a bound on how many places one row must name), and its alignment goes back to all places,
packed by block, where documents are composed.

Byte offsets where tokens of both end cut a text into groups; there the last tokens of both are linked. A
pair's count is how often it is linked in all documents; it is best where no pair of the same B token is
linked more often. The table of pairs is broadcast up to PAIRS rows; beyond that, segments are joined with it.

Null and empty texts have no tokens, and neither have texts whose bytes a tokenizer changes (B takes U+2581
for a space): their numbers are zero, their groups empty, and they count nowhere. Strings of special tokens
are ordinary text; texts without white space are one segment, whatever their length; repeated rows count as
often as they occur; ties for the best count are all best; an empty table gives an empty one; a column whose
name clashes with a new one is replaced.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import piece_bpe
from larder.llm.common import as_texts, fields, join_counted, materialize, release

#: Characters of a block's texts; blocks of a span, by partitions and within each.
BLOCK, SPAN = 1 << 24, 64
#: Segments aligned at a time; rows of pairs that may be broadcast (24 bytes each).
SEGMENTS, PAIRS = 20_000, 1 << 20
#: The characters that Unicode calls white space.
WHITE = [chr(c) for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def cutter(safe: list[str]) -> Callable[[str], list[str]]:
    """Cuts a text before each run of white space that begins with one of the safe characters."""
    white, unsafe = "".join(WHITE), "".join(w for w in WHITE if w not in safe)
    word = f"[^{white}]+" if not unsafe else f"(?:[^{white}]+(?:[{unsafe}][{white}]*)?)+"
    return regex.compile(f"[{white}]*{word}|[{white}]+").findall



class Pair:
    """The two tokenizers, and what their tokens' bytes are."""

    def __init__(self, byte_file: str, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own_a, self.own_b = Tokenizer.from_file(byte_file), piece_bpe.codec(model_file)
        self.own_a.encode_special_tokens = True
        with open(byte_file, encoding="utf-8") as file:
            config = json.load(file)
        if config.get("normalizer") or config["pre_tokenizer"]["type"] != "ByteLevel" or config["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the byte-level tokenizer changes or joins texts")
        self.safe = [w for w in WHITE if self.breaks_before(w)]
        self.cut = cutter(self.safe)
        entries = sorted(self.own_a.get_vocab(with_added_tokens=False).items(), key=lambda e: e[1])
        # an entry has a character for each byte
        self.sizes_a = np.zeros(1 + max(i for _, i in entries), np.int64)
        self.sizes_a[[i for _, i in entries]] = [len(t) for t, _ in entries]
        self.sizes_b = np.array([len(t.encode()) for t in self.own_b.texts], np.int64)
        self.sizes_b[self.own_b.byte_ids] = 1
        self.number = [str(i) for i in range(max(len(self.sizes_a), len(self.sizes_b)))]

    def breaks_before(self, white: str) -> bool:
        """Whether tokens of neither vocabulary reach across the beginning of a run of white space with this character."""
        split = self.own_a.pre_tokenizer.pre_tokenize_str
        probes = [(before + white + after) for before in ("a", "1", "!", "é", "日", "\x1c") for after in ("b", "2", "?", " b", "\n", "")]
        breaks = all(any(start == 1 for _, (start, _) in split(p)) for p in probes)
        return breaks and not any(white in p[1:] and any(b == white and a not in WHITE for a, b in zip(p, p[1:], strict=False)) for p in self.own_b.id_of)

    def align(self, segments: list[str]) -> tuple[list[str], pa.Array]:
        """Of each segment: its groups in ids; its links (A id, B id) as one number each."""
        ids_a = [e.ids for e in self.own_a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = [self.own_b.encode_spaced(s) for s in segments]
        n_a, n_b = np.fromiter(map(len, ids_a), np.int64), np.fromiter(map(len, ids_b), np.int64) // 4
        flat_a, flat_b = np.fromiter((i for ids in ids_a for i in ids), np.int64), np.frombuffer(b"".join(ids_b), np.int32)
        size = np.fromiter((len(s.encode()) for s in segments), np.int64)
        ends_a, ends_b, whole = np.cumsum(self.sizes_a[flat_a]), np.cumsum(self.sizes_b[flat_b]), np.cumsum(size)
        if not (np.array_equal(ends_a[np.cumsum(n_a) - 1], whole) and np.array_equal(ends_b[np.cumsum(n_b) - 1], whole)):
            raise ValueError("a tokenizer changed the bytes of a segment")
        both, at_a, at_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        groups_before = np.searchsorted(both, whole, side="right")
        named_a, named_b = list(map(self.number.__getitem__, flat_a.tolist())), list(map(self.number.__getitem__, flat_b.tolist()))
        stop_a, stop_b, texts, one, other = (at_a + 1).tolist(), (at_b + 1).tolist(), [], 0, 0
        for a, b in zip(stop_a, stop_b, strict=True):
            texts.append(f"{named_a[one]}|{named_b[other]}" if a - one == b - other == 1 else f"{','.join(named_a[one:a])}|{','.join(named_b[other:b])}")
            one, other = a, b
        first = 0
        joined = []
        for last in groups_before.tolist():
            joined.append(";".join(texts[first:last]))
            first = last
        links = pa.ListArray.from_arrays(pa.array(np.append(0, groups_before).astype(np.int32)), pa.array((flat_a[at_a] << 32) | flat_b[at_b]))
        return joined, links


_pairs: dict[tuple[str, str], Pair] = {}


def pair(byte_file: str, model_file: str) -> Pair:
    """One pair of tokenizers a worker process."""
    if (byte_file, model_file) not in _pairs:
        _pairs[byte_file, model_file] = Pair(byte_file, model_file)
    return _pairs[byte_file, model_file]


def names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(", ")]


def int_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers as 16 bits each; those from 65,535 on as that and two halves. Frequent segments come early, so most are short."""
    long = numbers >= 0xFFFF
    if not long.any():
        return numbers.astype("<u2").tobytes()
    out = np.repeat(np.where(long, 0xFFFF, numbers), np.where(long, 3, 1)).astype("<u2")
    at = np.cumsum(np.where(long, 3, 1))[long]
    out[at - 2], out[at - 1] = numbers[long] & 0xFFFF, numbers[long] >> 16
    return out.tobytes()


def unpacked_numbers(packed: bytes) -> np.ndarray:
    halves = np.frombuffer(packed, "<u2").astype(np.int64)
    if not (halves == 0xFFFF).any():
        return halves
    # a mark may also be a half of a long number, so marks are found from the left
    starts, at = [], 0
    marks = np.flatnonzero(halves == 0xFFFF)
    for mark in marks.tolist():
        if mark >= at:
            starts.append(mark)
            at = mark + 3
    starts = np.array(starts)
    keep = np.ones(len(halves), bool)
    keep[starts + 1] = keep[starts + 2] = False
    halves[starts] = halves[starts + 1] | (halves[starts + 2] << 16)
    return halves[keep]


def blocks(docs: DataFrame, byte_file: str, model_file: str, text: str, keep: list[str]) -> DataFrame:
    """Two kinds of rows: document (block, keep, numbers), and segment (block, number, segment, n) for each distinct one of a block.

    numbers (see packed_numbers) is null for documents without tokens.
    """
    schema = T.StructType(fields("kind string, block bigint") + [T.StructField(c, docs.schema[c].dataType) for c in keep] + fields("numbers binary, number int, segment string, n bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, cut = to_arrow_schema(schema), pair(byte_file, model_file).cut
        block, place, size, known, counts = TaskContext.get().partitionId() << 32, {}, 0, [], []

        def rows(count: int, columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(count, f.type) for f in arrow], schema=arrow)

        def ended() -> Iterator[pa.RecordBatch]:
            n = np.bincount(np.concatenate(counts), minlength=len(known)) if counts else np.zeros(0, np.int64)
            for at in range(0, len(known), SEGMENTS):
                some = known[at : at + SEGMENTS]
                number = np.arange(at, at + len(some), dtype=np.int32)
                yield rows(len(some), {"kind": pa.array(["segment"] * len(some)), "block": pa.array(np.full(len(some), block)), "number": pa.array(number), "segment": pa.array(some, pa.string()), "n": pa.array(n[number])})

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                packed = []
                for value in as_texts(batch.column(text)):
                    packed.append(None)
                    if value and piece_bpe.SPACE not in value:
                        cuts = cut(" " + value)
                        for new in set(cuts).difference(place):
                            place[new] = len(known)
                            known.append(new)
                        numbers = np.array(list(map(place.__getitem__, cuts)), np.int64)
                        counts.append(numbers.astype(np.int32))
                        packed[-1] = packed_numbers(numbers)
                        size += len(value)
                yield rows(batch.num_rows, {"kind": pa.array(["document"] * batch.num_rows), "block": pa.array(np.full(batch.num_rows, block)), "numbers": pa.array(packed, pa.binary())} | {c: batch.column(c) for c in keep})
                if size >= BLOCK:
                    yield from ended()
                    block, place, size, known, counts = block + 1, {}, 0, [], []
        yield from ended()

    return docs.select(*keep, text).mapInArrow(run, schema)


ALIGNED = "links array<bigint>, groups string, n bigint, at_block array<bigint>, at_number array<int>"


def segments(dealt: DataFrame, byte_file: str, model_file: str) -> DataFrame:
    """A row for each distinct segment of a span: its alignment, n (its occurrences) and the blocks and numbers where it goes."""
    # a span's partitions and blocks of each; partition numbers are a block's upper half
    span = F.shiftright(F.col("block"), 32) / SPAN, F.col("block").bitwiseAND((1 << 32) - 1) / SPAN
    listed = dealt.where("kind = 'segment'").select("segment", "block", "number", "n", *[c.cast("int").alias(f"span{k}") for k, c in enumerate(span)])
    met = listed.repartition(F.xxhash64("segment"), "span0", "span1").sortWithinPartitions("segment", "span0", "span1", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = pair(byte_file, model_file), []

        def aligned(rows: pa.RecordBatch, first: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.append(first[1:], rows.num_rows)
            for k in range(0, len(first), SEGMENTS):
                start, stop = first[k : k + SEGMENTS], ends[k : k + SEGMENTS]
                part = rows.slice(start[0], stop[-1] - start[0])
                offsets = np.append(start, stop[-1]) - start[0]
                groups, links = own.align(part.column("segment").take(pa.array(offsets[:-1])).to_pylist())
                n = np.add.reduceat(part.column("n").to_numpy(), offsets[:-1])
                places = [int_list(part.column(c).to_numpy(), offsets) for c in ("block", "number")]
                yield pa.RecordBatch.from_arrays([links, pa.array(groups, pa.string()), pa.array(n), *places], names=names(ALIGNED))

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows = joined()
                new = np.zeros(rows.num_rows, bool)
                new[0] = True
                for c in ("segment", "span0", "span1"):
                    own_column = rows.column(c)
                    new[1:] |= pc.not_equal(own_column.slice(1), own_column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(new)
                # the last segment may go on in the next batch
                yield from aligned(rows.slice(0, first[-1]), first[:-1]) if len(first) > 1 else ()
                held = [rows.slice(first[-1])]
        if held:
            yield from aligned(joined(), np.zeros(1, np.int64))

    return met.mapInArrow(run, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """(link, count, best, n) for each linked pair of ids: count of all occurrences, and n, the segments that hold it."""
    linked = found.select(F.explode("links").alias("link"), F.col("n").alias("times")).groupBy("link").agg(F.sum("times").alias("count"), F.count("*").alias("n"))
    # a B id has no more pairs than A has ids
    highest = linked.groupBy(F.col("link").bitwiseAND((1 << 32) - 1).alias("b")).agg(F.max("count").alias("highest"))
    named = linked.withColumn("b", F.col("link").bitwiseAND((1 << 32) - 1)).join(highest, "b")
    return named.select("link", "count", (F.col("count") == F.col("highest")).alias("best"), "n")


PLACES = "block bigint, number array<int>, n_best array<int>, count_sum array<bigint>, groups array<string>"


def _packed(batch: pa.RecordBatch, n_best: np.ndarray, count_sum: np.ndarray) -> pa.RecordBatch:
    """Rows for each block of the batch's segments, with what they bring there."""
    times = pc.list_value_length(batch.column("at_block")).to_numpy(zero_copy_only=False)
    block, number = batch.column("at_block").flatten().to_numpy(), batch.column("at_number").flatten().to_numpy()
    order = np.argsort(block, kind="stable")
    block, row = block[order], np.repeat(np.arange(batch.num_rows), times)[order]
    new = np.flatnonzero(np.diff(block, prepend=-1) != 0)
    offsets = np.append(new, len(block))
    ints = [number[order], n_best[row].astype(np.int32), count_sum[row].astype(np.int64)]
    groups = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), batch.column("groups").take(pa.array(row)))
    return pa.RecordBatch.from_arrays([pa.array(block[new]), *(int_list(x, offsets) for x in ints), groups], names=names(PLACES))


def places(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """What each segment brings to its places, packed by block: its best links, its links' counts, its groups."""
    if pairs.count() <= PAIRS:
        table = pairs.select("link", "count", "best").toArrow().sort_by("link")
        known = found.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("link", "count", "best")])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            link, count, best = known.value
            for batch in batches:
                if batch.num_rows:
                    at = np.searchsorted(link, batch.column("links").flatten().to_numpy())
                    last = np.cumsum(pc.list_value_length(batch.column("links")).to_numpy(zero_copy_only=False))
                    # every segment has links
                    yield _packed(batch, *(np.add.reduceat(x[at].astype(np.int64), np.append(0, last[:-1])) for x in (best, count)))

        return found.mapInArrow(run, PLACES)
    found = materialize(found.withColumn("_id", F.monotonically_increasing_id()), "numbered-segments")
    linked = found.select("_id", F.explode("links").alias("link"))
    summed = join_counted(linked, pairs, "link", linked.count()).groupBy("_id").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _packed(batch, batch.column("n_best").to_numpy(), batch.column("count_sum").to_numpy())

    return found.join(summed, "_id").mapInArrow(packed, PLACES)


COMPOSED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def composed(dealt: DataFrame, brought: DataFrame, keep: list[str]) -> DataFrame:
    """The documents of each block, from their segments' alignments: of a block these come first, so that its documents can be streamed."""
    documents = dealt.where("kind = 'document'").select("block", *keep, "numbers")
    schema = T.StructType([documents.schema[c] for c in keep] + fields(COMPOSED))
    lists = [c for c in names(PLACES) if c != "block"]
    none = lambda df, columns: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns]
    first = brought.select("block", F.lit(0).alias("turn"), *lists, *none(documents, [*keep, "numbers"]))
    then = documents.select("block", F.lit(1).alias("turn"), *none(brought, lists), *keep, "numbers")
    rows = first.unionByName(then).repartition("block").sortWithinPartitions("block", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, tables = None, [], None
        for whole in batches:
            turn, of = whole.column("turn").to_numpy(), whole.column("block").to_numpy()
            cuts = np.flatnonzero((np.diff(turn) != 0) | (np.diff(of) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                if stop == start:
                    continue
                if of[start] != block:
                    block, held, tables = of[start], [], None
                part = whole.slice(start, stop - start)
                if turn[start] == 0:
                    held.append([part.column(c).flatten() for c in lists])
                    continue
                if tables is None:
                    tables, held = Segments(held), []
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    own = tables.compose(some.column("numbers"))
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), *own], names=schema.names)

    return rows.mapInArrow(run, schema)


class Segments:
    """A block's segments by number, and documents composed of them."""

    def __init__(self, held: list[list[pa.Array]]):
        columns = [pa.concat_arrays([h[k] for h in held]) if held else pa.array([], pa.int64()) for k in range(4)]
        order = np.argsort(columns[0].to_numpy())
        self.groups = columns[3].take(pa.array(order)).to_pylist()
        # of each segment: tokens of A and B, groups, best links, counts
        n_groups = np.fromiter((g.count(";") + 1 for g in self.groups), np.int64, len(self.groups))
        commas = np.fromiter((sum(x.index("|") and x[: x.index("|")].count(",") for x in g.split(";")) for g in self.groups), np.int64, len(self.groups))
        every = np.fromiter((g.count(",") for g in self.groups), np.int64, len(self.groups))
        self.sums = [n_groups + commas, n_groups + every - commas, n_groups, n_groups, columns[1].to_numpy()[order].astype(np.int64), columns[2].to_numpy()[order].astype(np.int64)]

    def compose(self, packed: pa.Array) -> list[pa.Array]:
        numbers = [unpacked_numbers(p) if p else np.zeros(0, np.int64) for p in packed.to_pylist()]
        sums = [pa.array([int(s[n].sum()) for n in numbers], pa.int64()) for s in self.sums]
        return [*sums, pa.array([";".join(map(self.groups.__getitem__, n.tolist())) for n in numbers], pa.string())]


def align(docs: DataFrame, byte_file: str, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_a, n_b, n_groups, n_links, n_best, count_sum and groups (a1,a2|b1;a3|b2,b3: ids of A and B in order)."""
    kept = {c: f"kept_{k}" for k, c in enumerate(docs.columns if keep is None else keep) if c not in names(COMPOSED)}
    renamed = docs.select(F.col(text).alias("aligned_text"), *[F.col(c).alias(own) for c, own in kept.items()])
    both = blocks(renamed, byte_file, model_file, "aligned_text", list(kept.values()))
    dealt = materialize(both, "blocks", "kind")
    found = materialize(segments(dealt, byte_file, model_file), "segments")
    release(dealt, "kind=segment")
    pairs = materialize(pair_counts(found), "pairs")
    out = composed(dealt, places(found, pairs), list(kept.values()))
    return out.select(*[F.col(own).alias(c) for c, own in kept.items()], *names(COMPOSED))
