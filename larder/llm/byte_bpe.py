"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Ranks become a vocabulary of mapped characters (one printable character for each byte) and a merge
list with every split of a token into two tokens, in rank order, so that merging always takes the
lowest rank, leftmost first. Each match of the splitting pattern is encoded by itself.

Decoding joins the tokens' characters and reverses the byte table; texts come from the bytes of PART
ids at a time, a character split between parts coming with the later one.

Nulls count as empty texts and give no ids; texts of any length are encoded whole; of equal merges the
leftmost comes first; repeated rows stay and get equal ids; an empty table gives an empty one; a column
whose name clashes with a new one is replaced.
"""

from __future__ import annotations

import base64
import codecs
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larder.llm.common import as_texts, map_batches

CACHE_PIECES = 1 << 18
#: Ids decoded at a time.
PART = 1 << 16
#: Texts whose ids and offsets a worker holds at a time.
ROWS = 128


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from 256 upwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class ByteCodec:
    """Encodes and decodes by a rank file, remembering the ids of frequent pieces."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        chars = byte_characters()
        self.mapped = {b: chars[b] for b in range(256)}
        self.names = [self.name(t) for t in self.bytes_of]
        self.sizes = np.array([len(t) for t in self.bytes_of], np.int64)
        self.byte_of = np.zeros(512, np.uint8)  # by the character's number
        self.byte_of[[ord(c) for c in chars]] = np.arange(256)
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def name(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.mapped)

    @cached_property
    def model(self):
        """Only encoding needs the merges: a worker that decodes never holds them."""
        from tokenizers.models import BPE

        ranks, name = self.ranks, self.name
        merges = [
            (name(token[:i]), name(token[i:]))
            for token, _ in sorted(ranks.items(), key=lambda x: x[1])
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        return BPE({name(t): r for t, r in ranks.items()}, merges, ignore_merges=True)

    def piece(self, piece: str) -> tuple[int, ...]:
        return tuple(t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.mapped)))

    def encode(self, text: str) -> list[int]:
        pieces, known = self.split(text), self.known
        missing = set(pieces).difference(known)
        if missing:
            if len(known) > CACHE_PIECES:
                known.clear()
                missing = set(pieces)
            known.update((p, self.piece(p)) for p in missing)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Characters [start, end) of the text that each token touches; a split character is touched by several."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = self.sizes[np.array(ids, np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        return char_of[starts].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes whose characters the tokens are made of."""
        characters = "".join(map(self.names.__getitem__, ids)).encode("utf-16-le")
        return self.byte_of[np.frombuffer(characters, "<u2")].tobytes()

    def decode_parts(self, parts: list[list[int]]) -> list[str]:
        """Texts of successive parts of one sequence; a character split between parts comes with the later one."""
        return characters([self.decode_bytes(p) for p in parts])


def characters(parts: list[bytes]) -> list[str]:
    """The texts of successive bytes; a character split between parts comes with the later one."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(p, i == len(parts) - 1) for i, p in enumerate(parts)]


_codecs: dict[tuple[str, str], ByteCodec] = {}


def codec(rank_file: str, pattern: str) -> ByteCodec:
    """One codec a worker process."""
    key = (rank_file, pattern)
    if key not in _codecs:
        _codecs[key] = ByteCodec(*key)
    return _codecs[key]


def encoded(own: ByteCodec, texts: list[str], offsets: bool = True) -> list[pa.Array]:
    ids = [own.encode(t) for t in texts]
    out = [pa.array(ids, pa.list_(pa.int32()))]
    if offsets:
        spans = [own.offsets(t, i) if i else (np.zeros(0, np.int32),) * 2 for t, i in zip(texts, ids, strict=True)]
        out += [pa.array([s[k] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
    return out


def decoded(own: ByteCodec, ids: pa.Array) -> list[pa.Array]:
    raws, texts = [], []
    for whole in ids:
        at = whole.values.to_numpy(zero_copy_only=False).tolist() if whole.is_valid else []
        parts = [own.decode_bytes(at[k : k + PART]) for k in range(0, len(at), PART)]
        raws.append(b"".join(parts))
        texts.append("".join(characters(parts)))
    return [pa.array(raws, pa.binary()), pa.array(texts, pa.string())]


IDS, SPANS, DECODED = "ids array<int>", ", starts array<int>, ends array<int>", "decoded binary, decoded_text string"


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", offsets: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Append ids and, with offsets, starts and ends: the characters of the text that each token touches."""

    def make():
        own = codec(rank_file, pattern)
        return lambda batch: encoded(own, as_texts(batch.column(text)), offsets)

    return map_batches(df, make, IDS + SPANS * offsets, keep, ROWS)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append decoded (the bytes of the ids) and decoded_text (U+FFFD for bytes that make no character)."""

    def make():
        own = codec(rank_file, pattern)
        return lambda batch: decoded(own, batch.column(ids))

    return map_batches(df, make, DECODED, keep, ROWS)


def encode_and_decode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What encode() and then decode() append, in one pass: a task holds one Python worker with one codec, not two."""

    def make():
        own = codec(rank_file, pattern)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = encoded(own, as_texts(batch.column(text)))
            return found + decoded(own, found[0])

        return work

    return map_batches(df, make, f"{IDS}{SPANS}, {DECODED}", keep, ROWS)
