"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME_BYTES; a footer (a skippable frame with
a seek table, in the public seekable format) ends each bundle, and an index maps record ids to their
frame and the place within it. Bundles are rows of a table (bundle, content, index), so that writing
them is a Spark write with its commit and retries; save() also writes them as files.

Null html is an empty payload; a null page id is written as "null" and read back as null, and never
referred to; html of any length is one record, and a frame of its own where it fills one; rows that repeat the
largest page id of a group are all responses; other columns, whatever their names, are not carried; an empty table gives
an empty one. Control characters in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, materialize

FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 22
#: Digests of repeated payloads that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "array<struct<record_id: string, frame: int, offset: int, length: int>>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its HTTP block, or a revisit with the HTTP header alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page(uri: str | None) -> int | None:
    number = uri.strip("<>").rpartition(":")[2] if uri else "null"
    return None if number == "null" else int(number)


def parse(raw: bytes) -> dict:
    """The fields of one record, with its payload's size and digest checked where it holds the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(named["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    whole = named["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {named['WARC-Record-ID']} doesn't hold the payload of its digest")
    return {"page_id": _page(named["WARC-Record-ID"]), "url": named["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": named["WARC-Type"], "refers_to": _page(named.get("WARC-Refers-To")), "payload": payload if whole else None}


class Bundle:
    """Frames of records, then the seek table."""

    def __init__(self, level: int):
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames, self.sizes, self.open, self.index, self.held = [], [], bytearray(), [], 0

    def add(self, key: str, raw: bytes) -> None:
        if self.open and len(self.open) + len(raw) > FRAME_BYTES:
            self.flush()
        self.index.append({"record_id": key, "frame": len(self.frames), "offset": len(self.open), "length": len(raw)})
        self.open += raw

    def flush(self) -> None:
        if self.open:
            frame = self.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.held += len(frame)
            self.open = bytearray()

    def content(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer."""
    number, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    start, out = 0, []
    for k in range(number):
        size, plain = struct.unpack_from("<II", content, len(content) - 9 - (number - k) * step)
        out.append((start, size, plain))
        start += size
    return out


def plan_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Append payload_digest (hex SHA-1) and refers_to: of equal payloads of min_bytes or more, the row with the largest page_id stands for the others."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digested = pages.withColumns({"payload_digest": F.sha1(payload), "_bytes": F.octet_length(payload)})
    again = digested.where(F.col("_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("_latest"), F.count("*").alias("_n")).where("_n > 1").select("payload_digest", "_latest")
    again = broadcast_if_small(materialize(again, "warc-repeats"), BROADCAST_ROWS)
    latest = F.when(~F.col("page_id").eqNullSafe(F.col("_latest")), F.col("_latest"))
    return digested.join(again, "payload_digest", "left").withColumn("refers_to", latest).drop("_latest", "_bytes")


def write(pages: DataFrame, min_bytes: int = 1000, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The table of bundles of pages (page_id, url, html), on shared storage."""
    rows = plan_revisits(pages, min_bytes).select("page_id", "url", "html", "payload_digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, bundle = TaskContext.get().partitionId(), 0, Bundle(level)

        def ended() -> pa.RecordBatch:
            nonlocal number, bundle
            row = {"bundle": f"{part:06d}-{number:06d}.warc.zst", "content": bundle.content(), "index": bundle.index}
            number, bundle = number + 1, Bundle(level)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle.add(record_id(page_id), record(page_id, url or "", (html or "").encode(), digest, refers_to, date))
                if bundle.held >= BUNDLE_BYTES:
                    yield ended()
        if bundle.index:
            yield ended()

    arrow = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("index", pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])))])
    return materialize(rows.mapInArrow(run, f"bundle string, content binary, index {INDEX}"), "warc")


def read(bundles: DataFrame, payload: bool = True, page_ids: list[int] | None = None) -> DataFrame:
    """The records, or those of page_ids: the index then names the frames to decompress, and no others are."""
    wanted = bundles
    if page_ids is not None:
        wanted = bundles.withColumn("index", F.filter("index", lambda x: x["record_id"].isin([record_id(i) for i in page_ids])))
    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for content, index in zip(*(batch.column(c).to_pylist() for c in ("content", "index")), strict=True):
                frames, at, plain, out = seek_table(content), -1, b"", []
                for entry in index:
                    if entry["frame"] != at:
                        at = entry["frame"]
                        start, size, whole = frames[at]
                        plain = expand.decompress(content[start : start + size], max_output_size=whole)
                    found = parse(plain[entry["offset"] : entry["offset"] + entry["length"]])
                    out.append(found if payload else {k: v for k, v in found.items() if k != "payload"})
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return wanted.select("content", "index").mapInArrow(run, ddl)


def save(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as a file of its own below a folder URI that pyarrow opens from every executor; returns names and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in ("bundle", "content")), strict=True):
                with store.open_output_stream(f"{base}/{name}.part") as out:
                    out.write(content)
                store.move(f"{base}/{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("bundle"), pa.array([len(c) for c in batch.column("content").to_pylist()], pa.int64())], names=["bundle", "size"])

    return bundles.select("bundle", "content").mapInArrow(run, "bundle string, size bigint")
