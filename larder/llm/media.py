"""Media columns: AVI with motion-JPEG.

store() writes a payload as the flat 8x8 blocks of grey baseline JPEG frames (a block's level is a
byte, so the samples are lossless for any decoder), in an AVI with its index. read() parses the RIFF
index (or, where there is none, the chunks of the movi list), decodes the intra frames, and finds shots
where the difference of successive histograms exceeds an adaptive threshold; clips() gives a timed row
for each.

The Huffman tables that store() writes are chosen so that every block takes ten bits (a difference of s
bits has a code of 9 - s, the end of block one), so its frames are coded by whole arrays. Any other
baseline frame is decoded too, coefficient by coefficient: with tables of its own or, as is usual for
motion-JPEG, the standard ones, subsampled components and restart intervals. The histogram is that of
its brightness. Media that can't be read (no AVI, cut short, progressive or arithmetic frames) get null
payload and clips, and the reason.

Null texts count as empty: one block row. Null media get null payload, clips and reason; media not
written by store() get a null payload. Texts of any length are stored whole. A difference that equals the
threshold is no cut. Repeated rows give equal media; an empty table gives an empty one; clashing columns
are replaced.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import as_bytes, map_batches

#: Blocks across and down a frame, frames a second, bins of a histogram.
WIDE, HIGH, RATE, BINS = 64, 16, 25, 16
#: Shots: the difference must exceed the mean of the last WINDOW ones by DEVIATIONS deviations, and FLOOR.
WINDOW, DEVIATIONS, FLOOR = 8, 3.0, 0.08
PAD = 64
CLIPS = "array<struct<clip: int, start_frame: int, end_frame: int, start_s: double, end_s: double, difference: double>>"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Ten-bit words by difference + 255, and differences by nine-bit word."""
    words, back = np.zeros(511, np.uint64), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        word = ((1 << (9 - s)) - 2) << s | (d if d >= 0 else d + (1 << s) - 1)
        words[d + 255] = word << 1
        back[word] = d
    return words, back


WORDS, DIFFERENCES = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


DC_TABLE = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
AC_TABLE = bytes([1] + [0] * 15) + b"\x00"
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, HIGH * 8, WIDE * 8, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + DC_TABLE)
    + _segment(0xC4, b"\x10" + AC_TABLE)
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of WIDE x HIGH blocks; the last is filled with level 0."""
    size = WIDE * HIGH
    count = -(-len(payload) // size)
    levels = np.zeros(count * size, np.int16)
    levels[: len(payload)] = np.frombuffer(payload, np.uint8)
    levels = levels.reshape(count, size) - 128
    steps = np.diff(levels, axis=1, prepend=np.int16(0))
    four = WORDS[steps + 255].reshape(count, -1, 4)
    bits = four[..., 0] << np.uint64(30) | four[..., 1] << np.uint64(20) | four[..., 2] << np.uint64(10) | four[..., 3]
    raw = bits.astype(">u8").view(np.uint8).reshape(count, -1, 8)[..., 3:]
    return [HEADER + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in raw]


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Levels of the blocks of each frame that store() wrote (frames x blocks)."""
    scans = [frame[len(HEADER) : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff") for frame in frames]
    raw = np.frombuffer(b"".join(scans), np.uint8).reshape(len(frames), -1, 5).astype(np.uint16)
    a, b, c, d, e = (raw[..., k] for k in range(5))
    words = np.stack([a << 1 | b >> 7, (b & 0x3F) << 3 | c >> 5, (c & 0x0F) << 5 | d >> 3, (d & 3) << 7 | e >> 1], axis=-1)
    levels = np.cumsum(DIFFERENCES[words.reshape(len(frames), -1)], axis=1, dtype=np.int32) + 128
    return levels.astype(np.uint8)


#: Fixed values of the JPEG standard: the order of coefficients is a rule (zigzag); its usual Huffman
#: tables, by class and destination, are the counts of codes of 1 to 16 bits, then the symbols.
STANDARD = {
    0x00: bytes.fromhex("00010501010101010100000000000000" + "000102030405060708090a0b"),
    0x01: bytes.fromhex("00030101010101010101010000000000" + "000102030405060708090a0b"),
    0x10: bytes.fromhex(
        "0002010303020403050504040000017d"
        "0102030004110512213141061351610722711432 8191a1082342b1c11552d1f0 24336272 82090a161718191a 25262728292a"
        "3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a"
        "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
    0x11: bytes.fromhex(
        "00020102040403040705040400010277"
        "0001020311040521310612415107617113223281 08144291a1b1c109233352f0 156272d1 0a162434e125f1 1718191a 262728292a"
        "35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a"
        "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
}
#: Coefficients in the order of the scan: diagonals, up and down by turns.
ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


def _lookup(table: bytes) -> dict[tuple[int, int], int]:
    """Symbols by the length and the value of their codes."""
    found, code, at = {}, 0, 16
    for length in range(1, 17):
        for symbol in table[at : at + table[length - 1]]:
            found[length, code] = symbol
            code += 1
        at += table[length - 1]
        code <<= 1
    return found


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held, self.left = raw, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            if self.at == len(self.raw):
                raise ValueError("a frame ends within a block")
            self.held = (self.held << 8 | self.raw[self.at]) & 0xFFFFFFFF
            self.at, self.left = self.at + 1, self.left + 8
        self.left -= n
        return self.held >> self.left & (1 << n) - 1

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a frame holds an unknown code")

    def number(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _block(bits: _Bits, dc: dict, ac: dict, before: int) -> list[int]:
    """Coefficients of a block in the order of the scan."""
    out = [0] * 64
    out[0] = before + bits.number(bits.symbol(dc))
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size and run < 15:
            break
        k += run
        if size and k > 63:
            raise ValueError("a block holds too many coefficients")
        if size:
            out[k] = bits.number(size)
        k += 1
    return out


def decode_frame(frame: bytes) -> np.ndarray:
    """The brightness (height x width) of a baseline JPEG frame."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, tables, scales, parts, order, interval = 2, dict(STANDARD), {}, {}, [], 0
    while not order:
        mark, marker, length = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if mark != 0xFF:
            raise ValueError("a frame's segments don't follow one another")
        if marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("a frame's samples aren't bytes")
            high, wide = struct.unpack_from(">HH", body, 1)
            parts = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("a frame isn't baseline")
        elif marker == 0xC4:
            while body:
                size = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:size], body[size:]
        elif marker == 0xDB:
            while body:
                deep = body[0] >> 4
                scales[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * deep], ">u2" if deep else np.uint8).astype(np.int64)
                body = body[65 + 64 * deep :]
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            order = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
    first = next(iter(parts))
    if len(order) != len(parts):
        raise ValueError("a frame's components come in several scans")
    lookups = {key: _lookup(t) for key, t in tables.items()}
    across, down = (max(p[k] for p in parts.values()) for k in (0, 1))
    if len(parts) == 1:  # a scan of one component isn't interleaved
        parts, across, down = {first: (1, 1, parts[first][2])}, 1, 1
    columns, rows = -(-wide // (8 * across)), -(-high // (8 * down))
    ends = [m.start() for m in re.finditer(rb"\xff[\xd0-\xd7]", frame[at:])] if interval else []
    stop = frame.rindex(b"\xff\xd9") if b"\xff\xd9" in frame[at:] else len(frame)
    cuts = [at, *(at + e + 2 for e in ends if at + e < stop), stop + 2 * bool(ends)]
    own = np.zeros((rows * parts[first][1], columns * parts[first][0], 64), np.int64)
    unit, total = 0, rows * columns
    for a, b in zip(cuts, cuts[1:], strict=False):
        scan = frame[a : b - 2 * bool(ends)].replace(b"\xff\x00", b"\xff")
        bits, before = _Bits(scan), dict.fromkeys(parts, 0)
        for _ in range(interval or total):
            if unit == total:
                break
            for name, dc, ac in order:
                h, v, _scale = parts[name]
                for y in range(v):
                    for x in range(h):
                        block = _block(bits, lookups[dc], lookups[16 + ac], before[name])
                        before[name] = block[0]
                        if name == first:
                            own[unit // columns * v + y, unit % columns * h + x] = block
            unit += 1
    if unit < total:
        raise ValueError("a frame ends before its last block")
    plain = np.zeros_like(own)
    plain[..., ZIGZAG] = own * scales[parts[first][2]]
    wave = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, 0.5**0.5, 1.0) / 2
    pixels = wave @ plain.reshape(*own.shape[:2], 8, 8) @ wave.T + 128
    image = np.rint(pixels).clip(0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(own.shape[0] * 8, own.shape[1] * 8)
    return image[: -(-high * parts[first][1] // down), : -(-wide * parts[first][0] // across)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def mux(frames: list[bytes], payload_bytes: int) -> bytes:
    """An AVI with one MJPG stream, its idx1, and the payload's size as a comment."""
    w, h, n, most = WIDE * 8, HIGH * 8, len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, most, w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 8, b"MJPG", w * h, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload=%d\x00" % payload_bytes)
    at, entries, body = 4, [], [b"movi"]
    for frame in frames:
        entries.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        body.append(_chunk(b"00dc", frame))
        at += len(body[-1])
    riff = b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", info) + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(entries))
    return b"RIFF" + struct.pack("<I", len(riff)) + riff


def demux(media: bytes) -> tuple[list[bytes], int | None, float]:
    """Frames by the idx1 entries, or else by the chunks of movi; the payload's size if told, and frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    at, end, movi, size, rate, entries, stop = 12, min(len(media), 8 + struct.unpack_from("<I", media, 4)[0]), None, None, float(RATE), None, 0
    while at + 8 <= end:
        name, length = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST":
            kind = media[at + 8 : at + 12]
            if kind == b"movi":
                movi, stop = at + 8, min(end, at + 8 + length)
            elif kind == b"hdrl" and (gap := struct.unpack_from("<I", media, at + 20)[0]):
                rate = 1_000_000 / gap
            elif kind == b"INFO" and (k := media.find(b"payload=", at, at + 8 + length)) >= 0:
                size = int(media[k + 8 : media.index(b"\x00", k)])
        elif name == b"idx1":
            entries = [struct.unpack_from("<4sIII", media, at + 8 + 16 * k) for k in range(length // 16)]
        at += 8 + length + (length & 1)
    if movi is None:
        raise ValueError("no movi list")
    if entries is None:
        entries, at = [], movi + 4
        while at + 8 <= stop:
            name, length = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
            inside = name == b"LIST"  # a group of chunks, rec
            if not inside:
                entries.append((name, 0, at - movi, length))
            at += 12 if inside else 8 + length + (length & 1)
    # entries count from the list's name, or in some files from the start
    base = 0 if entries and media[movi + entries[0][2] : movi + entries[0][2] + 4] != entries[0][0] else movi
    found = [(base + o + 8, n) for kind, _, o, n in entries if kind[2:] in (b"dc", b"db") and n]
    if not found or any(at + n > len(media) for at, n in found):
        raise ValueError("frames are missing")
    return [media[at : at + n] for at, n in found], size, rate


def histograms(frames: list[bytes], own: np.ndarray | None) -> np.ndarray:
    """Shares of the brightness of each frame by BINS equal ranges; own: the levels of frames that store() wrote."""
    levels = own if own is not None else [decode_frame(f).ravel() for f in frames]
    if own is None:
        return np.stack([np.bincount(x // (256 // BINS), minlength=BINS) / len(x) for x in levels])
    n = len(levels)
    return np.bincount((levels // (256 // BINS) + np.arange(n, dtype=np.int64)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS) / levels.shape[1]


def shots(bins: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and each frame's histogram difference to the one before.

    The threshold adapts to the differences within the shot so far: a cut doesn't hide the next one.
    """
    apart = np.concatenate([[0.0], np.abs(np.diff(bins, axis=0)).sum(axis=1) / 2])
    starts = [0]
    for k in range(1, len(bins)):
        before = apart[max(starts[-1] + 1, k - WINDOW) : k]
        limit = before.mean() + DEVIATIONS * before.std() if len(before) else 0.0
        if apart[k] > max(limit, FLOOR):
            starts.append(k)
    return starts, apart


def examine(media: bytes) -> tuple[bytes | None, list[dict]]:
    """The payload, if store() wrote the media, and the clips; raises on media that can't be read."""
    frames, size, rate = demux(media)
    own = decode_frames(frames) if all(f.startswith(HEADER) for f in frames) else None
    starts, apart = shots(histograms(frames, own))
    ends = [*starts[1:], len(frames)]
    found = [{"clip": i, "start_frame": a, "end_frame": b, "start_s": a / rate, "end_s": b / rate, "difference": float(apart[a])} for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    return (own.tobytes()[:size] if own is not None and size is not None else None), found


def store(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes (of the UTF-8 text) and media: the text, with bytes 0 up to a positive multiple of 64, as an AVI."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            raw = as_bytes(batch.column(text))
            padded = [r + bytes(max(PAD, -(-len(r) // PAD) * PAD) - len(r)) for r in raw]
            return [pa.array([len(r) for r in raw], pa.int64()), pa.array([mux(encode_frames(p), len(p)) for p in padded], pa.binary())]

        return work

    return map_batches(df, make, "n_bytes bigint, media binary", keep)


def read(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Append payload (the levels of all blocks in order, as far as the payload's size), clips, and reason (why the media can't be read)."""

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for value in batch.column(media).to_pylist():
                try:
                    out.append((None, None, None) if value is None else (*examine(value), None))
                except (ValueError, LookupError, struct.error, StopIteration) as broken:
                    out.append((None, None, str(broken) or "damaged"))
            kind = pa.list_(pa.struct([("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("difference", pa.float64())]))
            payloads, found, reasons = zip(*out, strict=True) if out else ((), (), ())
            return [pa.array(payloads, pa.binary()), pa.array(found, kind), pa.array(reasons, pa.string())]

        return work

    return map_batches(df, make, f"payload binary, clips {CLIPS}, reason string", keep)


def clips(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each clip of read()'s result."""
    return df.select(*keep, F.inline("clips"))
