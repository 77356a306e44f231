"""Ogg media columns: lossless packing of byte payloads into multiplexed Ogg streams, and a checking reader.

The container follows the public Ogg bitstream format (RFC 3533): pages with a capture pattern, granule position,
serial number, page sequence number, checksum (CRC-32, polynomial 0x04C11DB7, most significant bit first, start 0)
and a table of lacing values from which packets are put together again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.shared import pieces

MAGIC = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
#: Samples are unsigned bytes at this rate; granule positions count samples.
SAMPLE_RATE = 8000
HEAD = b"pcm-u8\x00"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg stream."""


def checksum(data: bytes) -> int:
    """Ogg's CRC by way of zlib's: reversing the bits of every byte, and of the result, turns one into the other."""
    mirrored = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", MAGIC, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with its granule position (-1: no packet ends there).

    packets: bytes and granule position at their end. The first packet has the first page to itself.
    """
    pages: list[tuple[int, int, bytes, bytes]] = []  # flags, granule, lacing, body
    lacing, body, granule = bytearray(), bytearray(), -1

    def close(flags_next: int) -> int:
        nonlocal lacing, body, granule
        pages.append((close.flags, granule, bytes(lacing), bytes(body)))
        lacing, body, granule = bytearray(), bytearray(), -1
        return flags_next

    close.flags = FIRST
    for k, (data, end) in enumerate(packets):
        values = b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        for i, value in enumerate(values):
            if len(lacing) == 255:
                close.flags = close(0 if i == 0 else CONTINUED)
            lacing.append(value)
            body += data[at : at + value]
            at += value
        granule = end
        if k == 0:
            close.flags = close(0)
    if lacing:
        close.flags = close(0)
    last = len(pages) - 1
    return [(g, _page(f | (LAST if i == last else 0), g, serial, i, lace, data)) for i, (f, g, lace, data) in enumerate(pages)]


def mux(payload: bytes, streams: int = 2, packet_bytes: int = 4096) -> bytes:
    """The payload as one Ogg file: packets of so many samples dealt in turn to the logical streams.

    Serial numbers count from 1, so equal payloads give equal files. Every stream begins with a header packet that
    says how many streams there are, which of them it is, and how many bytes a packet holds.
    """
    cut = [payload[i : i + packet_bytes] for i in range(0, len(payload), packet_bytes)]
    parts: list[list[tuple[bytes, int]]] = [[(HEAD + struct.pack("<HHIQ", streams, s, packet_bytes, len(payload)), 0)] for s in range(streams)]
    end = 0
    for i, data in enumerate(cut):
        end += len(data)
        parts[i % streams].append((data, end))
    paged = [_stream(s + 1, part) for s, part in enumerate(parts)]
    rest = sorted((g if g >= 0 else 1 << 62, i, s, page) for s, pages in enumerate(paged) for i, (g, page) in enumerate(pages[1:], 1))
    order: dict[int, int] = {}
    out = [pages[0][1] for pages in paged]
    # pages without an ending packet keep their place in their own stream
    queue = {s: [page for _, page in pages[1:]] for s, pages in enumerate(paged)}
    for _, _, s, _ in rest:
        i = order.get(s, 0)
        out.append(queue[s][i])
        order[s] = i + 1
    return b"".join(out)


@dataclass
class Logical:
    """One logical stream, as it has been read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule position where a packet ends, -1: not known
    pages: int = 0
    granule: int = 0
    partial: bytearray | None = None
    closed: bool = False


def demux(data: bytes) -> dict[int, Logical]:
    """The logical streams of an Ogg file; raises OggError for damage, gaps and missing ends."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if data[at : at + 4] != MAGIC or at + 27 > len(data):
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        begin, size = at + 27 + n, sum(lacing)
        if version or len(lacing) < n or begin + size > len(data):
            raise OggError(f"broken page at byte {at}")
        if checksum(data[at : at + 22] + bytes(4) + data[at + 26 : begin + size]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial} begins twice or not at all")
        stream = streams.setdefault(serial, Logical(serial))
        if stream.closed or sequence != stream.pages or bool(flags & CONTINUED) != (stream.partial is not None):
            raise OggError(f"gap in stream {serial} before page {sequence}")
        stream.pages += 1
        held, done = stream.partial or bytearray(), 0
        open_packet = stream.partial is not None
        pos = begin
        for value in lacing:
            held += data[pos : pos + value]
            pos += value
            open_packet = value == 255
            if not open_packet:
                stream.packets.append(bytes(held))
                stream.ends.append(-1)
                held, done = bytearray(), done + 1
        stream.partial = held if open_packet else None
        if done:
            stream.ends[-1] = stream.granule = granule
        stream.closed = bool(flags & LAST)
        at = begin + size
    if not streams or not all(s.closed and s.partial is None for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def read(data: bytes) -> tuple[bytes, dict[str, float]]:
    """The payload of mux() and features of the streams; raises OggError if anything is amiss.

    Timestamps come from granule positions: the last one over the sample rate is the duration.
    """
    streams = demux(data)
    parts, total = {}, None
    for stream in streams.values():
        head = stream.packets[0]
        if not head.startswith(HEAD):
            raise OggError(f"stream {stream.serial} has no header packet")
        n, own, packet_bytes, size = struct.unpack_from("<HHIQ", head, len(HEAD))
        if n != len(streams) or total not in (None, size) or own in parts:
            raise OggError("headers disagree")
        total, parts[own] = size, stream.packets[1:]
    longest = max(len(p) for p in parts.values())
    payload = b"".join(parts[s][i] for i in range(longest) for s in range(len(parts)) if i < len(parts[s]))
    last = max(s.granule for s in streams.values())
    if len(payload) != total or last != total:
        raise OggError("samples are missing")
    samples = np.frombuffer(payload, np.uint8)
    level = np.bincount(samples, minlength=256)
    share = level[level > 0] / max(1, len(samples))
    return payload, {
        "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": sum(len(s.packets) for s in streams.values()),
        "duration": last / SAMPLE_RATE, "mean": float(level @ np.arange(256) / max(1, len(samples))), "peak": int(samples.max(initial=0)),
        "entropy": float(-(share * np.log2(share)).sum()) + 0.0,
    }


def payload_of(text: str | None, unit: int = 64) -> bytes:
    """A text's UTF-8 bytes (null: none) with zeros up to a positive multiple of the unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def encode_media(df: DataFrame, text: str = "text", unit: int = 64, streams: int = 2, packet_bytes: int = 4096) -> DataFrame:
    """Every row with its text stored as Ogg: adds n_bytes (unpadded) and media (binary), replacing columns so named.

    A null text counts as empty; a payload is never empty, as it is padded to a positive multiple of the unit. Equal
    texts give equal media. Rows are handled one by one, whatever their ids, so ties, repeats and extra columns stay.
    """
    kept = df.drop("n_bytes", "media")
    schema = kept.select("*", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").cast("binary").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            media = [mux(payload_of(t, unit), streams, packet_bytes) for t in texts]
            sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*batch.schema.names, "n_bytes", "media"])

    return kept.mapInArrow(run, schema)


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",), tail: int = 64) -> DataFrame:
    """What is in the stored Ogg bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Pages' checksums are verified, packets put together again, streams taken apart and timestamps derived. keep names
    the columns to carry along. A null medium gives nulls; a damaged one fails the job, as its payload is lost.
    """
    import hashlib

    given = df.select(*keep, F.col(media).alias("__media"))
    schema = given.drop("__media").select(
        "*", *(F.lit(None).cast(kind).alias(name) for name, kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")))
    ).schema
    names = [f.name for f in schema.fields]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(stored: bytes | None) -> tuple:
        if stored is None:
            return (None,) * 6
        payload, found = read(stored)
        feature = ";".join(f"{k}={v:.6g}" if isinstance(v, float) else f"{k}={v}" for k, v in found.items())
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [one(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            added = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names)

    return given.mapInArrow(run, schema)
