"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

The reader's tasks each get a byte range of a file. A task looks for gzip magic in its range, takes a place for a
member only if its first bytes decode to a WARC record's headers, and owns the records whose members start inside the
range, reading on past its end where the last of them does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.llm.shared import pieces, shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "warc_type string, record_id string, refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary, path string, offset long, damage string"
CHUNK = 1 << 18
#: Byte ranges are dealt to so many tasks at most; a task reads its ranges one after another.
MOST_TASKS = 20_000


def digest_of(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case and without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record as a gzip member of its own. A revisit keeps the HTTP headers, with the full length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if kind == "revisit" else http + payload
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if uri is not None:
        named.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if kind == "revisit":
        named += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block)
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head + block + b"\r\n\r\n") + press.flush()


def _fields(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    return found


class Members:
    """The gzip members of an open file, from a byte on."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size = file, size

    def bytes_at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at)) if at < self.size else b""

    def header(self, at: int) -> bool:
        """Whether a member that begins here decodes to a record's headers, however long they are."""
        decode, out, pos, step = zlib.decompressobj(31), bytearray(), at, 4096
        while pos < self.size and not decode.eof:
            data = self.bytes_at(pos, step)
            pos, step = pos + len(data), min(2 * step, CHUNK)
            seen = max(0, len(out) - 3)
            try:
                out += decode.decompress(data)
            except zlib.error:
                return False
            if not VERSION[:5].startswith(out[:5]) and not out.startswith(VERSION[:5]):
                return False
            if (end := out.find(b"\r\n\r\n", seen)) >= 0:
                return "content-length" in _fields(bytes(out[:end]))
        return False

    def find(self, at: int, end: int) -> int | None:
        """The first place from here on, before the end, where a record's member begins."""
        while at < end:
            data = self.bytes_at(at, min(CHUNK, end - at + len(MAGIC) - 1))
            place = data.find(MAGIC)
            while place >= 0:
                if at + place < end and self.header(at + place):
                    return at + place
                place = data.find(MAGIC, place + 1)
            if len(data) < len(MAGIC):
                return None
            at += len(data) - len(MAGIC) + 1
        return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The member's content and the place after it; None if it is damaged or cut off."""
        decode, out, pos = zlib.decompressobj(31), [], at
        while not decode.eof:
            data = self.bytes_at(pos, CHUNK)
            if not data:
                return None
            pos += len(data)
            try:
                out.append(decode.decompress(data))
            except zlib.error:
                return None
        return b"".join(out), pos - len(decode.unused_data)


def parse(content: bytes) -> dict | None:
    """The record in a member's content, or None if its lengths or its digest don't hold."""
    end = content.find(b"\r\n\r\n")
    if end < 0 or not content.startswith(VERSION[:5]):
        return None
    head = _fields(content[:end])
    length = head.get("content-length", "")
    if not length.isdigit() or len(content) < end + 4 + int(length):
        return None
    block = content[end + 4 : end + 4 + int(length)]
    kind, digest = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        http = _fields(block[:cut]) if cut >= 0 else {}
        payload = block[cut + 4 :] if cut >= 0 else block
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    if kind == "revisit":
        payload = None
    elif digest is not None and digest_of(payload) != digest:
        return None
    else:
        size, digest = len(payload), digest_of(payload)
    bare = lambda name: head[name].strip("<>") if name in head else None
    return {"warc_type": kind, "record_id": bare("warc-record-id"), "refers_to": bare("warc-refers-to"), "target_uri": head.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "payload": payload}


def records_in(members: Members, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """The records whose members begin in [start, end), with their places. A damaged one says what is wrong, and reading
    goes on at the next member that decodes."""
    at = members.find(start, end)
    while at is not None and at < end:
        read = members.member(at)
        record = parse(read[0]) if read else None
        yield at, record or {"damage": "the record's lengths or digest don't hold" if read else "the member doesn't decode"}
        if read and members.bytes_at(read[1], len(MAGIC)) == MAGIC:
            at = read[1]
        else:
            at = members.find(read[1] if read else at + 1, end)


def mark_revisits(pages: DataFrame, payload: Column, id_column: str, least: int = 0) -> DataFrame:
    """pages with __digest, __size and __of: the id of the response whose payload a row repeats, null for a response.

    Of rows with equal payloads of at least `least` bytes the largest id is the response; rows that tie for it all
    are. A null id ranks below all others. Groups are found on (digest, id) rows alone, aggregated before they are
    shuffled, so neither a group's size nor its payloads weigh on one task; the pages are then dealt by digest and id.
    """
    known = pages.withColumns({"__digest": F.sha1(payload), "__size": F.octet_length(payload).cast("long")})
    keys = known.filter(F.col("__size") >= least).select(F.col("__digest").alias("__d"), F.col(id_column).alias("__i"))
    first = keys.groupBy("__d").agg(F.max("__i").alias("__of"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    repeats = keys.distinct().join(first, "__d").filter(~F.col("__i").eqNullSafe(F.col("__of")))
    same = (F.col("__digest") == F.col("__d")) & F.col(id_column).eqNullSafe(F.col("__i"))
    return known.join(repeats, same, "left").drop("__d", "__i")


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, prefix: str = "urn:page:") -> DataFrame:
    """Writes a record per row to .warc.gz files under the path, one file a task; returns path, records and bytes of each.

    A null payload is empty, a null uri is left out, a null id is written as null. A file is written under a name of
    its own and renamed when whole, so a task that is repeated leaves one good file. Other columns aren't written.
    """
    rows = pages.select(F.col(id_column).alias("id"), F.col(uri).alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary")).alias("payload"))
    marked = mark_revisits(rows, F.col("payload"), "id", least).select("id", "uri", "payload", "__of", "__digest", "__size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(path)
        name, count, size = uuid.uuid4().hex, 0, 0
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/.{name}.tmp") as out:
            for batch in pieces(batches):
                for i, u, data, of, sha, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    revisit = of is not None
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    made = record_bytes("revisit" if revisit else "response", f"{prefix}{'null' if i is None else i}", u, b"" if revisit else data, digest, n, f"{prefix}{of}")
                    out.write(made)
                    count, size = count + 1, size + len(made)
        if count:
            store.move(f"{root}/.{name}.tmp", f"{root}/{name}.warc.gz")
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}.warc.gz"]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        else:
            store.delete_file(f"{root}/.{name}.tmp")

    return marked.mapInArrow(run, "path string, records long, bytes long")


def read_warc(files: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """The records of gzipped WARC files, given as rows with path and bytes, read by ranges of split_bytes.

    Columns as in RECORD; payload is null for revisits. A member whose headers decode, but that is damaged, gives a row
    of path, offset and damage, null elsewhere; reading goes on at the next one that decodes. What isn't recognised at
    all gives no row: `complete` compares the number of records with the manifest's. A file of no bytes has no records.
    """
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / split_bytes).cast("int")))
    ranges = files.filter("bytes > 0").select("path", "bytes", starts.alias("__k"))
    ranges = ranges.select("path", "bytes", (F.col("__k").cast("long") * split_bytes).alias("start"))
    ranges = ranges.repartition(min(MOST_TASKS, max(1, ranges.count())))
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    rows, held = [], 0
                    for at, record in records_in(Members(file, size), start, min(size, start + split_bytes)):
                        rows.append(record | {"path": path, "offset": at})
                        held += len(record.get("payload") or b"")
                        if held > 8 << 20 or len(rows) == 4096:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return ranges.mapInArrow(run, RECORD)


def complete(records: DataFrame, files: DataFrame) -> DataFrame:
    """records (of read_warc, any of its columns but damage among them), stored; raises where one is damaged or missing."""
    found = stored(records, "records")
    held = found.agg(F.count("*").alias("n"), F.count("damage").alias("damaged")).first()
    want = files.agg(F.sum("records")).first()[0] or 0
    if held["damaged"] or held["n"] != want:
        raise ValueError(f"{want} records were written, {held['n']} read, {held['damaged']} of them damaged")
    return found.drop("damage")


def archive(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes pages as WARC files in the shared folder and returns the manifest, which is stored beside them."""
    root = shared_dir(spark, "warc")
    write_warc(pages, f"{root}/files", **options).write.parquet(f"{root}/manifest")
    return spark.read.schema("path string, records long, bytes long").parquet(f"{root}/manifest")
