"""Operator 3: WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of WARC records, and at its end a seek table in a
skippable frame, as the seekable format of Zstandard has it: sizes of every frame, then their number, a descriptor and a
magic number. The index maps a record to its bundle, its frame and its offset inside that frame, so one record costs the
footer and one frame.

Bundles are written by Spark's own writer, so they commit as one and may lie in any file system. The text writer puts
bytes through unchanged and ends a row with a separator: the last three bytes of the magic number are the character
U+A48F, and so each file's only row is a bundle without them.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Fixed values of the seekable format: the magic numbers of a skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_TAIL = struct.pack("<I", SEEKABLE)[1:]
#: Payloads below this many bytes are never revisits.
LEAST = 1000
#: Bytes of records in a frame and in a bundle before compression, at least (the last one of a task may have less).
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
_SPACE = uuid.UUID("6f1b6d3e-43f0-5f0e-9a3b-7c1c6f0c2b11")
_DATE = "2024-01-01T00:00:00Z"


def record_id(page: int | None) -> str:
    return f"<{uuid.uuid5(_SPACE, str(page)).urn}>"


def write_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: the whole HTTP message, or for a revisit its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", _DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c > " " else f"%{ord(c):02X}" for c in url)))
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """Of the record at an offset: its fields, the head and the body of its HTTP message, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    head, _, body = data[start : start + size].partition(b"\r\n\r\n")
    return fields, head, body, start + size + 4


class Bundle:
    """Grows by records; ``close`` gives the file's bytes."""

    def __init__(self) -> None:
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open, self.size, self.held = [], 0, 0
        self._pack = zstandard.ZstdCompressor(level=3)

    def add(self, record: bytes) -> tuple[int, int]:
        """The record's frame and its offset there."""
        at = len(self.frames), self.size
        self.open.append(record)
        self.size += len(record)
        self.held += len(record)
        if self.size >= FRAME_BYTES:
            self._flush()
        return at

    def _flush(self) -> None:
        raw = b"".join(self.open)
        if raw:
            self.frames.append(self._pack.compress(raw))
            self.sizes.append((len(self.frames[-1]), len(raw)))
        self.open, self.size = [], 0

    def close(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Each frame's start and size in the file and its size before compression, from the footer alone."""
    n, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for packed, raw in struct.iter_unpack("<II", bundle[-9 - 8 * n : -9]):
        out.append((at, packed, raw))
        at += packed
    return out


def read_at(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes, bytes]:
    """One record of a bundle, by way of the seek table and one frame."""
    start, packed, raw = seek_table(bundle)[frame]
    return read_record(zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=raw), offset)[:3]


def mark_revisits(pages: DataFrame, ws: Workspace) -> DataFrame:
    """(id, url, payload) with its digest and refers_to: of equal payloads of LEAST bytes or more, the row with the largest id is what others refer to."""
    summed = pages.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")).where(F.col("size") >= LEAST)
    shared = ws.save(summed.groupBy("digest", "size").agg(F.max("id").alias("refers_to"), F.min("id").alias("low")).where("low < refers_to").drop("low"), "shared")
    revisits = ws.save(summed.join(shared, ["digest", "size"]).where("id < refers_to").select("id", "digest", "refers_to").distinct(), "revisits")
    return pages.withColumn("digest", F.sha1("payload")).join(revisits, ["id", "digest"], "left")


def write(pages: DataFrame, path: str, index: str, ws: Workspace, id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Bundles under ``path`` and the index (id, bundle, frame, offset) at ``index``.

    A null payload is an empty one. A row with a null id is a response without an id; rows that repeat an id are records
    of their own. An empty table leaves a folder without bundles. Other columns aren't read, whatever their names.
    """
    source = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, bundle, rows = TaskContext.get().partitionId(), 0, Bundle(), []

        def full() -> pa.RecordBatch:
            name = f"{task:06d}-{k:06d}"
            content = bundle.close()[:-3]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([rows], of)], ["bundle", "content", "records"])

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, address, body, digest, refers_to = (c[i].as_py() for c in columns)
                frame, offset = bundle.add(write_record(page, address, body, digest, refers_to))
                rows.append({"id": page, "frame": frame, "offset": offset})
                if bundle.held >= BUNDLE_BYTES:
                    yield full()
                    k, bundle, rows = k + 1, Bundle(), []
        if rows:
            yield full()

    of = pa.list_(pa.struct([("id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64())]))
    made = ws.save(mark_revisits(source, ws).select("id", "url", "payload", "digest", "refers_to").mapInArrow(run, "bundle string, content binary, records array<struct<id: long, frame: int, offset: long>>"), "made")
    made.select(F.col("content").cast("string").alias("value"), "bundle").write.mode("overwrite").option("lineSep", _TAIL.decode()).option("maxRecordsPerFile", 1).partitionBy("bundle").text(path)
    made.select(F.inline("records"), "bundle").write.mode("overwrite").parquet(index)
    ws.drop("made")


def read_back(spark, path: str) -> DataFrame:
    """One row per record of the bundles under ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                bundle = memoryview(content.as_buffer())
                for start, packed, raw in seek_table(bundle):
                    data, at, rows = zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=raw), 0, []
                    while at < len(data):
                        fields, head, body, at = read_record(data, at)
                        whole = fields["WARC-Type"] == "response"
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        digest = hashlib.sha1(body).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if whole and (len(body) != size or fields["WARC-Payload-Digest"] != f"sha1:{digest}"):
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                        page, refers = (int(fields[x]) if x in fields else None for x in ("X-Page-Id", "X-Refers-To-Page-Id"))
                        rows.append((page, size, digest, fields["WARC-Type"], refers, body if whole else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
