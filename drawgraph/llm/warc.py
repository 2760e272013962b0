"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records of about FRAME bytes,
and at its end a skippable frame with the seek table (compressed and full size of every frame). The index
names for every record its bundle, its frame's place in it, and the record's offset within the frame, so
one record costs one small read. Plain zstd tools can unpack a bundle from end to end.

Pages of equal payload are stored once: the one with the smallest page_id as a response, others as
revisits that refer to it. Which payloads repeat is decided on digests alone (combined in the map tasks);
pages then meet the decision by digest, and a hot digest is split by adaptive execution, as only its
pages, not the decision, are many.

Bundles have a new name for every attempt at a task. The index is written by Spark and names only the
bundles of attempts that succeeded, so a lost executor leaves at most files that nothing refers to.

Defined results: a page of any size is one record, alone in its frame if it is longer than FRAME; a null payload is empty; pages without an id are revisits of the smallest id, or
responses where no page of their payload has one; rows that repeat both payload and smallest id are all
responses, with one record id, as an id names its page; null and odd addresses are left out or
percent-encoded; page_id must be a whole number and folder a place that pyarrow opens on every node (a shared file://, s3:// (also s3a), gs://, abfss://, or hdfs:// where
libhdfs is installed; keys come from the environment, not from Spark's settings), else an error is raised before any page is read; only page_id, url and html are archived, further columns of any name are not; an empty
table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import settle, shared_dir, short_batches

#: Bytes of records in a frame before compression, and of frames in a bundle after it.
FRAME, BUNDLE = 256 * 1024, 256 * 1024 * 1024
LEVEL = 3
#: Frames that a task reads, about.
TASK_FRAMES = 1000

# Fixed values of the formats
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id long, record_type string, bundle string, frame long, frame_at long, frame_bytes long, at long, length long"


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a file in the shared folder; Hadoop's names of S3 are known by the plain one there."""
    scheme, _, rest = uri.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, a revisit if it refers to another page. A revisit keeps the HTTP header, whose Content-Length is that of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at a byte of a frame's content, and where the next one starts."""
    gap = data.index(b"\r\n\r\n", at)
    lines = data[at:gap].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record starts here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    start, size = gap + 4, int(head["Content-Length"])
    block = data[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    head["payload"] = payload if head["WARC-Type"] == "response" else None
    head["payload_bytes"] = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    return head, start + size + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """(place, bytes, place of content, bytes of content) of every frame, from the footer of a bundle."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or descriptor:
        raise ValueError("no seek table")
    out, at, full = [], 0, 0
    for packed, size in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((at, packed, full, size))
        at, full = at + packed, full + size
    return out


class _Writer:
    """Bundles of one task. A frame is closed when it is full; a bundle's last act is the seek table."""

    def __init__(self, folder: str):
        self.folder, self.out = folder, None
        self.waiting: list[tuple[int | None, str, bytes]] = []
        self.held, self.rows = 0, []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, page_id: int | None, kind: str, data: bytes) -> None:
        if self.held and self.held + len(data) > FRAME:
            self.close_frame()
        self.waiting.append((page_id, kind, data))
        self.held += len(data)

    def close_frame(self) -> None:
        if not self.waiting:
            return
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            fs, path = _store(self.name)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.out, self.place, self.sizes = fs.open_output_stream(path, compression=None), 0, []
        frame = self.packer.compress(b"".join(x[2] for x in self.waiting))
        self.out.write(frame)
        at = 0
        for page_id, kind, data in self.waiting:
            self.rows.append((page_id, kind, self.name, len(self.sizes), self.place, len(frame), at, len(data)))
            at += len(data)
        self.sizes.append((len(frame), at))
        self.place += len(frame)
        self.waiting, self.held = [], 0
        if self.place >= BUNDLE:
            self.close()

    def close(self) -> None:
        self.close_frame()
        if self.out is not None:
            self.out.write(seek_table(self.sizes))
            self.out.close()
            self.out = None

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
        names = [x.split()[0] for x in INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    writer = _Writer(folder)
    for batch in batches:
        page, url, refers = (batch.column(c) for c in ("page_id", "url", "refers_to"))
        for i, html in enumerate(batch.column("html").cast(pa.binary())):
            page_id, to = page[i].as_py(), refers[i].as_py()
            writer.add(page_id, "response" if to is None else "revisit", record(page_id, url[i].as_py(), html.as_py() or b"", to))
        yield writer.taken()
    writer.close()
    yield writer.taken()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html); returns the index of all records. Payloads below least_bytes are all responses."""
    if not isinstance(pages.schema["page_id"].dataType, IntegralType):
        raise TypeError("page_id must be a whole number")
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    _store(folder)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = short_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.sha1(html).alias("digest"))
    thin = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    firsts = settle(thin.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n"), "firsts")
    joined = rows.join(firsts, "digest", "left")
    joined = joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return settle(joined.mapInArrow(partial(_write, folder=folder), INDEX), "index")


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, list | None]]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame_at"])):
            fs, path = _store(row["bundle"])
            with fs.open_input_file(path) as f:
                f.seek(row["frame_at"])
                yield row["bundle"], unpack.decompress(f.read(row["frame_bytes"])), row.get("wanted")


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for _, data, wanted in _frames(batches):
        rows, at, places = [], 0, iter(wanted) if wanted is not None else None
        while (at := next(places, None)) is not None if places else at < len(data):
            head, after = parse(data, at)
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            if head["payload"] is not None and (digest_of(head["payload"]) != digest or len(head["payload"]) != head["payload_bytes"]):
                raise ValueError(f"record {head['WARC-Record-ID']} does not have the payload that its header names")
            rows.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], _page(head.get("WARC-Refers-To")), digest, head["payload_bytes"], head["payload"] if payloads else None))
            at = after
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _dealt(frames: DataFrame) -> DataFrame:
    """Frames over as many tasks as their number asks for: their rows are short, what they stand for is not."""
    least = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(max(least, frames.count() // TASK_FRAMES + 1), "bundle", "frame_at")


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the frames that an index names, digests checked against payloads."""
    frames = _dealt(index.select("bundle", "frame_at", "frame_bytes").distinct())
    return frames.mapInArrow(partial(_read, payloads=payloads), RECORDS)


def fetch(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Only the records that the index rows name: one read for each frame, the records at their offsets in it."""
    frames = index.groupBy("bundle", "frame_at", "frame_bytes").agg(F.sort_array(F.collect_list("at")).alias("wanted"))
    return _dealt(frames).mapInArrow(partial(_read, payloads=payloads), RECORDS)
