"""Operator 5: WARC archives, one gzip member per record, and a sequential reader that checks them."""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, settle, table, trimmed

#: Payloads below this many bytes are always stored in full.
REVISIT_BYTES = 100
#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(text: str | None) -> str:
    """A header value without line breaks."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in text or "")


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 1) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n") + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_digest: str = ""
    payload: bytes | None = None


class WarcReader:
    """Records of one archive, in order, from any iterable of byte pieces.

    Each gzip member is inflated piece by piece; a record's block is framed by its Content-Length, hashed as it
    comes, and checked against the block and payload digests. A block is held only if keep is set.
    """

    def __init__(self, pieces: Iterable[bytes], keep: bool = False, step: int = 1 << 16) -> None:
        self.pieces, self.keep, self.step = iter(pieces), keep, step
        self.raw = b""

    def _members(self) -> Iterator[Iterator[bytes]]:
        while True:
            while not self.raw:
                more = next(self.pieces, None)
                if more is None:
                    return
                self.raw = more
            member = self._inflate()
            yield member
            for _ in member:
                pass

    def _inflate(self) -> Iterator[bytes]:
        opened = zlib.decompressobj(31)
        while not opened.eof:
            if not self.raw:
                self.raw = next(self.pieces, b"") or next(self.pieces, b"")
                if not self.raw:
                    raise WarcError("the archive ends inside a gzip member")
            fed, self.raw = self.raw[: self.step], self.raw[self.step :]
            try:
                out = opened.decompress(fed)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            if opened.eof:
                self.raw = opened.unused_data + self.raw
            if out:
                yield out

    def __iter__(self) -> Iterator[Record]:
        for member in self._members():
            yield self._record(member)

    def _record(self, member: Iterator[bytes]) -> Record:
        head = bytearray()
        while (end := head.find(b"\r\n\r\n")) < 0:
            piece = next(member, None)
            if piece is None:
                raise WarcError("a record's header does not end")
            head += piece
        lines = bytes(head[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("not a WARC record")
        record = Record({k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])})
        if not (said := record.headers.get("content-length", "")).isdigit():
            raise WarcError("a record without content length")
        left, rest = int(said), bytes(head[end + 4 :])
        block, payload, http, kept = hashlib.sha256(), hashlib.sha256(), bytearray(), bytearray()
        in_payload, size = False, 0
        while True:
            piece, rest = rest[:left], rest[left:]
            left -= len(piece)
            block.update(piece)
            if not in_payload:
                http += piece
                if (at := http.find(b"\r\n\r\n")) >= 0:
                    piece, http, in_payload = bytes(http[at + 4 :]), http[:at], True
            if in_payload:
                payload.update(piece)
                size += len(piece)
                if self.keep:
                    kept += piece
            if not left:
                break
            rest = next(member, b"")
            if not rest:
                raise WarcError("a record's block is shorter than its content length")
        tail = rest + b"".join(member)
        if tail != b"\r\n\r\n":
            raise WarcError("a record's block is longer than its content length")
        record.http = dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:] if ": " in x)
        if record.headers.get("warc-block-digest", "") != f"sha256:{block.hexdigest()}":
            raise WarcError("block digest differs")
        claimed = record.headers.get("warc-payload-digest", "").removeprefix("sha256:")
        if record.headers["warc-type"] == "revisit":
            record.payload_bytes, record.payload_digest = int(record.http.get("Content-Length", "0")), claimed
        else:
            if claimed != payload.hexdigest():
                raise WarcError("payload digest differs")
            record.payload_bytes, record.payload_digest, record.payload = size, claimed, bytes(kept) if self.keep else None
        return record


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, n, number = [], 0, 0, 0
    task = TaskContext.get().partitionId()

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}.warc.gz"]), pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["archive", "records", "content"])

    for batch in batches:
        names = ("page_id", "url", "html", "digest", "refers_to", "revisit")
        for page_id, url, html, digest, refers_to, revisit in zip(*(batch.column(batch.schema.get_field_index(x)) for x in names), strict=True):
            held.append(write_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest.as_py(), refers_to.as_py(), revisit.as_py()))
            size, n = size + len(held[-1]), n + 1
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size, n, number = [], 0, 0, number + 1
    if held:
        yield close()


def to_archives(pages: DataFrame) -> DataFrame:
    """Rows (archive, records, content): a gzip WARC file each, of about ARCHIVE_BYTES, or one larger record.

    Of records with equal payloads of REVISIT_BYTES at least the one with the smallest page_id is the response (every row
    that repeats that page_id, if several do) and the others are revisits; smaller payloads are always responses. Null html is an
    empty payload; a null page_id is never the smallest unless all are null, and then all are responses. An empty
    table gives no archive. Further columns are not read.
    """
    rows = pages.select("page_id", "url", "html").withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    large = F.coalesce(F.octet_length("html"), F.lit(0)) >= REVISIT_BYTES
    groups = rows.filter(large).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    groups = settle(groups.filter("n > 1 and first is not null").select("digest", "first"))
    told = lookup_join(rows, groups, ["digest"])
    revisit = F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.lit(False))
    told = told.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("first")))
    return told.select("page_id", "url", "html", "digest", "refers_to", "revisit").mapInArrow(lambda b: trimmed(_archives(b)), "archive string, records bigint, content binary")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for archive, content in zip(batch.column(0), batch.column(1), strict=True):
            view = memoryview(content.as_buffer())
            rows = []
            for r in WarcReader(bytes(view[i : i + (1 << 20)]) for i in range(0, len(view), 1 << 20)):
                own, other = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
                rows.append((archive.as_py(), own and int(own), r.headers.get("warc-target-uri"), r.headers["warc-type"], r.payload_bytes, r.payload_digest, other and int(other)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives (columns archive, content), digests verified; a damaged archive raises WarcError."""
    return archives.select("archive", "content").mapInArrow(lambda b: trimmed(_read(b)), "archive string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint")


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc.gz files under a path that Spark can read."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content"))


def write_warc_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files into a folder that every executor mounts; each is renamed into place, so a retry is harmless."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{folder}/.{archive}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content.as_buffer())
                os.replace(part, f"{folder}/{archive}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["archive"])

    return archives.select("archive", "content").mapInArrow(write, "archive string")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = settle(to_archives(table(spark, sf_dir, "pages")), compression="none")
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
