"""WARC archives: a writer with revisits, and a sequential reader.

Each record is a gzip member of its own. The reader takes an archive as a stream: it inflates
incrementally, frames records by Content-Length, and verifies payload digests as the bytes go by, so it
holds one record's head and one chunk at a time (and the payload where it is asked for). Archives end
after ARCHIVE_BYTES, so that reading spreads over tasks.

Archives lie in the shared folder (any file system that pyarrow knows, or a shared mount). A task writes
under a name of its attempt and renames at the end: a task run again gives the same files.

Defined results: a null payload is an empty one; a null id is written as such and never referred to; rows
with equal ids are records of their own, and both responses if theirs is the largest id of their payload;
an empty table gives no archive and no record; a record that is cut off or fails its digest is returned
with `problem` set, and nothing after a broken member is read; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import quote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
#: Payloads below this many bytes are never revisits.
LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "archive string, offset long, record_type string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, problem string"


def local_path(uri: str) -> str | None:
    """The path, if uri is in a mounted file system."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


@contextmanager
def opened(uri: str, write: bool = False):
    if (path := local_path(uri)) is not None:
        if write:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb" if write else "rb") as file:
            yield file
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_output_stream(path) if write else system.open_input_stream(path) as file:
            yield file


def renamed(source: str, target: str) -> None:
    if (path := local_path(source)) is not None:
        os.replace(path, local_path(target))
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(source)
        system.move(path, fs.FileSystem.from_uri(target)[1])


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; digest: hex SHA-1 of the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[-1:-1] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n") + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    """What is known of one record while its bytes go by."""

    offset: int
    keep: bool
    buffer: bytearray = field(default_factory=bytearray)
    head: dict[str, str] | None = None
    http: dict[str, str] | None = None
    left: int = 0
    body: int = 0
    sha: object = field(default_factory=hashlib.sha1)
    payload: bytearray = field(default_factory=bytearray)
    problem: str | None = None

    @staticmethod
    def fields(lines: list[str]) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}

    def feed(self, data: bytes) -> None:
        if self.http is not None:
            self.take(data)
            return
        self.buffer += data
        if self.head is None and (end := self.buffer.find(b"\r\n\r\n")) >= 0:
            version, *lines = self.buffer[:end].decode("utf-8", "replace").split("\r\n")
            self.head = self.fields(lines)
            del self.buffer[: end + 4]
            if not version.startswith("WARC/"):
                self.problem = "not a WARC record"
            length = self.head.get("content-length", "")
            self.left = int(length) if length.isdigit() else 0
            if not length.isdigit():
                self.problem = "no Content-Length"
        if self.head is not None and self.http is None:
            block = self.buffer
            if not self.head.get("content-type", "").startswith("application/http"):
                self.http = {}
            elif (end := block.find(b"\r\n\r\n", 0, self.left)) >= 0:
                self.http = self.fields(block[:end].decode("utf-8", "replace").split("\r\n")[1:])
                del block[: end + 4]
                self.left -= end + 4
            elif len(block) >= self.left:
                self.http = {}
            if self.http is not None:
                self.buffer = bytearray()
                self.take(bytes(block))

    def take(self, data: bytes) -> None:
        body, rest = data[: self.left], data[self.left :]
        self.left -= len(body)
        self.body += len(body)
        self.sha.update(body)
        if self.keep:
            self.payload += body
        if rest.strip(b"\r\n"):
            self.problem = self.problem or "bytes after the record"

    def row(self, archive: str, problem: str | None) -> tuple:
        head, http = self.head or {}, self.http or {}
        kind, stated = head.get("warc-type"), head.get("warc-payload-digest", "")
        digest, size = self.sha.hexdigest(), self.body
        problem = problem or self.problem or ("cut off" if self.left or self.head is None else None)
        told = base64.b32decode(stated[5:]).hex() if re.fullmatch(r"sha1:[A-Z2-7]{32}", stated) else None
        if kind == "revisit":
            digest, size = told, int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        elif told is not None and told != digest:
            problem = problem or "digest differs"
        return archive, self.offset, kind, head.get("warc-target-uri"), page_of(head.get("warc-record-id")), page_of(head.get("warc-refers-to")), size, digest, bytes(self.payload) if self.keep and kind != "revisit" else None, problem


def records(file, archive: str, keep_payload: bool = False) -> Iterator[tuple]:
    """Rows of RECORD, from a stream of gzip members."""
    inflate, record, offset, start = zlib.decompressobj(31), None, 0, 0
    while data := file.read(CHUNK):
        while data:
            if record is None:
                start = offset
                record = Record(start, keep_payload)
            try:
                out = inflate.decompress(data, 1 << 20)
                record.feed(out)
                while inflate.unconsumed_tail and not inflate.eof:
                    record.feed(inflate.decompress(inflate.unconsumed_tail, 1 << 20))
            except zlib.error as error:
                yield record.row(archive, f"broken member: {error}")
                return
            rest = inflate.unused_data
            offset += len(data) - len(rest)
            data = rest
            if inflate.eof:
                yield record.row(archive, None)
                inflate, record = zlib.decompressobj(31), None
    if record is not None:
        yield record.row(archive, "cut off")


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to (the record that a revisit refers to)."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    again = large.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    found = rows.join(again.select("digest", "response"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("response")), F.col("response"))
    return found.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST) -> DataFrame:
    """Writes a record for every row; returns archive, records, bytes: one row for each archive, from a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            target = f"{folder}/part-{task.partitionId():06d}-{number:04d}.warc.gz"
            own, size, many = f"{target}.{task.taskAttemptId()}", 0, 0
            with opened(own, write=True) as file:
                while row is not None and size < ARCHIVE_BYTES:
                    data = member(*row)
                    file.write(data)
                    size, many, row = size + len(data), many + 1, next(rows, None)
            renamed(own, target)
            number += 1
            yield pa.RecordBatch.from_pydict({"archive": [target], "records": [many], "bytes": [size]})

    rows = with_revisits(pages, id_col, payload_col, url_col, least)
    spark = pages.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1024:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return written(rows.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """archives: archive (a URI). Rows of RECORD, an archive being one task's work."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                held, size = [], 0
                with opened(archive) as file:
                    for row in records(file, archive, keep_payload):
                        held.append(row)
                        size += 200 + (len(row[8]) if row[8] else 0)
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    own = archives.select("archive")
    return own.repartition(max(1, min(20_000, own.count()))).mapInArrow(read, RECORD)
