"""WARC archives as chunked record tables.

A record is stored as rows (archive, record, chunk, data, running): its header block as chunk 0, then the payload in chunks of at most CHUNK
bytes, each with the SHA-1 of the payload so far. The data of an archive's rows, in order, are a WARC/1.1 file. Reading streams the
rows of a record in chunk order through a state machine, which checks the running digest at each chunk, so that neither side holds
more of a record than its header and one chunk.

Records with equal payloads of at least min_bytes bytes: that with the smallest page_id is a response; the others are revisit records of
it, with the profile identical-payload-digest and without the payload. A null page_id is larger than any other, so it is a response only
where no other row has its payload. Rows that repeat the smallest page_id are all responses. Null html is empty. An
empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import SENT, scratch, stored, tuned, utf8

CHUNK = 256 << 10
#: Bytes of chunks that are handed on together.
FLUSH = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CRLF = b"\r\n"
HEAD_LIMIT = 1 << 20
CHUNKS = "archive int, record long, chunk long, data binary, running binary"


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def _line(text: str) -> str:
    """A value for a header line: line breaks would end it."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in text)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_chunks(page_id: int | None, url: str | None, payload: memoryview | np.ndarray, first: int | None, revisit: bool) -> Iterator[tuple[bytes, bytes]]:
    """(data, running digest) of each chunk of one record."""
    n, sha = len(payload), hashlib.sha1()
    for at in range(0, n, CHUNK):
        sha.update(payload[at : at + CHUNK])
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{base32(sha.digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else n)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head = "\r\n".join(lines).encode() + CRLF * 2 + http
    sha = hashlib.sha1()
    if revisit or not n:
        yield head + CRLF * 2, sha.digest()
        return
    yield head, sha.digest()
    for at in range(0, n, CHUNK):
        part = payload[at : at + CHUNK]
        sha.update(part)
        yield bytes(part) + (CRLF * 2 if at + CHUNK >= n else b""), sha.digest()


class RecordReader:
    """Reads one record from its chunks, in order; holds its header alone."""

    def __init__(self) -> None:
        self.head, self.fields, self.left, self.sha, self.payload_bytes, self.http, self.tail = b"", None, 0, hashlib.sha1(), 0, None, b""

    def feed(self, data: bytes, running: bytes | None = None) -> None:
        if self.fields is None:
            self.head += data
            if len(self.head) > HEAD_LIMIT + CHUNK:
                raise ValueError("a WARC header without end")
            end = self.head.find(CRLF * 2)
            if end < 0:
                return
            lines = self.head[:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record")
            self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            self.left, data, self.head = int(self.fields["content-length"]), self.head[end + 4 :], b""
        block, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(block)
        if self.http is None:
            self.head += block
            end = self.head.find(CRLF * 2)
            if end < 0:
                block = b""
            else:
                self.http, block, self.head = self.head[:end], self.head[end + 4 :], b""
        if block:
            self.sha.update(block)
            self.payload_bytes += len(block)
        if running is not None and self.sha.digest() != running:
            raise ValueError("a chunk is missing or differs")

    def result(self) -> tuple[int | None, int, str, str, int | None]:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the whole record."""
        if self.fields is None or self.left or self.tail != CRLF * 2 or self.http is None:
            raise ValueError("a WARC record is cut off")
        kind, digest = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            size = next(int(x.partition(b":")[2]) for x in self.http.split(CRLF) if x.lower().startswith(b"content-length:"))
            return _page(self.fields["warc-record-id"]), size, digest, kind, _page(self.fields["warc-refers-to"])
        if base32(self.sha.digest()) != digest:
            raise ValueError("the payload differs from its digest")
        return _page(self.fields["warc-record-id"]), self.payload_bytes, digest, kind, None


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the chunk table of pages (page_id, url, html) to the shared folder, one archive for each task, and returns it."""
    spark = tuned(pages.sparkSession)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.unhex(F.sha1(html)).alias("digest"))
    # only payloads that occur twice need to know their first page; the others aren't shuffled, unless the repeated ones are too many to be sent
    least = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    least = stored(least, "repeated-payloads")
    least = F.broadcast(least) if least.count() <= SENT else least
    known = rows.join(least, F.col("digest") == F.col("d"), "left")
    repeats = (F.octet_length("html") >= min_bytes) & F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    known = known.select("page_id", "url", "html", "first", F.coalesce(repeats, F.lit(False)).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, record, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=["archive", "record", "chunk", "data", "running"])

        for batch in batches:
            data, bounds = utf8(batch.column(2))
            cols = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for i, (page_id, url, first, revisit) in enumerate(zip(*cols, strict=True)):
                for n, (chunk, running) in enumerate(record_chunks(page_id, url, data[bounds[i] : bounds[i + 1]], first, revisit)):
                    held.append((archive, record, n, chunk, running))
                    size += len(chunk)
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
                record += 1
        if held:
            yield flush()

    path = scratch(spark, "warc")
    known.mapInArrow(run, CHUNKS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(CHUNKS).parquet(path)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row for each record of a chunk table. Chunks are dealt by record, so a long record is streamed by one task."""
    tuned(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader, out, due = None, None, [], 0

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

        for batch in batches:
            for i in range(len(batch)):
                archive, record, chunk, data, running = (batch.column(c)[i].as_py() for c in range(5))
                if (archive, record) != key:
                    if reader is not None:
                        out.append(reader.result())
                    key, reader, due = (archive, record), RecordReader(), 0
                if chunk != due:
                    raise ValueError("a chunk is missing")
                due += 1
                reader.feed(data, running)
            if len(out) >= 1000:
                yield flush()
                out = []
        if reader is not None:
            out.append(reader.result())
        if out:
            yield flush()

    dealt = chunks.select("archive", "record", "chunk", "data", "running").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return dealt.mapInArrow(run, RECORDS)


def export(rows: Iterable[tuple[int, int, int, bytes, bytes]], out, compress: bool = True) -> None:
    """Writes rows of one archive, in order, to a binary file; compress: a gzip member for each record."""
    key, member = None, None
    for _, record, _, data, _ in rows:
        if compress and record != key:
            if member is not None:
                member.close()
            member, key = gzip.GzipFile(fileobj=out, mode="wb", mtime=0), record
        (member if compress else out).write(data)
    if member is not None:
        member.close()


def read_file(file, size: int = CHUNK) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """The records of a plain or gzip WARC file, streamed."""
    if file.peek(2)[:2] == b"\x1f\x8b":
        file = gzip.GzipFile(fileobj=file)
    held = b""
    while True:
        while (end := held.find(CRLF * 2)) < 0:
            more = file.read(size)
            if not more:
                if held:
                    raise ValueError("a WARC record is cut off")
                return
            held += more
        fields = dict(x.lower().partition(":")[::2] for x in held[:end].decode().split("\r\n")[1:])
        left, reader = end + 4 + int(fields["content-length"]) + 4, RecordReader()
        while left:
            if not held:
                held = file.read(size)
                if not held:
                    raise ValueError("a WARC record is cut off")
            part, held = held[:left], held[left:]
            left -= len(part)
            reader.feed(part)
        yield reader.result()


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT hex, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31), 1)), '') AS b32 FROM (SELECT DISTINCT hex FROM p)),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN b USING (hex) JOIN f USING (hex)
"""
