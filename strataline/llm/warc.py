"""WARC archives: a writer, and a reader that streams records as a chunked record table.

Writing: each task appends gzip members, one per record, to archives of its own in the shared folder, rolled at
`ROLL_BYTES`; a name holds the task's attempt, and only names that a finished task returns are read, so lost or
repeated attempts leave no half records. Payloads go through fixed-size slices of the Arrow buffer with a running
digest. Reading: a record is never held whole; every `CHUNK_BYTES` of payload become a row (record, chunk number,
bytes, digest so far), and the last row's digest is checked against the header.

Of equal payloads of at least `MIN_REVISIT_BYTES` the row with the largest id is written as response and the others
as revisit records that name it; equality is that of SHA-1, SHA-256 and length.

Defined cases: a null payload is empty; a null or unprintable url is written escaped, or as urn:page:<id>; several rows
with the largest id are all responses; a null id is written and read as null and never merged; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import fresh_path, staged

CHUNK_BYTES = 1 << 16
ROLL_BYTES = 1 << 30
MIN_REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
LEVEL = 1
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
CHUNKS = "archive string, record_id string, page_id long, record_type string, refers_to long, chunk int, last boolean, payload_bytes long, digest string, data binary"


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a folder URI (file:/x counts as file:///x)."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def record_uri(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def clean_uri(url: str | None, page_id: int | None) -> str:
    """url with spaces and control characters escaped, so that a header stays one line."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def sliced_digest(payload: memoryview) -> str:
    running = hashlib.sha1()
    for at in range(0, len(payload), CHUNK_BYTES):
        running.update(payload[at : at + CHUNK_BYTES])
    return running.hexdigest()


def write_record(out, page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None) -> int:
    """One record as one gzip member; returns its bytes in the archive."""
    digest = sliced_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = 0 if refers_to is not None else len(payload)
    lines.append(f"Content-Length: {len(http) + body}")
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    size = out.write(packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http)) or 0
    for at in range(0, body, CHUNK_BYTES):
        size += out.write(packer.compress(payload[at : at + CHUNK_BYTES])) or 0
    return size + (out.write(packer.compress(b"\r\n\r\n") + packer.flush()) or 0)


class _Members:
    """Bytes of a file of gzip members, decompressed as they are asked for."""

    def __init__(self, raw) -> None:
        self.raw, self.unpacker, self.left, self.ready = raw, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if self.unpacker.eof:
            self.left, self.unpacker = self.unpacker.unused_data or self.left, zlib.decompressobj(31)
        block = self.left or self.raw.read(CHUNK_BYTES)
        if not block:
            return False
        self.left = b""
        self.ready += self.unpacker.decompress(block, CHUNK_BYTES)
        self.left = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                if self.ready:
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        """Up to n bytes, at least one."""
        while not self.ready:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[: len(out)]
        return out


def read_records(raw, archive: str, with_data: bool = True) -> Iterator[tuple]:
    """Rows of the chunked record table, in file order, a chunk in memory at a time."""
    source = _Members(raw)
    while (first := source.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        while line := source.line():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            head[name.lower()] = value.strip()
        left = int(head["content-length"])
        while line := source.line():
            left -= len(line) + 2
        left -= 2
        page, to = (int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page"))
        about = (archive, head["warc-record-id"], page, head["warc-type"], to)
        stated = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "revisit":
            yield (*about, 0, True, int(head["x-payload-length"]), stated, None)
            continue
        running, done, number = hashlib.sha1(), 0, 0
        while left > 0 or number == 0:
            chunk = bytearray()
            while left > 0 and len(chunk) < CHUNK_BYTES:
                part = source.take(min(left, CHUNK_BYTES - len(chunk)))
                chunk += part
                left -= len(part)
            running.update(chunk)
            done += len(chunk)
            so_far = running.hexdigest()
            if left == 0 and so_far != stated:
                raise ValueError(f"{about[1]}: payload digest {so_far}, header {stated}")
            yield (*about, number, left == 0, done, so_far, bytes(chunk) if with_data else None)
            number += 1


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes a record per row and returns the manifest (archive, records, bytes), itself written."""
    folder = fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    raw = F.col("payload").cast("binary")
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "d1": F.sha1(raw), "d2": F.sha2(raw, 256)})
    last = (
        rows.where((F.col("n") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
        .groupBy("n", "d1", "d2")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    marked = rows.join(last, ["n", "d1", "d2"], "left").select("page_id", "url", "payload", F.expr("if(page_id < response_id, response_id, null)").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        filesystem.create_dir(path, recursive=True)
        task = TaskContext.get()
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": name, "records": records, "bytes": size}], schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            ids, urls, texts, to = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out, records, size = filesystem.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                body = texts[i].as_buffer()
                size += write_record(out, ids[i].as_py(), urls[i].as_py(), memoryview(body) if body is not None and body.size else memoryview(b""), to[i].as_py())
                records += 1
                if size >= ROLL_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return staged(marked.mapInArrow(write, "archive string, records long, bytes long").withColumn("folder", F.lit(folder)), "warc-manifest")


def read_archives(manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of the manifest's archives."""
    count = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = CHUNKS.replace(",", "").split()[::2]
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in zip(names, CHUNKS.replace(",", "").split()[1::2], strict=True)])
        for batch in batches:
            for folder, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, path = open_folder(folder)
                with filesystem.open_input_stream(f"{path}/{archive}", compression=None) as raw:
                    rows = []
                    for row in read_records(raw, archive, with_data):
                        rows.append(row)
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.select("folder", "archive").repartition(count).mapInArrow(read, CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    read = staged(read_archives(write_archives(pages), with_data=False).where("last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"), "warc-read")
    return with_checked_revisits(read)


def with_checked_revisits(read: DataFrame) -> DataFrame:
    """The records that were read; a revisit must name a response whose payload, as read, has its length and digest."""
    there = read.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct().withColumn("_there", F.lit(True))
    told = read.where("record_type = 'revisit'").join(there, ["refers_to", "payload_bytes", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response has the payload of revisit "), F.col("page_id").cast("string"))).cast("string")
    checked = told.withColumn("record_type", F.when(F.col("_there"), F.col("record_type")).otherwise(lost))
    return read.where("record_type = 'response'").unionByName(checked.select(*read.columns))


#: DuckDB SQL of round_trip over pages.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM d
"""
