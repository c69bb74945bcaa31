"""Web archives as a chunked record table (operator 1).

Writing: every page is a WARC/1.1 record with its html in UTF-8 as payload, or, if a page with the same
payload of at least LEAST_REVISIT bytes and a larger page_id exists, a revisit record that names it. Each
task writes one file of gzip members, one per record, block by block, to the shared folder; a file counts
only once its task has reported it, so that repeated tasks leave no doubles.

Reading: the archives become rows (record_id, chunk, ...): every CHUNK bytes of a record's content are a row
with the chunk's bytes, the content bytes so far, and the digest of the payload up to there. A record is
never held whole: what a task holds is one compressed block, one chunk and the digest's state. Files are
the unit of work; their size is bounded by the input split of the task that wrote them.

Null html is an empty payload. Rows that repeat are records of their own (equal page_id and html: none
revisits the other); a page_id with several payloads has a decision for each of them. Rows without page_id are written with an empty id and read back with null; they are always
responses and never revisited. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch_path

LEAST_REVISIT = 1000
CHUNK = 1 << 16
BLOCK = 1 << 12  # compressed bytes inflated at once: at most about a thousand times as many come out
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the table has no capture times

RECORDS = ("page_id long, chunk int, chunk_bytes int, data binary, bytes_so_far long, digest_so_far string, last boolean, "
           "record_type string, refers_to long, payload_bytes long, payload_digest string")


def _decisions(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of payloads of pages that are revisits."""
    size = F.octet_length("html")
    large = pages.where(F.col("page_id").isNotNull() & (size >= LEAST_REVISIT)).select(
        "page_id", F.sha2("html", 256).alias("digest"), size.alias("n"))
    last = large.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
    last = last.where("least < refers_to").drop("least")
    return large.join(last, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _one_line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of the archives written for ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"))
    rows = rows.join(_decisions(pages), ["page_id", "digest"], "left").select(
        "page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("html"), "refers_to")

    def write(batches):
        context = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(base, recursive=True)
        path = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        records = written = 0
        with fs.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    page, url, html, refers = (batch.column(c)[i] for c in range(4))
                    for block in _record(page.as_py(), url.as_py(), memoryview(html.as_buffer()), refers.as_py()):
                        out.write(block)
                        written += len(block)
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([written])],
                                         ["path", "records", "bytes"])

    return rows.mapInArrow(write, "path string, records long, bytes long")


def _record(page, url, payload: memoryview, refers) -> Iterator[bytes]:
    """A record as one gzip member, in blocks."""
    sha = hashlib.sha1()
    for lo in range(0, len(payload), CHUNK):
        sha.update(payload[lo: lo + CHUNK])
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url or "")), ("WARC-Payload-Digest", f"sha1:{sha.hexdigest()}")]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("X-Payload-Length", str(len(payload)))]
    body = payload if refers is None else memoryview(b"")
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    yield pack.compress(_header(fields))
    for lo in range(0, len(body), CHUNK):
        yield pack.compress(body[lo: lo + CHUNK])
    yield pack.compress(b"\r\n\r\n") + pack.flush()


class _Inflate:
    """The bytes of a file of gzip members, asked for a few at a time."""

    def __init__(self, stream):
        self.stream, self.raw, self.held = stream, b"", bytearray()
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data + self.raw, zlib.decompressobj(31)
            raw, self.raw = self.raw or self.stream.read(BLOCK), b""
            if not raw:
                return False
            block = self.member.decompress(raw)
            if block:
                self.held += block
                return True

    def line(self) -> bytes | None:
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _number(text: str | None):
    found = re.search(r"<urn:page:(-?\d+)>", text or "")
    return int(found[1]) if found else None


def read_file(stream) -> Iterator[dict]:
    """Chunk rows of one archive, see RECORDS."""
    source = _Inflate(stream)
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size, left, done, chunk, sha = int(head["content-length"]), int(head["content-length"]), 0, 0, hashlib.sha1()
        while True:
            data = source.take(min(CHUNK, left))
            left -= len(data)
            done += len(data)
            sha.update(data)
            revisit = head["warc-type"] == "revisit"
            if not left and not revisit and f"sha1:{sha.hexdigest()}" != head["warc-payload-digest"]:
                raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
            yield {"page_id": _number(head["warc-record-id"]), "chunk": chunk, "chunk_bytes": len(data), "data": data,
                   "bytes_so_far": done, "digest_so_far": sha.hexdigest(), "last": not left, "record_type": head["warc-type"],
                   "refers_to": _number(head.get("warc-refers-to")),
                   "payload_bytes": int(head["x-payload-length"]) if revisit else size,
                   "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
            chunk += 1
            if not left:
                break


def read_archives(files: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """The chunk rows of the archives in ``files`` (path), see RECORDS. ``data``: with the chunks' bytes."""
    names = [x.partition(" ")[0] for x in RECORDS.split(", ")]
    schema = pa.schema([("page_id", pa.int64()), ("chunk", pa.int32()), ("chunk_bytes", pa.int32()), ("data", pa.binary()),
                        ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string())])
    assert names == schema.names

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for row in read_file(stream):
                        held += row["chunk_bytes"]
                        rows.append(row if data else row | {"data": None})
                        if held >= 1 << 22 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``pages``, written to
    archives and read back. Digest and length of a response are those of the chunks that were read."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "llm-warc")
    files = keep(write_archives(pages, folder), "archives")
    n = max(1, files.count())
    chunks = read_archives(files.repartition(n), folder, data=False)
    read = F.col("record_type") == "response"
    return chunks.where("last").select(
        "page_id", F.when(read, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
