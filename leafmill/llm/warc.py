"""WARC archives: writing page captures, reading records, assembling transactions.

A capture is three records: a request, a response (or a revisit of an earlier one with the
same payload) and a metadata record; request and metadata name the main record in
WARC-Concurrent-To.  Files are gzip with one member per record.  Tasks write under names of
their own attempt and report them; only reported files count, so a lost executor leaves at
most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import chunks, column, scratch, utf8, written

#: Uncompressed bytes after which a task starts another file.
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "content_type string, payload_bytes long, payload_digest string, block binary, fields map<string,string>"
)


def record_id(kind: str, key: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{kind}:{key}'.encode()).digest()[:16], version=5)}>"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _uri(url: str | None, page: int) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"


def capture(page: int, url: str | None, payload: bytes, refers_to: int | None) -> list[bytes]:
    """The three records of one capture."""
    uri, main = _uri(url, page), record_id("main", page)
    parts = urlsplit(uri)
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    digest = ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        body = record([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, digest, ("Content-Type", "application/http; msgtype=response")], http + payload)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        body = record(
            [("WARC-Type", "revisit"), ("WARC-Record-ID", main), ("WARC-Refers-To", record_id("main", refers_to)), ("WARC-Profile", profile), *common, digest, ("Content-Type", "application/http; msgtype=response")],
            http,
        )
    ask = f"GET {parts.path or '/'} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")], ask)
    note = record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page)), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/warc-fields")],
        f"page-id: {page}\r\n".encode(),
    )
    return [request, body, note]


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        done: list[tuple[str, int, int]] = []
        out, path, count, size = None, "", 0, 0
        for part in chunks(batches, "html", 1 << 22):
            for page, url, html, refers in zip(column(part, "page_id").to_pylist(), column(part, "url").to_pylist(), utf8(column(part, "html")), column(part, "refers_to").to_pylist()):
                if out is None:
                    path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = store.open_output_stream(path), 0, 0
                for raw in capture(page, url, html or b"", refers):
                    out.write(_member(raw))
                    count, size = count + 1, size + len(raw)
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the captures of pages(page_id, url, html) and returns the manifest of files.

    A null html is an empty payload, a null url becomes ``urn:page:ID``.  Of equal payloads of
    at least min_revisit_bytes the one with the smallest page_id is a response and the others
    revisit it.  Repeated page_ids count once each as captures of their own; rows without
    page_id are left out; other columns are ignored; an empty table writes no file.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    pages = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = written(pages.select("page_id", F.sha1(payload).alias("sha1"), F.length(payload).alias("size")), "digests")
    first = digests.where(F.col("size") >= min_revisit_bytes).groupBy("sha1", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    revisits = digests.join(first.where("n > 1"), ["sha1", "size"]).where("page_id <> refers_to").select("page_id", "refers_to").distinct()
    rows = pages.join(revisits, "page_id", "left")
    return written(rows.mapInArrow(_write(folder), MANIFEST), "manifest")


class _Members(io.RawIOBase):
    """Decompressed bytes of a gzip file of many members, read in small steps."""

    def __init__(self, stream):
        self.stream, self.z, self.rest, self.ready = stream, zlib.decompressobj(47), b"", b""

    def readable(self):
        return True

    def readinto(self, target):
        while not self.ready:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(47)
            data = self.rest or self.stream.read(1 << 18)
            self.rest = b""
            if not data:
                return 0
            self.ready = self.z.decompress(data, 1 << 20)
            if self.z.unconsumed_tail:
                self.rest = self.z.unconsumed_tail
        n = min(len(target), len(self.ready))
        target[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed stream."""
    reader = io.BufferedReader(stream, 1 << 18)
    while True:
        line = reader.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := reader.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = reader.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a WARC record ends early")
        yield headers, block


def _http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def read_warc(manifest: DataFrame, blocks: bool = True) -> DataFrame:
    """One row per record of the manifest's files; without blocks the column block is null for main records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string())]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for part in batches:
            for path in column(part, "path").to_pylist():
                store, name = _store(path)
                rows, size = [], 0
                with store.open_input_stream(name) as stream:
                    for h, block in parse_records(_Members(stream)):
                        kind = h.get("warc-type", "")
                        payload = _http_payload(block) if kind == "response" else None
                        fields = {}
                        if h.get("content-type") == "application/warc-fields":
                            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k}
                        digest = sha1_base32(payload) if payload is not None else h.get("warc-payload-digest", "").rpartition(":")[2] or None
                        keep = blocks or kind not in ("response", "revisit")
                        rows.append(
                            (h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("content-type"), None if payload is None else len(payload), digest, block if keep else None, list(fields.items()))
                        )
                        size += len(block) if keep else 200
                        if size > 1 << 22 or len(rows) >= 4000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = manifest.select("path")
    count = max(1, min(files.count(), 4096))
    return files.repartition(count, "path").mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the main record with its request and metadata.

    Main records are responses and revisits; requests and metadata belong to the one they name
    in concurrent_to.  Of several the one with the smallest record_id is taken and n_requests /
    n_metadata count all.  A revisit's payload_bytes come from the record it refers to.
    """
    main = records.where("type in ('response', 'revisit')")

    def side(kind: str, count: str) -> DataFrame:
        part = F.struct("record_id", "target_uri", "date", "content_type", "block", *(["fields"] if kind == "metadata" else []))
        rows = records.where(F.col("type") == kind)
        return rows.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(part, "record_id").alias(kind), F.count("*").alias(count))

    original = records.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("original_bytes"))
    rows = main.join(side("request", "n_requests"), "record_id", "left").join(side("metadata", "n_metadata"), "record_id", "left")
    known, others = rows.where("type = 'response'"), rows.where("type = 'revisit'").join(original, "refers_to", "left")
    shape = ["record_id", "type", "refers_to", "target_uri", "date", "payload_digest", "block", "request", "metadata", F.coalesce("n_requests", F.lit(0)).alias("n_requests"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata")]
    return known.select(*shape, "payload_bytes").unionByName(others.select(*shape, F.col("original_bytes").alias("payload_bytes")))


def read_back(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each archived page."""
    records = written(read_warc(manifest, blocks=False), "records")
    rows = transactions(records).withColumn("page_id", F.expr("try_cast(metadata.fields['page-id'] as bigint)"))
    rows = rows.select("page_id", "record_id", F.col("refers_to").alias("target"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"))
    pages = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("target"), F.expr("try_cast(fields['page-id'] as bigint)").alias("refers_to")).distinct()
    found = rows.where("target is not null").join(pages, "target", "left").unionByName(rows.where("target is null").withColumn("refers_to", F.lit(None).cast("long")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
