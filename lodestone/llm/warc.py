"""WARC archives with revisit resolution by payload digest.

Digests are headers: (page_id, url, bytes, digest) of every page, without its payload. They are grouped by digest,
minima first within the tasks, so a payload that a third of all pages share costs one row a task (the join back can
be split at it); the page of the
least page_id is the response, others of at least MIN_BYTES revisit it. The repeated digests are joined back to the
pages, and each task writes its records into archives of its own with fresh headers: WARC/1.1, one gzip
member a record, files of about FILE_BYTES. A manifest lists the files of the attempts that counted.

Reading goes through the files of the manifest, a member at a time. A revisit record has no payload; its digest is in
its headers and its size in the HTTP headers it keeps, and its response is found again by a join.

Defined results: null html is an empty payload; null url has no target header and reads as null; pages with equal
page_id are pages of their own, each resolved by its own payload, and where both page_id and payload are equal to a
response's, all are responses; a null page_id is written as an empty id and never a revisit's
target unless all equal pages lack one; an empty table gives no files; extra columns are never read."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, discard, fresh_path, map_arrow, utf8_views, written
from .files import open_read, open_write

MIN_BYTES = 100
FILE_BYTES = 64 << 20
LEVEL = 1
#: Repeated payloads (some 150 bytes each in Spark's table) up to which their digests are broadcast. Beyond it, payloads
#: are shuffled once, by digest, in a join that adaptive execution splits where very many pages share one.
DIGESTS = 300_000
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest)"""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            payloads = [b"" if x is None else x for x in utf8_views(batch.column("html"))]
            sums = [hashlib.sha256(x).hexdigest() for x in payloads]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), pa.array([len(x) for x in payloads], pa.int64()), pa.array(sums, pa.string())], names=["page_id", "payload_bytes", "payload_digest"])

    return map_arrow(pages.select("page_id", "html"), batches, "page_id bigint, payload_bytes bigint, payload_digest string")


def resolve(heads: DataFrame) -> DataFrame:
    """(id, refers_to), a written table: the repeated digests, with the least page_id of each."""
    large = heads.filter(F.col("payload_bytes") >= MIN_BYTES)
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return written(first.select(F.col("payload_digest").alias("id"), "refers_to"), "responses")


def record_id(page_id: int | None, digest: str) -> str:
    """Follows from the page and its payload, so that a revisit can name its response and a repeated task writes the same."""
    return f"<{(uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} {digest}')).urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record with fresh headers: an HTTP response with its payload, or, for a revisit, without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    broken = url is not None and ("\r" in url or "\n" in url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        *([] if url is None else [("WARC-Target-URI", url)] if not broken else [("WARC-Target-URI", quote(url)), ("X-Quoted-URI", "yes")]),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", "" if page_id is None else str(page_id)),
        *([] if refers_to is None else [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "".join([f"{VERSION}\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()
    return b"".join([head, block, b"\r\n\r\n"])


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write(pages: DataFrame) -> DataFrame:
    """Writes the archives; the manifest (path, records), a written table."""
    folder = fresh_path(pages.sparkSession, "warc")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = written(headers(pages), "headers")
    first = resolve(heads)
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)
    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", digest.alias("payload_digest"))
    target = F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to")).alias("refers_to")
    joined = by_ids(keyed, "payload_digest", first, "left", DIGESTS).select("page_id", "url", "html", "payload_digest", target)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, path, size, records, serial = None, "", 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

        for batch in stream:
            ids, urls, sums, targets = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "refers_to"))
            for i, view in enumerate(utf8_views(batch.column("html"))):
                payload = b"" if view is None else view.tobytes()
                if out is None:
                    path, size, records = f"{folder}/part-{part:06d}-{serial:06d}-{attempt}.warc.gz", 0, 0
                    out = open_write(path)
                raw = _member(record(ids[i], urls[i], payload, sums[i], targets[i], date))
                out.write(raw)
                size, records = size + len(raw), records + 1
                if size >= FILE_BYTES:
                    yield closed()
                    out, serial = None, serial + 1
        if out is not None:
            yield closed()

    manifest = written(map_arrow(joined, batches, "path string, records bigint"), "warc-manifest")
    discard(heads, first)
    return manifest


def members(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, unpacked one after the other."""
    rest, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        raw = rest or source.read(chunk)
        if not raw:
            if parts:
                raise EOFError("the archive ends within a record")
            return
        parts.append(unpacker.decompress(raw))
        rest = b""
        if unpacker.eof:
            yield b"".join(parts)
            rest, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a record: {version[:20]}")
    named = dict(f.split(": ", 1) if ": " in f else (f.rstrip(":"), "") for f in fields)
    size = int(named["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return named, rest[:size]


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, [payload]) of every record in the files.

    A response's digest and size are taken from its block and must agree with its headers."""

    def row(raw: bytes) -> tuple:
        named, block = parse(raw)
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, size = named["WARC-Payload-Digest"].removeprefix("sha256:"), int(http.rpartition(b" ")[2])
        if named["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError(f"payload of page {named['X-Page-Id']} doesn't match its headers")
        target = named.get("X-Refers-To-Page-Id")
        page, url = named["X-Page-Id"], named.get("WARC-Target-URI")
        return int(page) if page else None, unquote(url) if "X-Quoted-URI" in named else url, size, digest, named["WARC-Type"], None if target is None else int(target), payload if with_payload else None

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in stream:
            for path in batch.column("path").to_pylist():
                rows = []
                with open_read(path) as source:
                    for raw in members(source):
                        rows.append(row(raw))
                        if len(rows) >= (64 if with_payload else 4096):
                            yield made(rows)
                            rows = []
                yield made(rows)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    # a number of parts that adaptive execution leaves alone, so that few files aren't read by one task
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(manifest.select("path").repartition(parts, "path"), batches, schema)


def restored(records: DataFrame) -> DataFrame:
    """records read with_payload, (page_id, url, payload): revisits get their response's payload."""
    # rows of equal page_id and payload are all written whole; one of them stands for all
    responses = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload").alias("original"))
    revisits = records.filter("record_type = 'revisit'").drop("payload").join(responses, ["refers_to", "payload_digest"]).select("page_id", "url", F.col("original").alias("payload"))
    return records.filter("record_type = 'response'").select("page_id", "url", "payload").unionByName(revisits)
