"""WARC archives: writing, normalising monolithic gzip files, reading by index.

A monolithic archive is one gzip stream around all its records, so no record
can be read without inflating what stands before it. The normaliser inflates
such a file once, as a stream, rewrites every record as a gzip member of its
own, and writes a side file with the offset and length of each. Readers then
open single members.

Payloads are deduplicated: of records with equal payloads of at least
``least`` bytes the one with the smallest page id is the response; the others
are revisits without a payload whose headers carry its length, digest and the
record that they refer to.

Each attempt of a task writes a file of its own name, and only the rows of
attempts that ended well, kept by a checkpoint, say which files count: a task
that runs again, or twice at once, never touches a file that a reader may have
open. A task holds one record and one stream buffer.

Defined results: a null html is an empty payload; a null URL gives a record
without a target; control characters in a URL are percent-encoded; rows of
equal page id and payload are all responses; a row without a page id is a
revisit if another row has its payload, else a response; an empty table gives
an empty result; extra columns are not read; a very long payload is held once
in memory.
"""

from __future__ import annotations

import atexit
import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import _remove, arrow_schema, cut, narrow, shared_dir

#: Digests that repeat, as a broadcast: some 60 bytes each.
BROADCAST_ROWS = 500_000
DATE = "1970-01-01T00:00:00Z"
BUFFER = 1 << 16
_NO_ID = "00000000-0000-8000-8001-000000000000"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the page id."""
    if page_id is None:
        return f"<urn:uuid:{_NO_ID}>"
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8000-{h[15]}00000000000>"


def page_id_of(record: str) -> int | None:
    u = record.removeprefix("<urn:uuid:").removesuffix(">")
    if u == _NO_ID:
        return None
    a, b, c, _, e = u.split("-")
    n = int(a + b + c[1:] + e[0], 16)
    return n - (1 << 64) if n >> 63 else n


def _clean(url: str) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes([c]) for c in url.encode("utf-8", "replace"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page_id).encode(), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _clean(url))
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + record_id(refers_to).encode()]
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (pafs.LocalFileSystem(), uri)


class _Sink:
    """A file that is written from end to end."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.sink = self.fs.open_output_stream(self.path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.sink.close()


def _headers(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in block.split(b"\r\n")[1:])}


def read_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with their closing lines, of an inflated stream."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(_headers(bytes(held[:end]))[b"content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if bytes(held).strip():
        raise ValueError("the archive ends inside a record")


def inflate(file, buffer: int = BUFFER) -> Iterator[bytes]:
    """Inflated content of a file of one or more gzip members, in pieces."""
    z = zlib.decompressobj(31)
    while data := file.read(buffer):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
                data = data.lstrip(b"\0")
    yield z.flush()


def normalise(source: str, target: str) -> int:
    """Rewrites one archive with a gzip member a record and writes its index,
    lines of (offset, length); returns the number of records."""
    out, index, n = _Sink(target), _Sink(target + ".idx"), 0
    fs, path = _open(source)
    with fs.open_input_file(path) as f:
        for rec in read_records(inflate(f)):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = z.compress(rec) + z.flush()
            index.write(b"%d %d\n" % (out.size, len(member)))
            out.write(member)
            n += 1
    out.close()
    index.close()
    return n


def read_member(file, offset: int, length: int) -> tuple[dict[bytes, bytes], dict[bytes, bytes], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    file.seek(offset)
    rec = zlib.decompress(file.read(length), 31)
    end = rec.index(b"\r\n\r\n")
    warc = _headers(rec[:end])
    block = rec[end + 4 : end + 4 + int(warc[b"content-length"])]
    http_end = block.index(b"\r\n\r\n")
    return warc, _headers(block[:http_end]), block[http_end + 4 :]


def decisions(pages: DataFrame, least: int, key: str, url: str, html: str) -> DataFrame:
    """(id, url, html, first, repeats): first is the smallest id with the
    row's payload; only digests that repeat are joined, as a broadcast while
    they are few. Minima are partial, so a payload that many rows share costs
    no task more than a row from each other."""
    html_col = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = narrow(pages, key, url, html).select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{url}`").alias("url"), html_col.alias("html"))
    digest = F.sha1(F.encode("html", "utf-8"))
    dups = cut(rows.filter(F.octet_length("html") >= least).select("id", digest.alias("digest")).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    few = dups.count() <= BROADCAST_ROWS
    # A payload below ``least`` joins nothing: its key is null.
    keyed = rows.withColumn("digest", F.when(F.octet_length("html") >= least, digest))
    return keyed.join(F.broadcast(dups) if few else dups, "digest", "left").select("id", "url", "html", "first")


def write(pages: DataFrame, out: str, *, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes one monolithic archive a partition; (source) of each."""
    ddl = "source string"
    shape = arrow_schema(pages.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, z, source, part = None, None, "", TaskContext.get().partitionId()
        for rb in batches:
            for x, u, h, first in zip(*(rb.column(k).to_pylist() for k in range(4)), strict=True):
                if sink is None:
                    source = f"{out}/part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    sink, z = _Sink(source), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = h.encode("utf-8", "replace")
                sink.write(z.compress(record(x, u, payload, sha1_base32(payload), first, first is not None and x != first)))
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"source": [source]}, schema=shape)

    return cut(decisions(pages, least, key, url, html).mapInArrow(run, ddl))


def normalised(sources: DataFrame) -> DataFrame:
    """(target, n_records) of each archive of (source), rewritten beside it."""
    ddl = "target string, n_records bigint"
    shape = arrow_schema(sources.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for source in rb.column(0).to_pylist():
                target = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex}.members.warc.gz"
                yield pa.RecordBatch.from_pydict({"target": [target], "n_records": [normalise(source, target)]}, schema=shape)

    return cut(sources.mapInArrow(run, ddl))


def read(targets: DataFrame, key: str = "page_id", key_type: str = "bigint") -> DataFrame:
    """Records of normalised archives, member by member through the index."""
    ddl = f"`{key}` {key_type}, payload_bytes bigint, payload_digest string, record_type string, refers_to {key_type}, url string"
    shape = arrow_schema(targets.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for target in rb.column(0).to_pylist():
                fs, path = _open(target)
                rows: list[tuple] = []
                with fs.open_input_stream(path + ".idx") as f:
                    index = [tuple(map(int, line.split())) for line in f.read().splitlines()]
                with fs.open_input_file(path) as f:
                    for offset, length in index:
                        warc, http, payload = read_member(f, offset, length)
                        revisit = warc[b"warc-type"] == b"revisit"
                        stated = warc[b"warc-payload-digest"].decode().removeprefix("sha1:")
                        if not revisit and sha1_base32(payload) != stated:
                            raise ValueError(f"payload of {warc[b'warc-record-id']!r} differs from its digest")
                        size = int(http[b"content-length"]) if revisit else len(payload)
                        to = page_id_of(warc[b"warc-refers-to"].decode()) if revisit else None
                        uri = warc.get(b"warc-target-uri")
                        rows.append((page_id_of(warc[b"warc-record-id"].decode()), size, stated, "revisit" if revisit else "response", to, None if uri is None else uri.decode()))
                        if len(rows) == 10_000:
                            yield _batch(rows, shape)
                            rows = []
                if rows:
                    yield _batch(rows, shape)

    return targets.mapInArrow(run, ddl)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)


def round_trip(pages: DataFrame, *, least: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes archives to the shared folder, normalises them, reads them back."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, out)
    return read(normalised(write(pages, out, least=least, key=key, url=url, html=html)), key, pages.schema[key].dataType.simpleString())
