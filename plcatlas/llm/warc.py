"""WARC archives: written by tasks, read back by a splittable reader.

Method of the reader: a file is cut into byte ranges, one task row each. A task looks for the gzip magic in its range, takes a hit for a record only if
the member decodes and begins with a WARC header, and owns the records that start inside its range; the last one is read beyond the
end of the range. No index is needed, and a range that starts within a record just goes on to the next one.

Archives hold one gzip member a record. Files are written through the file system that the folder's address names, under names that no
other attempt uses; only files of successful tasks are in the manifest, so a lost or repeated task leaves at most a file that nobody reads.

Defined cases: a null page is an empty payload; a null url leaves out the header; a page without an id is a revisit of the smallest id with an equal payload, and a
response if no row with that payload has an id; rows repeated with the smallest id are all responses; an empty table gives no file and no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.llm.common import NO_ID, bounded_batches, map_batches, order_key, written
from plcatlas.session import ensure_checkpoint_dir

FILE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
MOST_TASKS = 100_000  # of a read; beyond it a task takes several ranges, one after the other
PROBE = 1 << 14
# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, bytes long, records long"
RECORD = (
    "path string, offset long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One compressed record: a response, or a revisit of page ``first`` that leaves the payload out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if first is None else head
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"))
    if first is not None:
        fields += [("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", str(first)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(VERSION + lines + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Rows of ``pages`` (ord, url, html) with ``first``: the smallest id with an equal payload, null for responses."""
    keyed = pages.withColumn("same", F.sha2(F.col("html").cast("binary"), 256))
    small = keyed.filter(F.octet_length("html") >= least_bytes).select("ord", "same")
    firsts = small.groupBy("same").agg(F.min("ord").alias("first"))
    later = small.distinct().join(firsts, "same").filter("first < ord")
    return keyed.join(later, ["ord", "same"], "left").select("ord", "url", "html", "first")


def write_archives(
    pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_bytes: int = 0, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes a record a row below ``folder`` and returns the manifest of the files: path, bytes, records."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(
        order_key(id_column).alias("ord"), F.col(url_column).cast("string").alias("url"),
        F.coalesce(F.col(html_column).cast("string"), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        sink, path, size, count = None, "", 0, 0
        for b in batches:
            for ord_, url, html, first in zip(*(c.to_pylist() for c in b.columns)):
                if sink is None:
                    system.create_dir(base, recursive=True)
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    sink, size, count = system.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                data = member(None if ord_ == NO_ID else ord_, url, html.encode(), first)
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    sink.close()
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [count]})
                    sink = None
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "bytes": [size], "records": [count]})

    return written(revisits(rows, least_bytes).mapInArrow(run, MANIFEST))


class Source:
    """Random access to a file with a growing window, for members that go beyond a range."""

    def __init__(self, path: str):
        system, name = open_folder(path)
        self.file = system.open_input_file(name)
        self.size = self.file.size()

    def read(self, at: int, count: int) -> bytes:
        return self.file.read_at(max(0, min(count, self.size - at)), at)


def parse(record: bytes) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of a decoded record; None if it isn't one."""
    end = record.find(b"\r\n\r\n")
    if not record.startswith(b"WARC/1.") or end < 0:
        return None
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(fields.get("content-length", 0))
    return fields, record[end + 4 : end + 4 + length]


def decode_member(source: Source, at: int) -> tuple[bytes, int] | None:
    """The record that starts at ``at`` and the position after its member; None if no record starts there."""
    unpack, out, read = zlib.decompressobj(31), bytearray(), at
    try:
        while not unpack.eof:
            piece = source.read(read, PROBE if read == at else 1 << 20)
            if not piece:
                return None
            out += unpack.decompress(piece)
            read += len(piece)
            if not out.startswith(VERSION[:7]) and len(out) >= 7:
                return None
    except zlib.error:
        return None
    return bytes(out), read - len(unpack.unused_data)


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """The records that start in ``start:end``."""
    source = Source(path)
    window = source.read(start, end - start + len(MAGIC) - 1)
    at = window.find(MAGIC)
    while at >= 0 and start + at < end:
        found = decode_member(source, start + at)
        record = parse(found[0]) if found else None
        if record:
            yield start + at, *record
            at = window.find(MAGIC, found[1] - start) if found[1] < end else -1
        else:
            at = window.find(MAGIC, at + 1)


def read_archives(files: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row a record of the files (path, bytes). Digests are computed from the payloads; revisits carry those of their header."""
    spark = files.sparkSession
    total = files.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 0
    ranges = files.filter("bytes > 0").select(
        "path", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("start")
    ).withColumn("end", F.col("start") + range_bytes)
    # the rows are tiny and the work behind them isn't, so the number of tasks follows the bytes and not the rows
    ranges = ranges.repartition(int(min(max(1, total), MOST_TASKS)), "path", "start")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
            rows, held = [], 0
            for offset, fields, block in records_in(path, start, end):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind, page, other = fields.get("warc-type"), fields.get("x-page-id"), fields.get("x-refers-to-page")
                if kind == "revisit":
                    lengths = [x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    digest, size = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(lengths[0]) if lengths else None
                else:
                    digest, size = base32_sha1(payload), len(payload)
                rows.append((path, offset, kind, int(page) if page else None, fields.get("warc-target-uri"), int(other) if other else None, digest, size, payload if with_payload and kind != "revisit" else None))
                held += len(payload) if with_payload else 64
                if held > 4 << 20:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)

    return map_batches(ranges.select("path", "start", "end"), run, RECORD)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
