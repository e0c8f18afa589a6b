"""WARC archives, index first.

``write_archives`` writes one gzip member per record and returns the index: file,
offset, length, URL and digest of each record.  ``read_records`` takes any selection of the
index, deals it out by stretches of the files, and reads each stretch's
records in order, joining neighbouring byte ranges into one request.

Of records with equal payloads the one with the largest page_id is the
``response``; the others are ``revisit`` records without payload.  Files are written
under names of their own, and only the index of a successful task counts, so a
task that runs again leaves no trace but an unused file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

ARCHIVE_BYTES = 256 << 20  #: after which a task begins another file
STRETCH_BYTES = 32 << 20  #: of a file that one task reads
REQUEST_BYTES, GAP_BYTES = 4 << 20, 64 << 10  #: of one read; between two ranges that are read at once
LEVEL = 3
INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def file_system(uri: str):
    """The file system and path of a URI as Hadoop writes it (``file:/x`` has no host)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id, url: str, kind: str, refers_to, payload: bytes, size: int, digest: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        # a line break in a URL would end the header
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and content of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    content = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(content) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, content


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, sha1, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to"))):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    kind, size, digest = "response" if first is None else "revisit", len(html), digest32(sha1)
                    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = press.compress(record(page_id, url or "", kind, first, html if first is None else b"", size, digest)) + press.flush()
                    out.write(member)
                    rows.append((page_id, url, kind, first, size, digest, f"{folder}/{name}", at, len(member)))
                    at += len(member)
                columns = list(zip(*rows)) or [[]] * 9
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()
    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``folder``; returns the written index.

    A null html is an empty payload, a null url an empty one in the record.  Equal payloads are
    recognised by length and SHA-1.  Rows that share payload and the largest page_id are
    all responses; a null page_id is smaller than any other, and among
    nulls alone all are responses.  Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    pages = pages.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html"))
    # only payloads that occur again travel: html stays with its row as long as their table is small
    again = pages.groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = saved(again.select(F.col("sha1").alias("_sha1"), F.col("size").alias("_size"), "first"), "payloads")
    rows = pages.join(again, (F.col("sha1") == F.col("_sha1")) & (F.col("size") == F.col("_size")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return saved(rows.select("page_id", "url", "html", "sha1", refers.alias("refers_to")).mapInArrow(_write(folder), INDEX), "index")


def _ranges(rows: list) -> Iterator[list]:
    """Runs of (file, offset, length, ..) that one request reads."""
    run: list = []
    for r in rows:
        if run and (r[0] != run[0][0] or r[1] - (run[-1][1] + run[-1][2]) > GAP_BYTES or r[1] + r[2] - run[0][1] > REQUEST_BYTES):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems, source, opened = {}, None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "page_id"))))
            for part in _ranges(rows):
                file, start = part[0][0], part[0][1]
                if file != opened:
                    if source is not None:
                        source.close()
                    folder, _, name = file.rpartition("/")
                    fs, root = systems.get(folder) or systems.setdefault(folder, file_system(folder))
                    source, opened = fs.open_input_file(f"{root}/{name}"), file
                data = source.read_at(part[-1][1] + part[-1][2] - start, start)
                out = []
                for _, offset, length, page_id in part:
                    fields, content = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    refers = None
                    if kind == "revisit":
                        refers = int(fields["WARC-Refers-To"].removeprefix("<urn:page:").rstrip(">"))
                    elif (size, digest) != (len(content), digest := base64.b32encode(hashlib.sha1(content).digest()).decode()):
                        raise ValueError(f"record at {offset} of {file} is damaged")
                    out.append((page_id, fields["WARC-Target-URI"], kind, refers, size, digest, content if payloads and kind == "response" else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
        if source is not None:
            source.close()
    return run


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The selected records: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    payload is null for revisits (and everywhere without ``payloads``); size and digest of a response are those of the
    payload read, and a record that does not match its header is an error.  An empty index gives an empty result.
    """
    rows = index.select("file", "offset", "length", "page_id", F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch"))
    rows = rows.repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return rows.select("file", "offset", "length", "page_id").mapInArrow(
        _read(payloads), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
