"""Legacy archives to WARC: ARC records are parsed by version and declared length, then rewritten as WARC records.

``read_arc`` reads ARC files (plain or gzip, version 1 or 2) from a folder; ``convert`` rewrites them as WARC files with
synthesised identifiers, timestamps, types and digests; ``read_warc`` reads such files back by declared lengths.
``pages_to_warc`` first stores a table of pages as ARC files of both versions and then converts those.

Contents are bytes throughout: any charset, compressed or image payloads, line ends and record markers inside them are
never interpreted. Content that starts with ``HTTP/`` becomes a response, its payload follows the first blank line (none:
an empty payload); any other content becomes a resource and is its own payload. Blanks in a URL are allowed, as a line is
split from its right end. Dates of fewer than 14 digits are padded; unreadable ones become 1970. A file of unknown version,
with a damaged line or shorter than declared raises ValueError.

Of responses with equal payloads the one with the largest key is kept, the others are revisits that refer to it and carry
no payload. The key is an HTTP header of the caller's choice, read as an integer, or else date, file and offset of the
record. Payloads below ``least`` bytes are all responses. Null keys rank lowest; where no key of a group is known, or
several records share the largest, all of those are responses. Repeated records are written each.

For pages: a null html is an empty payload, a null url is written as ``about:blank``, blanks and line ends in a URL are
percent-encoded. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.common import BATCH_ROWS, arrow_pass, join_checked
from barloom.session import cut, scratch

# The fields of ARC header lines by version, and formats of both kinds of archive.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.NAMESPACE_URL
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)
#: Bytes after which a written file ends; a file is at most this and one record.
FILE_BYTES = 32 << 20
#: Bytes after which rows of contents are handed on.
BATCH_BYTES = 8 << 20
CHUNK = 1 << 20
PAGE_KEY = "X-Page-Key"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ARC -------------------------------------------------------------------------------------------------------------

@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes
    offset: int = field(default=0, compare=False)


def arc_file(records: list[ArcRecord], version: int, name: str) -> bytes:
    """An ARC file of one version: the file description, then header line and content of each record."""
    about = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    out = io.BytesIO()
    first = ArcRecord(f"filedesc://{name}", "0.0.0.0", "20000101000000", "text/plain", about)
    for record in [first, *records]:
        values = {
            "URL": record.url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D"), "IP-address": record.ip, "Archive-date": record.date,
            "Content-type": record.content_type, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(out.tell()),
            "Filename": name, "Archive-length": str(len(record.content)),
        }
        out.write((" ".join(values[f] for f in ARC_FIELDS[version].split()) + "\n").encode())
        out.write(record.content)
        out.write(b"\n")
    return out.getvalue()


def text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse_arc(data) -> Iterator[ArcRecord]:
    """Records of an ARC file (bytes or a stream); the file description names the version, whose fields every later line has."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    fields, at = None, 0

    def take(length: str) -> bytes:
        content = stream.read(int(length))
        if len(content) < int(length):
            raise ValueError(f"an ARC record of {length} bytes ends after {len(content)}")
        return content

    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        line = line.rstrip(b"\r\n")
        if fields is None:  # both versions end their own description line with the length
            if not line.startswith(b"filedesc:"):
                raise ValueError("an ARC file starts with its description")
            about = take(line.rsplit(b" ", 1)[-1])
            version = int(about.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            fields, at = ARC_FIELDS[version].split(), at + len(about)
            continue
        values = [text_of(v) for v in line.rsplit(b" ", len(fields) - 1)]
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields in an ARC line of {len(fields)}")
        value = dict(zip(fields, values))
        content = take(value["Archive-length"])
        at += len(content)
        yield ArcRecord(value["URL"], value["IP-address"], value["Archive-date"], value["Content-type"], content, start)


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head (with its blank line) and payload; None for content that is no HTTP response."""
    if not content.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", content)
    return (content, b"") if end is None else (content[:end.end()], content[end.end():])


def header_value(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return text_of(found.group(1)).strip() or None if found else None


# --- WARC ------------------------------------------------------------------------------------------------------------

def record_id(key: str) -> str:
    """The same identifier for the same page, so that a repeated task writes the same record."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, key)}>"


def warc_date(date: str) -> str:
    try:
        return datetime.strptime((date + "00000101000000"[len(date):])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def to_warc(arc: ArcRecord, key: str | None, refers_to: str | None = None, place: str = "") -> bytes:
    """A WARC record without its last two line ends; ``refers_to`` is the key of the record that a revisit repeats."""
    http = split_http(arc.content)
    head, payload = http or (b"", arc.content)
    block = arc.content if refers_to is None else head
    kind = "resource" if http is None else "response" if refers_to is None else "revisit"
    headers = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(place if key is None else key), "WARC-Date": warc_date(arc.date),
        "WARC-Target-URI": arc.url, "WARC-IP-Address": arc.ip, "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "Content-Type": arc.content_type if http is None else "application/http; msgtype=response",
        "X-Payload-Length": str(len(payload)),
    }
    if key is not None:
        headers["X-Record-Key"] = key
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Key": refers_to}
    headers["Content-Length"] = str(len(block))
    return (WARC_VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + block


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared length."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = text_of(line).partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record ends before its declared length")
        yield headers, block


class Inflated(io.RawIOBase):
    """Gzip members of a byte string, inflated piece by piece."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.engine, self.ready = memoryview(data), 0, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self.ready:
            if self.engine.eof:
                self.at -= len(self.engine.unused_data)
                self.engine = zlib.decompressobj(31)
            rest = self.engine.unconsumed_tail
            if not rest:
                rest = self.data[self.at:self.at + CHUNK]
                self.at += len(rest)
            if not len(rest):
                return 0
            self.ready = self.engine.decompress(rest, CHUNK)
        taken = self.ready[:len(target)]
        target[:len(taken)], self.ready = taken, self.ready[len(taken):]
        return len(taken)


def opened(data: bytes):
    """A stream over a file's bytes, inflated where they are gzip members."""
    return io.BufferedReader(Inflated(data), CHUNK) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)


# --- Spark -----------------------------------------------------------------------------------------------------------

def in_batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``BATCH_ROWS`` rows, ended early once column ``weight`` holds ``BATCH_BYTES``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def write_files(contents: DataFrame, path: str, ending: str) -> None:
    """One gzip file per row of the binary column ``value``. The text writer puts a string's bytes out as they are."""
    contents.select(F.col("value").cast("string")).write.option("lineSep", ending).option("compression", "gzip").option(
        "maxRecordsPerFile", 1).mode("error").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    # Files are packed into tasks by bytes, so a batch holds no more than a task's share of compressed files.
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, key_header: str | None = None) -> DataFrame:
    """Every record of the ARC files below ``path``: file, offset (of its line, inflated), url, ip, archive_date,
    content_type, content, is_http, record_key (``key_header`` of the HTTP head; without that parameter date, file and
    offset), payload_bytes and payload_digest."""
    schema = pa.schema([
        ("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("archive_date", pa.string()),
        ("content_type", pa.string()), ("content", pa.binary()), ("is_http", pa.bool_()), ("record_key", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ])

    def rows(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1)):
                name = file.as_py()
                for r in parse_arc(opened(data.as_py())):
                    http = split_http(r.content)
                    head, payload = http or (b"", r.content)
                    key = f"{r.date} {name} {r.offset:020d}" if key_header is None else header_value(head, key_header)
                    yield name, r.offset, r.url, r.ip, r.date, r.content_type, r.content, http is not None, key, len(payload), payload_digest(payload)

    return arrow_pass(read_files(spark, path), lambda batches: in_batches(rows(batches), schema, 6), (
        "file string, offset bigint, url string, ip string, archive_date string, content_type string, content binary, "
        "is_http boolean, record_key string, payload_bytes bigint, payload_digest string"))


def convert(spark: SparkSession, source: str, target: str, key_header: str | None = None, least: int = 0) -> None:
    """Rewrite the ARC files below ``source`` as WARC files below ``target``."""
    arcs = read_arc(spark, source, key_header)
    rank = F.col("record_key") if key_header is None else F.expr("try_cast(record_key AS bigint)")
    arcs = arcs.withColumn("__rank", rank).withColumn("__may", F.col("is_http") & (F.col("payload_bytes") >= least))
    # Narrow and reduced before the shuffle: payloads that occur more than once, and the key that stands for each.
    known = cut(arcs.where("__may").groupBy("payload_digest").agg(F.max("__rank").alias("__original"), F.count("*").alias("n")).where(
        "n > 1 AND __original IS NOT NULL").drop("n"), "warc-originals")
    refers = F.when(F.col("__may") & ~F.col("__rank").eqNullSafe(F.col("__original")), F.col("__original").cast("string"))
    joined = join_checked(arcs, known, ["payload_digest"], "left").select(
        "url", "ip", "archive_date", "content_type", "content", "record_key", refers.alias("refers_to"), F.concat_ws(" ", "file", "offset").alias("place"))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for url, ip, date, kind, content, key, refers_to, place in zip(*batch.columns):
                record = to_warc(ArcRecord(url.as_py(), ip.as_py(), date.as_py(), kind.as_py(), content.as_py()), key.as_py(), refers_to.as_py(), place.as_py())
                held.append(record)
                size += len(record)
                if size >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\r\n\r\n".join(held)], pa.binary())], ["value"])

    write_files(arrow_pass(joined, run, "value binary"), target, "\r\n\r\n")


def pages_to_arc(pages: DataFrame, path: str) -> None:
    """Store ``pages`` (page_id, url, html) as ARC files, rows of a task in turn in files of version 1 and 2."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def run(batches):
        held, size, files = {1: [], 2: []}, {1: 0, 2: 0}, 0

        def closed(version):
            data = arc_file(held[version], version, f"pages-{files}.arc")
            held[version], size[version] = [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

        version = 2
        for batch in batches:
            for page, url, html in zip(*batch.columns):
                page, payload, version = page.as_py(), (html.as_py() or "").encode("utf-8", "replace"), 3 - version
                key = "" if page is None else f"{PAGE_KEY}: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{key}\r\n"
                date = (EPOCH + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                held[version].append(ArcRecord(url.as_py() or "about:blank", "0.0.0.0", date, "text/html", head.encode() + payload))
                size[version] += len(payload)
                if size[version] >= FILE_BYTES // 2:
                    yield closed(version)
                    files += 1
        for version in (1, 2):
            if held[version]:
                yield closed(version)
                files += 1

    write_files(arrow_pass(pages, run, "value binary"), path, "\n")


def pages_to_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a WARC record per row of ``pages`` below ``path``, by way of ARC files in the shared folder."""
    source = scratch(pages.sparkSession, "arc")
    pages_to_arc(pages, source)
    convert(pages.sparkSession, source, path, PAGE_KEY, least)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_key, url, record_type, payload_bytes, payload_digest and refers_to (a key) of every record below
    ``path``. Payloads that are present are compared with their digest."""
    names = "record_id record_key url record_type payload_bytes payload_digest refers_to".split()
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in names])

    def rows(batches):
        for batch in batches:
            for data in batch.column(1):
                for headers, block in parse_warc(opened(data.as_py())):
                    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = (split_http(block) or (b"", block))[1]
                    if kind != "revisit" and digest != payload_digest(payload):
                        raise ValueError(f"record {headers['warc-record-id']} is damaged")
                    yield (headers["warc-record-id"], headers.get("x-record-key"), headers.get("warc-target-uri"), kind,
                           int(headers.get("x-payload-length", len(payload))), digest, headers.get("x-refers-to-key"))

    return arrow_pass(read_files(spark, path), lambda batches: in_batches(rows(batches), schema, 0), ", ".join(
        f"{n} {'bigint' if n == 'payload_bytes' else 'string'}" for n in names))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Store ``pages`` as ARC, convert to WARC in the shared folder and read that back, with ids as integers."""
    path = scratch(pages.sparkSession, "warc")
    pages_to_warc(pages, path, least)
    return read_warc(pages.sparkSession, path).select(
        F.col("record_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
