"""WARC records in ZIP-packaged web archives, read by ranges.

A package is a ZIP file whose members are stored without compression: gzip'd WARC records one after another, and an index
with each record's offset and length. The reader parses the central directory (and the ZIP64 one where there is one), finds
the members, and then reads single records by range; nothing is unpacked. It needs only ``read_at(offset, length)``, so a
package may be, as in the query, a file in the shared folder (any store that Arrow opens) or a binary value of a Spark table.

Of records with equal payloads that with the smallest page_id is a response, the others revisit it. A null html is an empty
payload; a null page_id is never the smallest while another is there, and records that share the smallest are all responses.
A null url is an empty target. An empty table makes no package.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, join_split, pieces, read, ship

#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
#: A package is closed when its records take this many bytes.
PACKAGE_BYTES = 8 << 20
#: Bytes that a pass over a whole package reads at a time.
READ_AHEAD = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ReadAt = Callable[[int, int], bytes]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- ZIP ---


def write_zip(members: list[tuple[str, bytes]], zip64: bool | None = None) -> bytes:
    """A ZIP of stored members; zip64 None: 64-bit fields only where a value needs them."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        big = len(data) > 0xFFFFFFFE or at > 0xFFFFFFFE if zip64 is None else zip64
        size = 0xFFFFFFFF if big else len(data)
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(local)) + raw + local + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if big else at) + raw + extra
    start, n = len(out), len(members)
    out += central
    big = n > 0xFFFE or start > 0xFFFFFFFE if zip64 is None else zip64
    if big:
        end64 = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), start)
        out += struct.pack("<IIQI", 0x07064B50, 0, end64, 1)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF if big else n, 0xFFFF if big else n, 0xFFFFFFFF if big else len(central), 0xFFFFFFFF if big else start, 0)
    return bytes(out)


def zip_members(read_at: ReadAt, size: int) -> dict[str, tuple[int, int]]:
    """Name of each stored member and where its data lies (offset, length)."""
    tail_at = max(0, size - 65557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # a comment may hold the mark
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF == n or 0xFFFFFFFF in (length, start):
        mark, _, end64, _ = struct.unpack("<IIQI", read_at(tail_at + end - 20, 20))
        if mark != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        n, length, start = struct.unpack("<QQQ", read_at(end64 + 32, 24))
    directory, at, out = read_at(start, length), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, offset = struct.unpack("<IHHHHHHIIIHHHHHII", directory[at : at + 46])
        if mark != 0x02014B50:
            raise ValueError("broken central directory")
        name, extra = directory[at + 46 : at + 46 + n_name].decode(), directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack("<HH", extra[:4])
            if kind == 1:  # 64-bit values, in this order, of the fields that are full
                wide = [int.from_bytes(extra[j : j + 8], "little") for j in range(4, 4 + k, 8)]
                plain, packed, offset = (wide.pop(0) if x == 0xFFFFFFFF and wide else x for x in (plain, packed, offset))
            extra = extra[4 + k :]
        if method or flags & 1:
            raise ValueError(f"{name} is compressed or encrypted")
        local = read_at(offset, 30)
        out[name] = offset + 30 + sum(struct.unpack("<HH", local[26:30])), packed
        at += 46 + n_name + n_extra + n_note
    return out


# --- WARC ---


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head (with the full payload's length) and no payload."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case), payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}


class Package:
    """Collects records; ``close`` gives the ZIP."""

    def __init__(self) -> None:
        self.data, self.index = bytearray(), []

    def add(self, key: str, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        self.index.append(json.dumps({"key": key, "filename": DATA, "offset": len(self.data), "length": len(packed)}))
        self.data += packed

    def close(self, zip64: bool | None = None) -> bytes:
        return write_zip([(DATA, bytes(self.data)), (INDEX, "\n".join(self.index).encode())], zip64)


def records(read_at: ReadAt, size: int) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of a package, each by one range read at the place its index gives."""
    members = zip_members(read_at, size)
    start, length = members[INDEX]
    for line in read_at(start, length).decode().splitlines():
        at = json.loads(line)
        base, whole = members[at["filename"]]
        if at["offset"] + at["length"] > whole:
            raise ValueError("the index points beyond its member")
        yield parse_record(gzip.decompress(read_at(base + at["offset"], at["length"])))


def value_reader(data: bytes) -> tuple[ReadAt, int]:
    return (lambda at, n: data[at : at + n]), len(data)


def file_reader(path: str, ahead: int = 0) -> tuple[ReadAt, int]:
    """Range reads of a file by its path or URI (file, hdfs, s3, gs and what else Arrow opens); ``ahead``: bytes that a read fetches at least, for a pass over many neighbouring records."""
    system, name = fs.FileSystem.from_uri(path)
    source = system.open_input_file(name)
    size = source.size()
    held, start = b"", 0

    def read_at(at: int, n: int) -> bytes:
        nonlocal held, start
        if not start <= at <= at + n <= start + len(held):
            held, start = source.read_at(min(max(n, ahead), size - at), at), at
        return held[at - start : at - start + n]

    return read_at, size


def _told(pages: DataFrame, least: int) -> DataFrame:
    """pages(page_id, url, html) with refers_to, the response that a page revisits."""
    pages = pages.select("page_id", "url", "html").withColumn("told", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    counted = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least).groupBy(F.col("told").alias("t")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    rows = join_split(pages, Stage(pages.sparkSession, "warc-first").put(counted.where("n > 1")), "told", "t", "n", "left")
    return rows.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")), F.col("first_id")).alias("refers_to"))


def _packages(batches: Iterator[pa.RecordBatch], package_bytes: int) -> Iterator[bytes]:
    """Closed packages of rows (page_id, url, html, refers_to)."""
    package = Package()
    for b in pieces(batches, 200):
        for page_id, url, html, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
            payload = (html or "").encode()
            package.add(f"{page_id}", record_bytes(page_id, url, payload, digest_of(payload), first))
            if len(package.data) >= package_bytes:
                yield package.close()
                package = Package()
    if package.index:
        yield package.close()


def write_packages(pages: DataFrame, least: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Packages (one binary value ``package`` a row) that hold a record for each row of pages(page_id, url, html)."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _packages(batches, package_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["package"])

    return _told(pages, least).mapInArrow(run, "package binary")


def store_packages(pages: DataFrame, stage: Stage, least: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """The same as files in the stage's folder: rows (path, bytes). A task that is run again writes under new names; only files that are listed count."""
    ship(pages.sparkSession)
    folder = f"{stage.base}/packages"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(folder)
        for x in _packages(batches, package_bytes):
            name = f"{uuid.uuid4().hex}.zip"
            system.create_dir(top)
            with system.open_output_stream(f"{top}/{name}") as out:
                out.write(x)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(x)], pa.int64())], names=["path", "bytes"])

    return stage.put(_told(pages, least).mapInArrow(run, "path string, bytes long"))


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit, or all without payloads). packages has rows of ``path``, which are read by range, or of ``package`` values."""
    spark = packages.sparkSession
    ship(spark)
    shape = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    urn = lambda x: int(x[10:-1]) if x and len(x) > 11 else None
    by_path = "path" in packages.columns
    if by_path:  # rows are paths, so Spark cannot deal them by their size: some 64 MB of packages to a task, or one for each core
        told = packages.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        packages = packages.select("path").repartition(max(1, min(told[0], max(spark.sparkContext.defaultParallelism, told[1] >> 26))))
    reader = (lambda x: file_reader(x, READ_AHEAD)) if by_path else value_reader

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                rows, n = [], 0
                for fields, http, payload in records(*reader(value.as_py())):
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    full = fields["warc-type"] == "response"
                    if full and digest_of(payload) != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((urn(fields["warc-record-id"]), fields["warc-target-uri"], len(payload) if full else int(http["content-length"]), digest, fields["warc-type"], urn(fields.get("warc-refers-to")), payload if full and payloads else None))
                    n += len(payload) * payloads + 64
                    if n >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)
                        rows, n = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    return packages.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def check_revisits(found: DataFrame) -> None:
    """Raises unless every digest has a response, and all its records the length that was counted on the response's payload (action; one partial aggregate)."""
    full = F.col("record_type") == "response"
    wrong = found.groupBy("payload_digest").agg(F.max(F.when(full, F.col("payload_bytes"))).alias("told"), F.min("payload_bytes").alias("low"), F.max("payload_bytes").alias("high")).where("told IS NULL OR told <> low OR told <> high")
    if not wrong.isEmpty():
        raise ValueError(f"revisits that do not fit their response: {wrong.first()}")


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "op10")
    files = store_packages(read(spark, sf_dir, "pages"), stage)
    found = stage.put(read_packages(files, payloads=False).drop("url", "payload"))
    check_revisits(found)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_A32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP10_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT h AS t, min(page_id) AS first_id, sha1(h) AS told FROM p GROUP BY h),
d AS (SELECT t, first_id, list_transform(range(0, 8), lambda g: ('0x' || substr(told, 5 * g + 1, 5))::BIGINT) AS parts FROM s),
b AS (SELECT t, first_id, array_to_string(list_transform(parts, lambda x: substr('{_A32}', ((x >> 15) & 31) + 1, 1) || substr('{_A32}', ((x >> 10) & 31) + 1, 1) || substr('{_A32}', ((x >> 5) & 31) + 1, 1) || substr('{_A32}', (x & 31) + 1, 1)), '') AS digest FROM d),
r AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id IS NULL OR page_id > first_id THEN first_id END AS refers_to FROM p JOIN b ON h = t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
