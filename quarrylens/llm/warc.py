"""Operator 1: WARC records in ZIP packages, read by range without extraction.

A package holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member
a record, and ``indexes/index.cdx``, one line a record with its place in the archive.
The reader parses the end record, the ZIP64 locator and end record if there are any, and
the central directory with its ZIP64 fields, finds where a member's bytes start, and
reads only the ranges it needs.

Packages are written to the shared folder under a name of their own for every attempt of
a task, and only those in the saved manifest are read, so a task that is run again leaves
at most an unused file behind.

Defined cases: a null payload is an empty one; rows with equal payloads have one
response, at the largest page_id, and every row with that page_id and payload is a
response; a null page_id is smaller than any other and comes back null; a null url is
left out of the record; repeated rows are records of their own; an empty table gives an
empty result; other columns are ignored.  Payloads are compared by SHA-256 and length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.store import fresh_path, save, shuffle_width

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
GZIP_LEVEL = 3
#: Fixed by the ZIP format: signatures, fixed sizes, and the values that refer to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE = 30, 46, 22, 56, 20
MAX16, MAX32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- records


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    http_headers: dict[str, str]
    payload: bytes


def parse_headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {name.decode().strip().lower(): value.decode("utf-8", "replace").strip() for name, _, value in pairs}


def parse_record(data: bytes) -> Record:
    head, mark, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/") or not mark:
        raise ValueError("not a WARC record")
    headers = parse_headers(head)
    block = rest[: int(headers["content-length"])]
    if len(block) != int(headers["content-length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, parse_headers(http), payload)


# ---------------------------------------------------------------- packages


class PackageWriter:
    """A ZIP of stored members written front to back. ZIP64 fields where sizes ask for them, or always."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at = sink, zip64, 0
        self.members: list[tuple[str, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        import zlib

        crc = size = 0
        for p in parts:
            crc, size = zlib.crc32(p, crc), size + len(p)
        big = self.zip64 or size >= MAX32
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, size, size) if big else b""
        stored = MAX32 if big else size
        self.members.append((name, self.at, size, crc))
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, stored, stored, len(name.encode()), len(extra)) + name.encode() + extra)
        for p in parts:
            self._put(p)

    def close(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            big = self.zip64 or size >= MAX32 or offset >= MAX32
            extra = struct.pack("<HHQQQ", ZIP64_FIELD, 24, size, size, offset) if big else b""
            s, o = (MAX32, MAX32) if big else (size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, s, s, len(name.encode()), len(extra), 0, 0, 0, 0, o) + name.encode() + extra)
        length, count = self.at - start, len(self.members)
        if self.zip64 or start >= MAX32 or count >= MAX16 or length >= MAX32:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, count, count, length, start))
            self._put(struct.pack("<IIQI", LOCATOR64, 0, end64, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, length, start, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int


class PackageReader:
    """Members of a ZIP in any file that has size() and read_at(length, offset)."""

    def __init__(self, source):
        self.source = source
        self.members = {m.name: m for m in self._directory()}

    def _read(self, offset: int, length: int) -> bytes:
        data = bytes(self.source.read_at(length, offset))
        if len(data) != length:
            raise ValueError("a ZIP package is cut short")
        return data

    def _directory(self) -> list[Member]:
        total = self.source.size()
        tail_at = max(0, total - END_SIZE - MAX16)
        tail = self._read(tail_at, total - tail_at)
        at = tail.rfind(struct.pack("<I", END))
        while at >= 0 and (len(tail) - at < END_SIZE or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(struct.pack("<I", END), 0, at)
        if at < 0:
            raise ValueError("not a ZIP package")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if MAX16 == count or MAX32 in (length, start):
            signature, _, end64, _ = struct.unpack("<IIQI", self._read(tail_at + at - LOCATOR_SIZE, LOCATOR_SIZE))
            if signature != LOCATOR64:
                raise ValueError("a ZIP64 locator is missing")
            fields = struct.unpack("<IQHHIIQQQQ", self._read(end64, END64_SIZE))
            if fields[0] != END64:
                raise ValueError("a ZIP64 end record is missing")
            count, length, start = fields[7:]
        directory, members, p = self._read(start, length), [], 0
        for _ in range(count):
            f = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
            if f[0] != CENTRAL:
                raise ValueError("a ZIP directory entry is damaged")
            name_at = p + CENTRAL_SIZE
            name = directory[name_at : name_at + f[10]].decode("utf-8")
            packed, size, header_at = f[8], f[9], f[16]
            extra = directory[name_at + f[10] : name_at + f[10] + f[11]]
            wide = self._wide(extra)
            if size == MAX32:
                size, wide = struct.unpack_from("<Q", wide)[0], wide[8:]
            if packed == MAX32:
                wide = wide[8:]
            if header_at == MAX32:
                header_at = struct.unpack_from("<Q", wide)[0]
            members.append(Member(name, f[4], size, header_at))
            p = name_at + f[10] + f[11] + f[12]
        return members

    @staticmethod
    def _wide(extra: bytes) -> bytes:
        p = 0
        while p + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, p)
            if kind == ZIP64_FIELD:
                return extra[p + 4 : p + 4 + length]
            p += 4 + length
        return b""

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is not stored")
        f = struct.unpack("<IHHHHHIIIHH", self._read(member.header_at, LOCAL_SIZE))
        if f[0] != LOCAL:
            raise ValueError("a ZIP member's header is damaged")
        return member.header_at + LOCAL_SIZE + f[9] + f[10]

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        size = self.members[name].size
        length = size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > size:
            raise ValueError("a range lies outside its member")
        return self._read(self.start(name) + offset, length)


# ---------------------------------------------------------------- on Spark


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows by its URI scheme; plain paths and file: are the shared local file system."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def with_targets(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload) with ``target``, the page_id of the response with an equal payload.

    The target is a partial maximum by digest, joined back to narrow rows; only these meet the payloads.
    """
    digest = F.struct(F.sha2("payload", 256).alias("hash"), F.length("payload").alias("size"))
    rows = pages.select(F.col("page_id"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")).select("page_id", digest.alias("digest"))
    marked = save(rows.select("page_id", F.unhex("digest.hash").alias("hash"), "digest.size"), "page-digests")
    best = marked.groupBy("hash", "size").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
    return marked.join(best.where("n > 1").drop("n"), ["hash", "size"]).where("target IS NOT NULL AND (page_id IS NULL OR page_id < target)").select("page_id", "hash", "target").distinct()


def write_packages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """The saved manifest (package, records) of packages that hold a record per row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "packages")
    targets = with_targets(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    joined = rows.join(targets.select(F.col("page_id").alias("_id"), F.col("hash").alias("_hash"), "target"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.unhex(F.sha2("payload", 256)) == F.col("_hash")), "left")

    def write(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        parts, lines, size = [], [], 0

        def package() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as sink:
                writer = PackageWriter(sink, zip64)
                writer.add(ARCHIVE, parts)
                writer.add(INDEX, ["".join(lines).encode()])
                writer.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(parts)], pa.int64())], ["package", "records"])

        for batch in batches:
            for page_id, url, payload, target in zip(*(c for c in (x.to_pylist() for x in batch.columns))):
                data = gzip.compress(build_record(page_id, url, payload, target, target is not None), GZIP_LEVEL, mtime=0)
                lines.append(f"{'-' if page_id is None else page_id} {size} {len(data)}\n")
                parts.append(data)
                size += len(data)
                if size >= package_bytes:
                    yield package()
                    parts, lines, size = [], [], 0
        if parts:
            yield package()

    manifest = joined.select("page_id", "url", "payload", "target").mapInArrow(write, "package string, records long")
    return save(manifest, "package-manifest").withColumn("package", F.concat(F.lit(scheme_of(folder)), "package"))


def scheme_of(uri: str) -> str:
    """What open_store has taken from the front of a path in this store."""
    _, path = open_store(uri)
    return uri[: len(uri) - len(path)] if uri.endswith(path) else ""


def read_packages(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Indexes are read first and cut into ranges of neighbouring records, which are then
    dealt out, so a large package is read by many tasks.
    """

    def ranges(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                with store.open_input_file(path) as source:
                    entries = [line.split(" ") for line in PackageReader(source).read(INDEX).decode().splitlines()]
                found, start, sizes = [], 0, []
                for _, offset, length in entries:
                    if sizes and sum(sizes) + int(length) > range_bytes:
                        found.append((start, sizes))
                        sizes = []
                    if not sizes:
                        start = int(offset)
                    sizes.append(int(length))
                if sizes:
                    found.append((start, sizes))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], ["package", "start", "sizes"])

    def read(batches):
        for batch in batches:
            for name, start, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = open_store(name)
                with store.open_input_file(path) as source:
                    data = PackageReader(source).read(ARCHIVE, start, sum(sizes))
                rows, at = [], 0
                for size in sizes:
                    rows.append(row_of(parse_record(gzip.decompress(data[at : at + size]))))
                    at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    width = shuffle_width(manifest.sparkSession)
    dealt = manifest.select("package").repartition(width).mapInArrow(ranges, "package string, start long, sizes array<long>").repartition(width)
    return dealt.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def row_of(record: Record) -> tuple:
    """A response's size and digest come from its payload, a revisit's from its headers."""
    kind, stated = record.headers["warc-type"], record.headers["warc-payload-digest"].removeprefix("sha1:")
    url = record.headers.get("warc-target-uri")
    common = (page_of(record.headers["warc-record-id"]), None if url is None else unquote(url))
    if kind == "revisit":
        return (*common, None, int(record.http_headers["content-length"]), stated, kind, page_of(record.headers["warc-refers-to"]))
    digest = sha1_base32(record.payload)
    if digest != stated:
        raise ValueError(f"payload of {record.headers['warc-record-id']} does not match its digest")
    return (*common, record.payload, len(record.payload), digest, kind, None)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write a record per page and read the packages back."""
    return read_packages(write_packages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
h AS (SELECT *, sha1(body) AS hex FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         (list_sum(list_transform(range(5), lambda k: (instr('0123456789abcdef', substr(hex, 1 + 5 * (i // 4) + k, 1)) - 1) * (CAST(pow(16, 4 - k) AS BIGINT))))::BIGINT
          // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM h
"""
