"""WARC: seekable Zstandard bundles with a record index.

`write_warc` turns each row into a WARC/1.1 record. Among rows of equal payloads the one with the
smallest id is a `response`; the others are `revisit` records, which refer to it and carry the HTTP
header only. Records are grouped into Zstandard frames that can be decompressed alone; a bundle ends
with the seek table of the public seekable format (a skippable frame of frame sizes with a footer).
The record index maps every record to its bundle, its frame and its offset inside the frame.
`read_warc` reads whole bundles frame by frame through the seek table; `read_record` fetches one
record by decompressing a single frame.

Bundles are written under names of their own by every task attempt and become part of the archive
only through the index, which Spark commits; a lost or repeated attempt leaves no trace there.

Cases: a null payload counts as empty, and empty payloads are equal to one another unless they are
below `least_bytes`, when all are responses; rows that repeat both the smallest id and the payload
are all responses; a null id is written as `null` and counts as larger than every other; an empty
table gives an archive without bundles; other columns are ignored. A record larger than a frame gets
a frame of its own.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from base64 import b32encode
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybreak.llm.common import scratch, ship, table

SEEK_MAGIC, SKIPPABLE = 0x8F92EAB1, 0x184D2A5E
INDEX = "record_id long, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long"
RECORDS = "record_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column, by built-in functions."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


#: Hadoop's names of stores that Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"a bundle's path has no scheme: {uri}")
    return pa.fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it: one without a scheme is on the default file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()


class BundleWriter:
    """Appends records to one bundle; frames are independent and listed in the closing seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        system, path = _opened(uri)
        self.uri, self.frame_bytes = uri, frame_bytes
        self.out = system.open_output_stream(path, compression=None)
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.held, self.filled, self.written = io.BytesIO(), [], 0

    def add(self, record_id: int | None, record: bytes) -> list[tuple]:
        """Index rows of the frame that this record completes, if it does."""
        done = self.flush() if self.filled and self.held.tell() + len(record) > self.frame_bytes else []
        self.filled.append((record_id, self.held.tell(), len(record)))
        self.held.write(record)
        return done

    def flush(self) -> list[tuple]:
        if not self.filled:
            return []
        raw = self.held.getvalue()
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        rows = [(i, self.uri, len(self.frames), self.written, len(packed), at, n) for i, at, n in self.filled]
        self.frames.append((len(packed), len(raw)))
        self.written += len(packed)
        self.held, self.filled = io.BytesIO(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()
        return rows


def seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of every frame, from the end of the bundle."""
    size = source.size()
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("the bundle has no seek table")
    source.seek(size - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", source.read(8 * count))
    frames, at = [], 0
    for packed, raw in zip(sizes[::2], sizes[1::2]):
        frames.append((at, packed, raw))
        at += packed
    return frames


def build_record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    record_id: int | None
    record_type: str
    refers_to: int | None
    url: str | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def _page(urn: str | None) -> int | None:
    name = urn[len("<urn:page:") : -1] if urn else "null"
    return None if name == "null" else int(name)


def parse_records(raw: bytes) -> Iterator[Record]:
    """The records of a frame. A response's size and digest are taken from its payload as read."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:stop].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]}")
        fields = dict(line.split(": ", 1) for line in lines)
        begin = stop + 4
        end = begin + int(fields["Content-Length"])
        body = raw.index(b"\r\n\r\n", begin, end) + 4
        refers_to = _page(fields.get("WARC-Refers-To"))
        if fields["WARC-Type"] == "response":
            payload = raw[body:end]
            size, digest = len(payload), b32encode(hashlib.sha1(payload).digest()).decode()
            if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest")
        else:
            payload, size = None, int(re.search(rb"\r\nContent-Length: (\d+)", raw[begin:body])[1])
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        yield Record(_page(fields["WARC-Record-ID"]), fields["WARC-Type"], refers_to, fields.get("WARC-Target-URI"), size, digest, payload)
        at = end + 4


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, url, payload, digest, refers_to): refers_to is the response that a revisit repeats, else null.

    One shuffle of narrow rows finds the smallest id of each digest that occurs twice or more, with
    map-side minima; the join on the digest is left to adaptive execution, which splits a digest
    that a third of the rows share.
    """
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    rows = pages.select("record_id", "url", payload.alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    keyed = F.when(F.octet_length("payload") >= least_bytes, F.col("digest"))
    firsts = rows.select("record_id", keyed.alias("key")).where("key is not null").groupBy("key").agg(F.min("record_id").alias("first"), F.count("*").alias("n"))
    repeated = firsts.where("n > 1 and first is not null").select("key", "first")
    joined = rows.withColumn("key", keyed).join(repeated, "key", "left")
    revisit = F.when(F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("record_id", "url", "payload", "digest", revisit.alias("refers_to"))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    least_bytes: int = 0,
    frame_bytes: int = 1 << 20,
    bundle_bytes: int = 64 << 20,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the archive of (record_id, url, payload) rows below `path`; returns its record index, itself a table there."""
    spark = pages.sparkSession
    ship(spark)
    folder = f"{qualified(spark, path)}/bundles"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jvm_path)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, part = None, context.partitionId() if context else 0
        names = ["record_id", "bundle", "frame", "frame_offset", "frame_bytes", "offset", "length"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names)

        for batch in batches:
            for record_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    writer = BundleWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst", frame_bytes, level)
                yield from rows(writer.add(record_id, build_record(record_id, url, payload, digest, refers_to, date)))
                if writer.written >= bundle_bytes:
                    yield from rows(writer.close())
                    writer = None
        if writer is not None:
            yield from rows(writer.close())

    with_references(pages, least_bytes).mapInArrow(bundle, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archive; a revisit has its payload's size and digest, and a null payload."""
    ship(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, file = _opened(uri)
                with system.open_input_file(file) as source:
                    for at, packed, raw in seek_table(source):
                        source.seek(at)
                        found = [x if payloads else x._replace(payload=None) for x in parse_records(codec.decompress(source.read(packed), max_output_size=raw))]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names)

    bundles = spark.read.parquet(f"{path}/index").select("bundle").distinct()
    tasks = min(max(bundles.count(), 1), 50_000)
    return bundles.coalesce(1).repartition(tasks).mapInArrow(unpack, RECORDS)  # dealt in turn from one list of names: a bundle each


def read_record(index: DataFrame, record_id: int) -> Record | None:
    """One record, by its frame alone."""
    place = index.where(F.col("record_id") == record_id).orderBy("bundle", "frame", "offset").first()
    if place is None:
        return None
    system, file = _opened(place.bundle)
    with system.open_input_file(file) as source:
        source.seek(place.frame_offset)
        raw = zstandard.ZstdDecompressor().decompress(source.read(place.frame_bytes))
    return next(parse_records(raw[place.offset : place.offset + place.length]))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("record_id"), "url", F.col("html").alias("payload"))
    path = scratch(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path, payloads=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
