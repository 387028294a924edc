"""WARC archives in seekable Zstandard bundles.

Every page becomes a record; records are grouped into frames of about FRAME
bytes that are compressed independently, and a footer in each bundle, a
skippable frame in the seekable format of Zstandard, lists the frames' sizes
and checksums. Any Zstandard tool unpacks a bundle to plain WARC, and a reader
that wants one record unpacks one frame: the index, a Parquet table, maps
record identifiers to (bundle, frame, offset in the frame, length).

Pages with equal payloads are found by a shuffled aggregate of their hashes;
the page with the smallest id keeps the payload, the others are revisits that
name it. Bundles are written by the tasks under names of their own, which only
the committed index refers to: what a lost or repeated task leaves is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions

#: Bytes of records in a frame before it is closed, compressed bytes in a bundle.
FRAME, BUNDLE = 1 << 20, 1 << 30
#: Compression level.
LEVEL = 3
#: Payloads of fewer bytes are all kept, even if they repeat.
LEAST_BYTES = 0
#: Date of every record where the pages have none.
DATE = "1970-01-01T00:00:00Z"

# fixed values of the two formats
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Frame(NamedTuple):
    """Place of a frame in its bundle, its sizes and the low half of xxh64 of its content."""

    start: int
    packed: int
    size: int
    checksum: int


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a full URI and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def full_uri(spark: SparkSession, path: str) -> str:
    """path with the scheme that Spark would take for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


class BundleWriter:
    """Frames of whole records in one file, with the seek table at its end."""

    def __init__(self, stream: Any) -> None:
        self.stream = stream
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[Frame] = []
        self.open: list[bytes] = []
        self.filled = 0
        self.written = 0

    def add(self, record: bytes, alone: bool = False) -> tuple[int, int]:
        """Append a record; returns its frame and offset in the frame. alone: in a frame of its own."""
        if self.filled and (alone or self.filled + len(record) > FRAME):
            self._close_frame()
        place = len(self.frames), self.filled
        self.open.append(record)
        self.filled += len(record)
        if alone:
            self._close_frame()
        return place

    def _close_frame(self) -> None:
        content = b"".join(self.open)
        packed = self.compressor.compress(content)
        self.stream.write(packed)
        self.frames.append(Frame(self.written, len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.written += len(packed)
        self.open, self.filled = [], 0

    def close(self) -> None:
        if self.filled:
            self._close_frame()
        table = b"".join(ENTRY.pack(*f[1:]) for f in self.frames) + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(stream: Any) -> list[Frame]:
    """The frames that a bundle's footer lists."""
    size = stream.seek(0, 2)
    stream.seek(size - FOOTER.size)
    count, flags, magic = FOOTER.unpack(stream.read(FOOTER.size))
    if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums at the end of the bundle")
    stream.seek(size - FOOTER.size - count * ENTRY.size)
    frames, start = [], 0
    for entry in ENTRY.iter_unpack(stream.read(count * ENTRY.size)):
        frames.append(Frame(start, *entry))
        start += entry[0]
    return frames


def read_frame(stream: Any, frame: Frame) -> bytes:
    stream.seek(frame.start)
    content = zstandard.ZstdDecompressor().decompress(stream.read(frame.packed), max_output_size=frame.size)
    if len(content) != frame.size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != frame.checksum:
        raise ValueError("a frame differs from its checksum")
    return content


def _head(fields: Iterable[tuple[str, object]]) -> str:
    return "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)


def _uri(url: str | None) -> str | None:
    """url with what would end or break a header line percent-encoded."""
    return url and re.sub("[\0- \x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None, digest: str, place: str) -> str:
    """Identifier of a page's record: by page id and payload, without page id by its place."""
    name = f"page {page_id} {digest}" if page_id is not None else place
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: tuple[int, str | None] | None, own_id: str, date: str) -> bytes:
    """A response record, or a revisit of the page that first names (its id and url)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [
        ("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page_id),
    ]
    if first:
        fields += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], digest, "")),
            ("WARC-Refers-To-Target-URI", _uri(first[1])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", first[0]),
        ]
    return b"".join([f"WARC/1.1\r\n{_head([*fields, ('Content-Length', len(block))])}\r\n".encode(), block, b"\r\n\r\n"])


class Record(NamedTuple):
    """What is in a record: its fields, the payload (None for revisits), its full length."""

    fields: dict[str, str]
    payload: bytes | None
    payload_bytes: int


def parse(content: bytes, at: int = 0) -> tuple[Record, int]:
    """The record that starts at a place, and where the next one starts."""
    end = content.index(b"\r\n\r\n", at)
    version, *lines = content[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("a record does not start with WARC/1.1")
    fields = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(fields["Content-Length"])
    following = start + size + 4
    if fields["WARC-Type"] == "warcinfo":
        return Record(fields, None, 0), following
    body = content.index(b"\r\n\r\n", start) + 4
    length = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", content[start:body])[1])
    if fields["WARC-Type"] == "revisit":
        return Record(fields, None, length), following
    payload = content[body : start + size]
    if base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"].removeprefix("sha1:") or len(payload) != length:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return Record(fields, payload, length), following


_INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def _written(uri: str, date: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(uri)
        stem = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        writer, count, name = None, 0, ""
        for part in portions(batches, "payload", 8 << 20):
            rows = []
            for page in part.to_pylist():
                if writer is None:
                    name, count = f"{stem}-{count:04d}.warc.zst", count + 1
                    writer = BundleWriter(fs.open_output_stream(f"{folder}/{name}", compression=None))
                    info = b"software: dosewise\r\nformat: WARC File Format 1.1\r\n"
                    fields = [
                        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, "", name)), ("WARC-Date", date),
                        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info)),
                    ]
                    writer.add(f"WARC/1.1\r\n{_head(fields)}\r\n".encode() + info + b"\r\n\r\n", alone=True)
                digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
                first = page["first"] and (page["first"]["page_id"], page["first"]["url"])
                own = record_id(page["page_id"], digest, f"{name} {len(writer.frames)} {writer.filled}")
                data = record(page["page_id"], page["url"], page["payload"], digest, first, own, date)
                rows.append((page["page_id"], own, name, *writer.add(data), len(data)))
                if writer.written >= BUNDLE:
                    writer.close()
                    writer = None
            names = [x.split()[0] for x in _INDEX.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if writer is not None:
            writer.close()

    return written


def write_bundles(pages: DataFrame, path: str, date: str = DATE, least_bytes: int = LEAST_BYTES) -> None:
    """Write pages (page_id, url, html, ...) to path/bundles and the index to path/index.

    The payload of a record is the html in UTF-8; null is an empty payload. Of
    equal payloads of at least least_bytes bytes the page with the smallest id is
    the response and the others revisit it. Equality is that of SHA-1, a second
    64-bit hash and the length together. Rows that repeat the smallest id with
    its payload are all responses under one record identifier. Pages without id
    come after those with one: they revisit a page with an id, and are responses
    where there is none. A null url gives no target. A payload longer than a
    frame has a frame of its own (a cell of Spark holds less than 2 GB). An empty
    table writes an empty index. Other columns are ignored.
    """
    spark = pages.sparkSession
    uri = full_uri(spark, f"{path}/bundles")
    fs, folder = file_system(uri)
    fs.create_dir(folder)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    key = ["sha1", "second", "size"]
    rows = rows.withColumns({"sha1": F.sha1("payload"), "second": F.xxhash64("payload"), "size": F.octet_length("payload")})
    one = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    again = rows.where(F.col("size") >= least_bytes).groupBy(*key).agg(F.min(one).alias("first"), F.count("*").alias("times")).where("times > 1")
    named = rows.join(again.drop("times").hint("merge"), key, "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id"))
    named.select("page_id", "url", "payload", "sha1", F.when(other, F.col("first")).alias("first")).mapInArrow(
        _written(uri, date), _INDEX
    ).write.parquet(f"{path}/index")


_FRAMES = "bundle string, frame int, start long, packed long, size long, checksum long"


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames of every bundle in the index, from the bundles' own footers."""
    uri = full_uri(spark, f"{path}/bundles")

    def footers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(uri)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with fs.open_input_file(f"{folder}/{name}") as stream:
                    rows = [(name, i, *f) for i, f in enumerate(seek_table(stream))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), *[pa.int64()] * 4], strict=True)],
                    [x.split()[0] for x in _FRAMES.split(", ")],
                )

    return index(spark, path).select("bundle").distinct().mapInArrow(footers, _FRAMES)


def index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_id, bundle, frame, offset and length of every record."""
    return spark.read.schema(_INDEX).parquet(f"{path}/index")


_RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string"


def _record_row(r: Record) -> tuple:
    f = r.fields
    number = lambda name: int(f[name]) if name in f else None
    return (
        number("Page-ID"), f.get("WARC-Target-URI"), f["WARC-Type"], r.payload_bytes, f["WARC-Payload-Digest"].removeprefix("sha1:"),
        number("Refers-To-Page-ID"), f["WARC-Record-ID"],
    )


def _batch(rows: list[tuple], payloads: list[bytes | None] | None) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    if payloads is not None:
        columns, names = [*columns, pa.array(payloads, pa.binary())], [*names, "payload"]
    return pa.RecordBatch.from_arrays(columns, names)


def _read(uri: str, payload: bool, places: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of the frames of the batches; places: only those at the offsets given."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(uri)
        last, content = None, b""
        for batch in batches:
            for row in batch.to_pylist():
                if (row["bundle"], row["frame"]) != last:
                    last = row["bundle"], row["frame"]
                    with fs.open_input_file(f"{folder}/{row['bundle']}") as stream:
                        content = read_frame(stream, Frame(*(row[x] for x in Frame._fields)))
                at, found = row["offset"] if places else 0, []
                end = at + 1 if places else len(content)
                while at < end:
                    one, at = parse(content, at)
                    if one.fields["WARC-Type"] != "warcinfo":
                        found.append(one)
                if found:
                    yield _batch(list(map(_record_row, found)), [r.payload for r in found] if payload else None)

    return read


def read_bundles(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records of the bundles written to path, parsed frame by frame.

    page_id, url, record_type (response or revisit), payload_bytes and
    payload_digest (base32 SHA-1) of the full payload, refers_to (page of the
    response), record_id and, if asked for, the payload (null for revisits).
    Payloads are compared with their digests, frames with their checksums.
    """
    schema = _RECORDS + (", payload binary" if payload else "")
    rows = frames(spark, path).repartition("bundle", "frame")
    return rows.mapInArrow(_read(full_uri(spark, f"{path}/bundles"), payload, False), schema)


def find_records(spark: SparkSession, path: str, pages: DataFrame) -> DataFrame:
    """The records of the pages named by pages (page_id), each read at its offset in
    its frame; only frames that hold one of them are unpacked."""
    wanted = index(spark, path).join(pages.select("page_id").distinct(), "page_id", "left_semi")
    rows = wanted.select("bundle", "frame", "offset").distinct().join(frames(spark, path), ["bundle", "frame"])
    rows = rows.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return rows.mapInArrow(_read(full_uri(spark, f"{path}/bundles"), True, True), _RECORDS + ", payload binary")
