"""Capture files (classic pcap, either byte order, micro- or nanoseconds) as packets, by a Python data source that splits large files.

A file is cut every ``split_bytes`` bytes. Records have no marks, so a piece looks for the first place from its cut on where ``HEADS`` record heads in a row fit each
other: lengths within the file's limit and no longer than on the wire, fractions of a second below one, times within a day of each other. Every piece
but the last also looks where the next one will begin, and fails if its own records don't end just there, so packets are neither lost nor read twice; such a file can be
read with ``split_bytes`` 0. Files are opened through Arrow's file systems; for stores that only Spark reads, ``packets_of_files`` takes whole files from Spark's
own reader.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import flows_of, raw_packets

SCHEMA = "path string, offset bigint, ts double, link int, length bigint, data binary"
#: Fixed values of the format: the first bytes of a file, as they stand there, with byte order and parts of a second; size of the file's head and of a record's.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
FILE_HEAD, RECORD_HEAD = 24, 16
ETHERNET = 1
#: Heads in a row that make a place a record's beginning, bytes read at once, packets of a batch, the longest record looked for where a file names no limit.
HEADS, PAGE, BATCH, LONGEST = 16, 1 << 20, 2_000, 262_144
SPLIT_BYTES = 128 << 20
DAY = 86_400


class Head:
    """What the head of a file says."""

    def __init__(self, raw: bytes, path: str):
        if raw[:4] not in MAGIC or len(raw) < FILE_HEAD:
            raise ValueError(f"{path} is no classic capture file")
        self.order, self.parts = MAGIC[raw[:4]]
        limit, link = struct.unpack(self.order + "II", raw[16:24])
        self.limit, self.link = min(limit or LONGEST, LONGEST) if limit < 1 << 31 else LONGEST, link & 0xFFFF
        self.record = struct.Struct(self.order + "IIII")

    def fits(self, raw: bytes, near: int | None) -> tuple[int, int] | None:
        """Second and length of a record whose head this may be."""
        second, part, held, length = self.record.unpack(raw)
        if held > self.limit or held > length or part >= self.parts or near is not None and abs(second - near) > DAY:
            return None
        return second, held


class Bytes:
    """A window over a file that is read in pages."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def take(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, PAGE))
        return self.held[at - self.at : at - self.at + n]


def next_record(b: Bytes, head: Head, at: int) -> int:
    """The first place from ``at`` on where a record begins; the file's size if none does."""
    if at <= FILE_HEAD:
        return FILE_HEAD
    while at + RECORD_HEAD <= b.size:
        place, near = at, None
        for _ in range(HEADS):
            if place == b.size:
                return at
            if place + RECORD_HEAD > b.size or (found := head.fits(b.take(place, RECORD_HEAD), near)) is None:
                break
            near, place = found[0], place + RECORD_HEAD + found[1]
        else:
            return at
        at += 1
    return b.size


def records(file, size: int, path: str, start: int, stop: int) -> Iterator[tuple]:
    """The packets whose records begin in [start, stop), found as the module says. A last record that is cut off isn't read."""
    b = Bytes(file, size)
    head = Head(b.take(0, FILE_HEAD), path)
    at = next_record(b, head, start)
    expected = next_record(b, head, stop) if stop < size else size
    if expected == size:  # the following pieces find no place to begin, as near a last record that is cut off
        stop = size
    while at < stop and at + RECORD_HEAD <= size:
        second, part, held, length = head.record.unpack(b.take(at, RECORD_HEAD))
        if at + RECORD_HEAD + held > size:
            at = size
            break
        yield path, at, second + part / head.parts, head.link, length, b.take(at + RECORD_HEAD, held)
        at += RECORD_HEAD + held
    if stop < size and at != expected:
        raise ValueError(f"{path}: records from {start} on end at {at}, but the next piece would begin at {expected}; read this file with split_bytes 0")


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("ts", pa.float64()), ("link", pa.int32()), ("length", pa.int64()), ("data", pa.binary())])
    page: list[tuple] = []
    for row in rows:
        page.append(row)
        if len(page) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*page, strict=True), kind, strict=True)], schema=kind)
            page = []
    if page:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*page, strict=True), kind, strict=True)], schema=kind)


class Piece(InputPartition):
    def __init__(self, path: str, size: int, start: int, stop: int):
        self.path, self.size, self.start, self.stop = path, size, start, stop


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            cuts = [0, *range(self.split, f.size, self.split), f.size] if self.split else [0, f.size]
            out += [Piece(f.path, f.size, a, z) for a, z in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, piece: Piece):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(piece.path) as f:
            yield from _batches(records(f, piece.size, piece.path, piece.start, piece.stop))


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)


def packets(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The packets of a capture file or of all files below a folder: path, offset, ts (epoch seconds), link, length on the wire, data."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("split_bytes", split_bytes).load(path)


def packets_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The same by Spark's reader of whole files (below 2 GB each), for stores that only it reaches."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = content.as_buffer()
                yield from _batches(records(io.BytesIO(raw), raw.size, path, 0, raw.size))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def capture_flows(found: DataFrame, label: int | None = None, least: int = 3) -> DataFrame:
    """Flows in both directions of the Ethernet packets among ``found`` that have ``least`` packets at least, with the label of their files. Protocols but TCP and
    UDP are one, without ports."""
    p = raw_packets(found.where(F.col("link") == ETHERNET), all_ip=True)
    p = p.withColumn("proto", F.when(F.col("proto").isin(6, 17), F.col("proto")).otherwise(0))
    return flows_of(p, least).withColumn("label", F.lit(label).cast("int"))
