"""WARC files read by the length that each record announces.

A data source of one partition a file: records are framed by ``Content-Length``,
so a payload may hold anything, the record separator included. A gzip member is a
frame of its own: a record that announces more than its member holds is truncated,
and reading goes on with the next member.

``read_records`` reads single records at the offset and length that a crawl index
gives, grouped by file.

Files are opened with pyarrow's file systems (local, HDFS, object stores). For a
store that only Spark reads, ``warc.read_warc`` scans files as text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
STRETCH = 64 << 20  # bytes of a file whose picked records one task reads
FIELDS = ("record_id", "rec_type", "url", "content_length", "payload", "reject")
SCHEMA = "warc_file STRING, record_id STRING, rec_type STRING, url STRING, content_length LONG, payload BINARY, reject STRING"
_ARROW = pa.schema(
    [("warc_file", pa.string()), ("record_id", pa.string()), ("rec_type", pa.string()), ("url", pa.string()), ("content_length", pa.int64()), ("payload", pa.binary()), ("reject", pa.string())]
)
_VERSION = re.compile(rb"WARC/1\.[0-9]+\r?\n")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_ENCODED = re.compile(rb"(?i)\n(?:Transfer-Encoding:[^\r\n]*chunked|Content-Encoding:[ \t]*(?:gzip|br|deflate|zstd))")


def _header(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    text = found[1].decode("utf-8", "ignore").strip() if found else ""
    return text or None


def _record(head: bytes, payload: bytes, announced: int | None) -> tuple:
    kind, url = _header(head, b"WARC-Type"), _header(head, b"WARC-Target-URI")
    answer = kind == "response"
    reason = None
    if kind is None:
        reason = "no record type"
    elif answer and url is None:
        reason = "no target"
    elif announced is not None and announced > len(payload):
        reason, payload = "truncated", payload.removesuffix(b"\r\n\r\n")  # what closes a record is none of it
    elif answer and payload.startswith(b"HTTP/") and _ENCODED.search(payload.split(b"\r\n\r\n", 1)[0]):
        reason = "encoded body"
    return _header(head, b"WARC-Record-ID"), kind, url, announced, payload, reason


def frames(data: bytes, last: bool = True) -> tuple[list[tuple], int]:
    """The records at the start of ``data`` and how many bytes they take; with
    ``last`` nothing follows, so what is left is a record cut short. Bytes that open
    no record are skipped up to the next version line, as one reject."""
    found, at = [], 0
    while at < len(data):
        begin = at
        while data[begin : begin + 1] in (b"\r", b"\n"):
            begin += 1
        version = _VERSION.match(data, begin)
        if version is None:
            if not last and len(data) - begin < 16:
                break
            later = _VERSION.search(data, begin)
            if later is None and not last:
                break
            end = later.start() if later else len(data)
            if data[begin:end].strip(b"\r\n"):
                found.append((None, None, None, None, data[begin:end], "no record type"))
            at = end
            continue
        head_end = _HEAD_END.search(data, version.end())
        if head_end is None:
            if not last:
                break
            found.append(_record(data[version.end() :], b"", None))
            at = len(data)
            continue
        head = data[version.end() : head_end.start()]
        length = _header(head, b"Content-Length")
        announced = int(length) if length is not None and length.isdigit() else None
        end = head_end.end() + (announced or 0)
        if end > len(data) and not last:
            break
        found.append(_record(head, data[head_end.end() : end], announced))
        at = min(end, len(data))
    return found, at


def open_file(path: str):
    """A seekable binary file of any file system that pyarrow knows."""
    system, name = pa.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "/", 1))
    return system.open_input_file(name)


def _members(source) -> Iterator[tuple[bytes, bool]]:
    """Decoded bytes, and whether a gzip member (or the file) ends with them."""
    opening = source.read(2)
    if opening != b"\x1f\x8b":
        part = opening + source.read(CHUNK)
        while part:
            coming = source.read(CHUNK)
            yield part, not coming
            part = coming
        return
    unzip, data = zlib.decompressobj(31), opening
    while True:
        if not data:
            data = source.read(CHUNK)
            if not data:
                yield b"", True
                return
        try:
            part = unzip.decompress(data)
        except zlib.error:  # a damaged member; what follows cannot be found
            yield b"", True
            return
        data = b""
        if unzip.eof:
            data = unzip.unused_data.lstrip(b"\0") or source.read(CHUNK)
            yield part, True
            if not data:
                return
            unzip = zlib.decompressobj(31)
        else:
            yield part, False


def file_records(source) -> Iterator[tuple]:
    """All records of an open file, holding one record and a chunk at a time."""
    held, wanted = b"", 0
    parts: list[bytes] = []
    for part, ended in _members(source):
        parts.append(part)
        size = sum(map(len, parts))
        if not ended and size < wanted:
            continue
        held, parts = b"".join(parts), []
        found, used = frames(held, ended)
        yield from found
        rest = held[used:] if not ended else b""
        if rest:
            parts = [rest]
            wanted = max(2 * len(rest), CHUNK)
        else:
            wanted = 0


def _batches(path: str, records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in records:
        rows.append((path, *record))
        size += len(record[4]) + 200
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self._paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(path) for path in self._paths]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        with open_file(partition.path) as source:
            yield from _batches(partition.path, file_records(source))


class WarcSource(DataSource):
    """``spark.read.format("gleaner_warc")``; option ``paths``: one a line."""

    @classmethod
    def name(cls) -> str:
        return "gleaner_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split("\n") if p])


def _finished(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload", F.col("payload").cast("string"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records of WARC files (names, folders or patterns), with the columns of
    ``warc.parse_records``. Names are listed first; the contents are not read for it."""
    listed = spark.read.format("binaryFile").load(paths).select("path")
    names = sorted(r["path"] for r in listed.collect())  # a name a file
    spark.dataSource.register(WarcSource)
    return _finished(spark.read.format("gleaner_warc").option("paths", "\n".join(names)).load())


def read_records(picks: DataFrame, folder: str, filename: str = "filename", offset: str = "offset", length: str = "length") -> DataFrame:
    """The records that ``picks`` names, by file in ``folder``, offset and length.

    Picks are dealt out by stretches of a file, so that one file with many picks is
    read by several tasks, and read in the order of their offsets. A file that is
    missing, or bytes that are no record, give a row with the reason in ``reject``.
    """
    where = picks.select(F.col(filename).alias("filename"), F.col(offset).cast("long").alias("offset"), F.col(length).cast("long").alias("length"))
    where = where.where("filename IS NOT NULL AND offset >= 0 AND length > 0")
    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = where.withColumn("stretch", stretch).repartition("filename", "stretch").sortWithinPartitions("filename", "offset").drop("stretch")
    root = folder.rstrip("/")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, tuple]]:
        name, source = None, None
        for batch in batches:
            for file, begin, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{root}/{file}"
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, None
                    try:
                        source = open_file(path)
                    except FileNotFoundError:
                        pass
                if source is None:
                    yield path, (None, None, None, None, b"", "no file")
                    continue
                source.seek(begin)
                data = source.read(size)
                try:
                    data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                    found, _ = frames(data)
                except zlib.error:
                    found = []
                yield from ((path, record) for record in found or [(None, None, None, None, b"", "no record")])
        if source is not None:
            source.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, record in records(batches):
            yield from _batches(path, iter([record]))

    return _finished(dealt.mapInArrow(run, SCHEMA))
