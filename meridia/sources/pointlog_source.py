"""The point log as a data source of its own: byte ranges of files as partitions, and a stream that
follows growing files by their offsets.

    spark.dataSource.register(PointLog)
    spark.read.format("pointlog").option("path", folder).load()

Rows are vehicle, signal, ts_us, value, ok, line (as ``pointlog.parse_points``, whose rules they share), file
and at, the line's first byte. Lines that can't be read stay, with ok false. A line belongs to the
range in which it begins, so files are split anywhere; a stream takes a file up to its last line
end and goes on from there, so a line that is still being written is never cut. Ranges have
``range_bytes`` (32 MB) at most; offsets are one number for each file.

Defined results: blank lines and comments are left out; bytes that are no UTF-8 make a line that can't be
read; a last line without an end counts in a batch and waits in a stream; an empty folder gives
no rows. A file that shrinks or goes between two batches of a stream is an error, as its rows are lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .pointlog import LINE

SCHEMA = "vehicle string, signal string, ts_us long, value double, ok boolean, line string, file string, at long"
_LINE, _SKIP = re.compile(LINE, re.ASCII), re.compile(r"^\s*(#.*)?$", re.ASCII)
#: Numbers as Spark casts them; Python reads others too (1_000).
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?|[+-]?(infinity|inf)|nan", re.IGNORECASE | re.ASCII)
_ROWS, _CHUNK = 4000, 1 << 16


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def sizes(uri: str) -> dict[str, int]:
    """Bytes of each file below a folder, or of the one file."""
    system, path = _place(uri)
    info = system.get_file_info(path)
    if info.type == pafs.FileType.File:
        return {path: info.size}
    found = system.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}


def number(text: str) -> float | None:
    if not _NUMBER.fullmatch(text):
        return None
    return float(text.rstrip("fFdD") if text[-1] in "fFdD" and not text.lower().endswith("inf") else text)


def parsed(raw: bytes) -> tuple | None:
    """(vehicle, signal, ts_us, value, ok, line), or None for what is left out."""
    line = raw.decode("utf-8", "replace").removesuffix("\r")
    if _SKIP.match(line):
        return None
    m = _LINE.match(line) if "\ufffd" not in line else None
    value = number(m[4]) if m else None
    if m is None or value is None or not -(1 << 63) <= int(m[3]) < 1 << 63:
        return None, None, None, None, False, line
    return m[1], m[2], int(m[3]), value, True, line


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def _ranges(file: str, begin: int, end: int, width: int) -> list[Range]:
    n = max(1, math.ceil((end - begin) / width))
    cuts = [begin + (end - begin) * k // n for k in range(n + 1)]
    return [Range(file, a, z) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def _lines(system: pafs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that begin in the range; the last may end after it."""
    with system.open_input_file(part.file) as source:
        # a line begins here only if the byte before ends one
        at = max(0, part.begin - 1)
        source.seek(at)
        held, skip = b"", part.begin > 0
        while True:
            chunk = source.read(_CHUNK)
            held += chunk
            *whole, held = held.split(b"\n")
            for line in whole:
                if not skip:
                    if at >= part.end:
                        return
                    yield at, line
                at, skip = at + len(line) + 1, False
            if not chunk:
                if held and not skip and at < part.end:
                    yield at, held
                return
            if skip and at >= part.end:
                return


def _read(uri: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = _place(uri)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.int64())
    held: list[tuple] = []
    batch = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for at, raw in _lines(system, part):
        if (row := parsed(raw)) is not None:
            held.append((*row, part.file, at))
            if len(held) == _ROWS:
                yield batch()
                held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width

    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(sizes(self.uri).items()) for r in _ranges(file, 0, size, self.width)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, width: int):
        self.uri, self.width = uri, width

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _place(self.uri)
        return {file: self._last_end(system, file, size) for file, size in sizes(self.uri).items()}

    @staticmethod
    def _last_end(system: pafs.FileSystem, file: str, size: int) -> int:
        """The place behind the file's last line end."""
        with system.open_input_file(file) as source:
            end = size
            while end > 0:
                begin = max(0, end - _CHUNK)
                source.seek(begin)
                if (k := source.read(end - begin).rfind(b"\n")) >= 0:
                    return begin + k + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if lost := [f for f, at in start.items() if end.get(f, 0) < at]:
            raise ValueError(f"files shrank or went: {lost[:5]}")
        return [r for file, z in sorted(end.items()) for r in _ranges(file, start.get(file, 0), z, self.width)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class PointLog(DataSource):
    """Source ``pointlog``: options ``path`` and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "pointlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("range_bytes", 32 << 20)))

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("range_bytes", 32 << 20)))
