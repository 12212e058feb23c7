"""Sources that Spark has no reader for, as data sources: ``spark.read.format("syslog")`` and ``readStream``.

A collector (UDP or TCP) appends lines to files in a folder; this reads them in byte ranges, so a large file is many
tasks, and a stream goes on where it stopped. Folders may be any address that pyarrow's file systems know.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, at long"
#: Bytes of a file that one task reads.
RANGE_BYTES = 64 << 20
_BLOCK = 1 << 16
#: Bytes of lines that a task hands on at once, about.
_BATCH = 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def _system(folder: str):
    """(file system, path in it) of a folder, which is not listed."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _files(folder: str):
    """(file system, sizes by path) of the files below a folder or of one file; hidden ones don't count."""
    from pyarrow import fs

    system, path = _system(folder)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return system, {f.path: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}


def _ranges(sizes: dict[str, tuple[int, int]], most: int) -> list[Range]:
    return [Range(f, at, min(at + most, end)) for f, (start, end) in sorted(sizes.items()) for at in range(start, end, most)]


def _lines(folder: str, part: Range) -> Iterator[pa.RecordBatch]:
    """Lines that begin in the range, blank ones left out, as Arrow batches; bytes that are no UTF-8 are dropped."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([part.file] * len(texts), pa.string()), pa.array(places, pa.int64())], names=["value", "file", "at"])

    system, _ = _system(folder)
    texts, places, held = [], [], 0
    with system.open_input_file(part.file) as raw:
        file, at = io.BufferedReader(raw, _BLOCK), part.start
        file.seek(at)
        if at:  # a line that began before belongs to the range before
            file.seek(at - 1)
            at = at - 1 + len(file.readline())
            file.seek(at)
        while at < part.end:
            line = file.readline()
            if not line:
                break
            text = line.decode("utf-8", "ignore").rstrip("\r\n")
            if text.strip():
                texts.append(text)
                places.append(at)
                held += len(line)
            at += len(line)
            if held >= _BATCH:
                yield batch()
                texts, places, held = [], [], 0
    if texts:
        yield batch()


def _whole_lines(system, path: str, start: int, size: int) -> int:
    """Where the last line that has an end ends, ``start`` if none does since."""
    with system.open_input_file(path) as file:
        end = size
        while end > start:
            begin = max(start, end - _BLOCK)
            file.seek(begin)
            found = file.read(end - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            end = begin
    return start


class _Reader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Range]:
        _, sizes = _files(self.folder)
        return _ranges({f: (0, n) for f, n in sizes.items()}, self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the bytes read of each file, always at the end of a line."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.seen = folder, most, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        system, sizes = _files(self.folder)
        self.seen = {f: _whole_lines(system, f, min(self.seen.get(f, 0), n), n) for f, n in sorted(sizes.items())}
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges({f: (start.get(f, 0), n) for f, n in end.items() if n > start.get(f, 0)}, self.most)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, partition)


class SyslogSource(DataSource):
    """Lines of a folder that a syslog collector writes: value, file, and the byte at which the line begins.

    Options: ``path``, and ``rangeBytes``, how many bytes one task reads. The last line of a file counts in a batch even if it
    has no end; a stream waits for the end. Files only grow; one that shrinks is an error of the collector.
    """

    @classmethod
    def name(cls) -> str:
        return "syslog"

    def schema(self) -> str:
        return SCHEMA

    def _arguments(self) -> tuple[str, int]:
        folder, most = self.options.get("path"), int(self.options.get("rangeBytes", RANGE_BYTES))
        if not folder or most < 1:
            raise ValueError("syslog needs a path and rangeBytes above 0")
        return folder, most

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._arguments())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(*self._arguments())


def register(spark: SparkSession) -> None:
    """Make the sources known to the session."""
    spark.dataSource.register(SyslogSource)
