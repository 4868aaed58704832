"""Lines of files that no task holds whole: a data source over byte ranges."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wirelog.schemas import DEFAULT_MAX_LINE

SPLIT_BYTES = 64 << 20
_BLOCK = 1 << 20
_LINES_PER_BATCH = 1 << 14


def framed(file, start: int, end: int, keep: int, block: int = _BLOCK) -> Iterator[tuple[bytes, int, int]]:
    """(first ``keep`` bytes, length, place) of every line that begins in ``[start, end)``.

    A line begins at the file's start and after each line feed. What a line has beyond ``keep`` is
    read and forgotten, so memory is a block and ``keep`` bytes, whatever the line's length.
    """
    place = at = max(start - 1, 0)
    file.seek(at)
    skipping, held, length = start > 0, b"", 0
    while data := file.read(block):
        parts = data.split(b"\n")
        for i, part in enumerate(parts):
            if not skipping:
                if len(held) < keep:
                    held += part[: keep - len(held)]
                length += len(part)
            at += len(part)
            if i + 1 < len(parts):
                if not skipping:
                    yield held, length, place
                at += 1
                skipping, held, length, place = False, b"", 0, at
                if place >= end:
                    return
        if skipping and at >= end:
            return
    if not skipping and length:
        yield held, length, place


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.keep = int(options.get("max_line", DEFAULT_MAX_LINE)) + 2
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def _store(self):
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (
            fs.LocalFileSystem(), self.uri
        )

    def partitions(self) -> list[_Range]:
        store, root = self._store()
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        files = [found]
        if found.type == fs.FileType.Directory:
            files = [
                f for f in store.get_file_info(fs.FileSelector(root, recursive=True))
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
            ]
        return [
            _Range(f.path, start, min(start + self.split, f.size))
            for f in sorted(files, key=lambda f: f.path)
            for start in range(0, f.size, self.split)
        ] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = self._store()

        def batch(lines: list) -> pa.RecordBatch:
            values, lengths, places = zip(*lines)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(values, pa.binary()),
                    pa.array(lengths, pa.int64()),
                    pa.array([partition.path] * len(lines), pa.string()),
                    pa.array(places, pa.int64()),
                ],
                names=["value", "length", "path", "place"],
            )

        lines, size = [], 0
        with store.open_input_file(partition.path) as file:
            for line in framed(file, partition.start, partition.end, self.keep):
                lines.append(line)
                size += len(line[0])
                if len(lines) >= _LINES_PER_BATCH or size > 8 * _BLOCK:
                    yield batch(lines)
                    lines, size = [], 0
        if lines:
            yield batch(lines)


class FramedLines(DataSource):
    """``spark.read.format("framed_lines")``, with ``path``, ``max_line`` and ``split_bytes``.

    Files are opened through pyarrow's file systems (local, HDFS, S3, GCS), not compressed.
    """

    @classmethod
    def name(cls) -> str:
        return "framed_lines"

    def schema(self) -> str:
        return "value binary, length bigint, path string, place bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
