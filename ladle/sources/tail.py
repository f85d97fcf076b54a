"""Logs from their end: a data source that reads the last lines of files backwards by blocks, and follows files as a stream.

Batch: each file's last `lines` non-blank lines, one task a file, however long the file is. Stream: a micro-batch is the bytes
that files have grown by since the last one; a line belongs to the batch in which its line break came, so lines that are being
written are not cut. Files are named by `path` (a file, or a folder of files).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 64 << 10
SCHEMA = "file STRING, at BIGINT, line STRING, bytes_read BIGINT"
_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("line", pa.string()), ("bytes_read", pa.int64())])


def _files(path: str) -> list[pafs.FileInfo]:
    """The files of a path, by name; none if there is no such path yet. Names that begin with _ or . are no part of a log."""
    fs, root = _opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.Directory:
        return sorted((i for i in fs.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name[0] not in "_."), key=lambda i: i.path)
    return [info] if info.type == pafs.FileType.File else []


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def last_lines(file: pa.NativeFile, most: int, block: int = BLOCK) -> tuple[list[tuple[int, bytes]], int]:
    """The last non-blank lines of a file with the places where they begin, in their order, and how many bytes were read."""
    end = at = file.size()
    held, found = b"", []
    while at > 0 and len(found) < most:
        size = min(block, at)
        at -= size
        file.seek(at)
        held = file.read(size) + held
        # without the beginning of the file, the first piece may be the end of a longer line
        first = 0 if at == 0 else held.find(b"\n") + 1
        if at > 0 and first == 0:
            continue
        place, lines = at + first, []
        for piece in held[first:].split(b"\n"):
            if piece.strip():
                lines.append((place, piece))
            place += len(piece) + 1
        found, held = lines + found, held[:first]
    return found[len(found) - min(most, len(found)) :], end - at


@dataclass
class Piece(InputPartition):
    """Bytes of a file; the whole file where `start` is None."""

    path: str
    start: int | None
    end: int


def _batch(rows: list[tuple[str, int, bytes, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*((f, at, line.decode("utf-8", "replace").rstrip("\r"), n) for f, at, line, n in rows), strict=True), _ARROW, strict=True)], schema=_ARROW)


class TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most, self.block = options["path"], int(options.get("lines", 100)), int(options.get("block_bytes", BLOCK))

    def partitions(self) -> list[Piece]:
        scheme = self.path[: self.path.index(root)] if (root := _opened(self.path)[1]) in self.path else ""
        return [Piece(scheme + i.path, None, i.size) for i in _files(self.path)] or [Piece("", None, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, name = _opened(partition.path)
        with fs.open_input_file(name) as file:
            lines, n = last_lines(file, self.most, self.block)
        if lines:
            yield _batch([(partition.path, at, line, n) for at, line in lines])


class TailStream(DataSourceStreamReader):
    """Offsets are the sizes of files up to their last line break that has been read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.block = options["path"], int(options.get("block_bytes", BLOCK))
        self.piece = int(options.get("partition_bytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {i.path: i.size for i in _files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        scheme = self.path[: self.path.index(root)] if (root := _opened(self.path)[1]) in self.path else ""
        grown = [(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]
        return [Piece(scheme + p, a, min(a + self.piece, n)) for p, first, n in grown for a in range(first, n, self.piece)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        """The lines whose line breaks stand in the piece; the first of them may have begun before it."""
        fs, name = _opened(partition.path)
        with fs.open_input_file(name) as file:
            begin, held = partition.start, b""
            while begin > 0 and b"\n" not in held:  # back to where that line begins
                size = min(self.block, begin)
                begin -= size
                file.seek(begin)
                held = file.read(size) + held
            if b"\n" in held:
                cut = held.rfind(b"\n") + 1
                begin, held = begin + cut, held[cut:]
            file.seek(partition.start)
            at, left, rows = begin, partition.end - partition.start, []
            while left > 0:
                data = file.read(min(1 << 20, left))
                if not data:
                    break
                left -= len(data)
                *lines, held = (held + data).split(b"\n")
                for line in lines:
                    if line.strip():
                        rows.append((partition.path, at, line, partition.end - partition.start))
                    at += len(line) + 1
                if len(rows) >= 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """spark.read.format("log_tail").option("lines", 100).load(path); readStream follows the files."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailReader:
        return TailReader(self.options)

    def streamReader(self, schema) -> TailStream:
        return TailStream(self.options)
