"""A data source of line files: replay files, and broker dumps that grow.

    spark.dataSource.register(LineFiles)
    spark.read.format("line_files").load(folder)          # value, file, position
    spark.readStream.format("line_files").load(folder)

Files are taken in the order of their names, as segments of a log are; only the last one may grow, and it is read up to its
last line end. A batch read is cut into ranges of bytes, so one large file spreads over tasks; a line belongs to the range in
which it begins. A stream's offset is the name of the last file and how far it was read, whatever the number of files; a micro-batch
takes what lies between two offsets, cut into the same ranges. With ``commitPath`` the offset is written to
that file when Spark commits a batch, which is when it plans the next one: a reader elsewhere that starts there gets each
line at least once.

Values go to ``parse_events``. Empty files and empty lines give no rows; a file without a final line end is read whole in a
batch, and up to its last line end in a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file string, position long"
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
LINES_AT_ONCE = 5_000
FIELDS = pa.schema([("value", pa.string()), ("file", pa.string()), ("position", pa.int64())])


class ByteRange(InputPartition):
    """Lines of a file that begin in [start, end)."""

    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/", 1)[0] else Path(uri).absolute().as_uri())


class Folder:
    """The files of a folder by name, and their bytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def sizes(self) -> list[tuple[str, int]]:
        files, path = _opened(self.uri)
        found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        kept = [f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        return sorted((f.base_name, f.size) for f in kept)

    def ranges(self, file: str, start: int, end: int) -> list[ByteRange]:
        step = self.range_bytes
        return [ByteRange(file, a, min(end, a + step)) for a in range(start, end, step)]

    def line_end(self, file: str, start: int, end: int) -> int:
        """Behind the last line end in [start, end), or ``start``."""
        files, path = _opened(self.uri)
        with files.open_input_file(f"{path}/{file}") as source:
            at = end
            while at > start:
                size = min(READ_BYTES, at - start)
                found = source.read_at(size, at - size).rfind(b"\n")
                if found >= 0:
                    return at - size + found + 1
                at -= size
        return start

    def line_begin(self, file: str, start: int, size: int) -> int:
        """Behind the first line end at or after ``start``, or the end of the file."""
        files, path = _opened(self.uri)
        with files.open_input_file(f"{path}/{file}") as source:
            for at in range(start, size, READ_BYTES):
                found = source.read_at(min(READ_BYTES, size - at), at).find(b"\n")
                if found >= 0:
                    return at + found + 1
        return size

    def lines(self, part: ByteRange) -> Iterator[tuple[bytes, int]]:
        """(line, position) of the range, read in pieces of bounded size."""
        files, path = _opened(self.uri)
        with files.open_input_file(f"{path}/{part.file}") as source:
            size = source.size()
            # A line that begins in an earlier range is skipped: its end lies at or behind the byte before this one.
            at = self.line_begin(part.file, part.start - 1, size) if part.start else 0
            rest, read = b"", at
            while at < part.end:
                piece = source.read_at(min(READ_BYTES, size - read), read)
                read += len(piece)
                rest += piece
                *whole, rest = rest.split(b"\n")
                if not piece and rest:
                    whole, rest = [rest], b""
                for line in whole:
                    if at >= part.end:
                        return
                    yield line, at
                    at += len(line) + 1
                if not piece:
                    return

    def batches(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int]] = []
        for line, at in self.lines(part):
            if line.strip():
                held.append((line.decode("utf-8", "replace").rstrip("\r"), part.file, at))
            if len(held) >= LINES_AT_ONCE:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FIELDS.types)], schema=FIELDS)


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[ByteRange]:
        return [r for file, size in self.folder.sizes() for r in self.folder.ranges(file, 0, size)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition) if partition is not None else iter(())  # Spark asks once even of no ranges


class LineStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)
        self.commit_path = options.get("commitPath")

    def initialOffset(self) -> dict:
        return {"file": "", "bytes": 0}

    def latestOffset(self) -> dict:
        sizes = self.folder.sizes()
        if not sizes:
            return self.initialOffset()
        file, size = sizes[-1]
        return {"file": file, "bytes": self.folder.line_end(file, 0, size)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for file, size in self.folder.sizes():
            if start["file"] <= file <= end["file"]:
                first = start["bytes"] if file == start["file"] else 0
                last = end["bytes"] if file == end["file"] else size
                out += self.folder.ranges(file, first, last)
        return out

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition) if partition is not None else iter(())  # Spark asks once even of no ranges

    def commit(self, end: dict) -> None:
        if self.commit_path:
            files, path = _opened(self.commit_path)
            with files.open_output_stream(path) as out:
                out.write(json.dumps(end).encode())


class LineFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)
