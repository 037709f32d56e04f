"""Streaming source over JSON-lines files that are still being written.

An offset is a file name with the number of bytes read, for every file of a folder, so lines appended to a file are
read once, also after a restart. A line counts when its newline is there; what follows the last newline waits. Files only
grow: one that has become shorter, or is gone before its bytes were read, ends the query with an error. Ranges are
dealt to tasks in pieces of bounded size, the ranges of small files together; a line belongs to the piece that its first byte is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE_BYTES = 16 << 20
FILE_BYTES = 1 << 12  # what opening a file counts for, beside its bytes
OPEN_FILES = 32  # files looked at at a time
LOOK_BACK = 1 << 16
_LINE = "file string, position bigint, line string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class Piece(InputPartition):
    """Ranges (file, start, end, limit) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".jsonl")
        self.piece = int(options.get("piecebytes", PIECE_BYTES))
        self.known: dict[str, tuple[int, int]] = {}  # file: size seen, end of its last whole line

    def initialOffset(self) -> dict:
        return {}

    def _whole(self, fs: pafs.FileSystem, path: str, name: str, size: int) -> int:
        """End of the last whole line."""
        before = self.known.get(name)
        if before and before[0] == size:
            return before[1]
        low = before[1] if before else 0
        with fs.open_input_file(f"{path}/{name}") as f:
            end = size
            while end > low:
                start = max(low, end - LOOK_BACK)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    low = start + at + 1
                    break
                end = start
        self.known[name] = (size, low)
        return low

    def latestOffset(self) -> dict:
        fs, path = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        files = sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name.endswith(self.suffix))
        with ThreadPoolExecutor(OPEN_FILES) as pool:
            ends = pool.map(lambda x: self._whole(fs, path, *x), files)
            return {name: end for (name, _), end in zip(files, ends) if end}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        lost = [n for n, at in start.items() if end.get(n, 0) < at]
        if lost:
            raise ValueError(f"files became shorter or are gone: {lost[:5]}")
        out, ranges, load = [], [], 0
        for name, stop in end.items():
            for at in range(start.get(name, 0), stop, self.piece):
                cost = min(self.piece, stop - at) + FILE_BYTES
                if ranges and load + cost > self.piece:
                    out.append(Piece(ranges))
                    ranges, load = [], 0
                ranges.append((name, at, min(at + self.piece, stop), stop))
                load += cost
        return [*out, Piece(ranges)] if ranges else out

    def read(self, partition: Piece) -> Iterator[tuple]:
        fs, path = _open(self.path)
        for part in partition.ranges:
            yield from self._lines(fs, path, *part)

    def _lines(self, fs: pafs.FileSystem, path: str, name: str, start: int, end: int, limit: int) -> Iterator[tuple]:
        with fs.open_input_file(f"{path}/{name}") as f:
            at = max(start - 1, 0)
            f.seek(at)
            data = f.read(end - at)
            if start:  # the line that runs into the piece is its predecessor's
                skip = data.find(b"\n") + 1
                if not skip:
                    return
                at, data = at + skip, data[skip:]
            while data and not data.endswith(b"\n") and end < limit:
                more = f.read(min(LOOK_BACK, limit - end))
                end += len(more)
                data += more[:more.find(b"\n") + 1] or more
                if b"\n" in more:
                    break
        for line in data.split(b"\n")[:-1]:
            if line.strip():
                yield name, at, line.decode("utf-8", "replace")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format ``growing_lines``: file, position and line; options path, suffix, pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return _LINE

    def streamReader(self, schema: T.StructType) -> GrowingReader:
        return GrowingReader(self.options)


def growing_metrics(spark: SparkSession, path: str, schema: T.StructType, suffix: str = ".jsonl") -> DataFrame:
    """Stream of the documents in the ``suffix`` files of a folder as they are appended; lines that are no JSON object give
    NULL columns, as in a JSON scan."""
    spark.dataSource.register(GrowingLines)
    lines = spark.readStream.format("growing_lines").option("path", path).option("suffix", suffix).load()
    return lines.select(F.from_json("line", schema).alias("d")).select("d.*")
