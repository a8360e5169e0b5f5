"""Lines of text files with their places, in batches and as a stream.

Files are cut by byte ranges, so a large file is read by many tasks, and every line
comes with its file and the offset of its first byte. (file, offset) is the order
of a log, whatever reads it: in one task or many, at once or as it grows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, value string"
#: Bytes of a split, and of what is read at a time.
SPLIT, CHUNK = 128 << 20, 1 << 20


class Range(InputPartition):
    """The lines of a file that begin from `begin` to before `end`."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of a file, or of the files of a folder but those whose names begin with _ or a full stop, by name."""
    fs, place = opened(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(place)) if f.type == pafs.FileType.File and f.base_name[0] not in "_."]
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path)}


def last_end(fs: pafs.FileSystem, file: str, begin: int, end: int) -> int:
    """The place after the last line end of a range; begin if there is none."""
    with fs.open_input_file(file) as f:
        while end > begin:
            at = max(begin, end - CHUNK)
            f.seek(at)
            if (found := f.read(end - at).rfind(b"\n")) >= 0:
                return at + found + 1
            end = at
    return begin


def ranges(files: dict[str, tuple[int, int]], split: int) -> list[Range]:
    return [Range(file, at, min(at + split, end)) for file, (begin, end) in files.items() for at in range(begin, end, split)]


def read_range(fs: pafs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in a range; the last one may end beyond it.

    As in text files anywhere, a carriage return ends a line, too.
    """
    with fs.open_input_file(part.file) as f:
        at = max(0, part.begin - 1)
        f.seek(at)
        rest, first = b"", part.begin > 0  # what stands before the first line end belongs to the range before
        while True:
            more = f.read(CHUNK)
            lines = (rest + more).split(b"\n")
            rest = lines.pop() if more else b""  # the file's end ends its last line
            for line in lines:
                if not first:
                    if at >= part.end:
                        return
                    begin = at
                    for piece in line.removesuffix(b"\r").split(b"\r"):
                        yield begin, piece
                        begin += len(piece) + 1
                first = False
                at += len(line) + 1
            if not more or (at >= part.end and not first):
                return


def batches(part: Range, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    fs, _ = opened(part.file)
    offsets: list[int] = []
    values: list[str] = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([part.file] * len(values), pa.string()), pa.array(offsets, pa.int64()), pa.array(values, pa.string())], names=["file", "offset", "value"])
    for offset, line in read_range(fs, part):
        offsets.append(offset)
        values.append(line.decode("utf-8", "replace"))
        if len(values) == rows:
            yield make()
            offsets, values = [], []
    if values:
        yield make()


class LineReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        return ranges({file: (0, n) for file, n in sizes(self.path).items()}, self.split) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition) if partition.file else iter(())


class LineStreamReader(DataSourceStreamReader):
    """Whole lines only: what a writer is still at is read once its end is there. A file may grow, but not shrink."""

    def __init__(self, path: str, split: int):
        self.path, self.split, self.ends = path, split, {}

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.path)
        for file, n in sizes(self.path).items():
            self.ends[file] = last_end(fs, file, self.ends.get(file, 0), n)
        return {"ends": json.dumps({f: n for f, n in sorted(self.ends.items()) if n})}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        begin, upto = json.loads(start["ends"]), json.loads(end["ends"])
        self.ends |= upto
        return ranges({f: (begin.get(f, 0), n) for f, n in upto.items() if n > begin.get(f, 0)}, self.split)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition)


class LineSource(DataSource):
    """spark.read.format("placed_lines"), or readStream: file, offset, value. Options: path, split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "placed_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("split", SPLIT)))

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self.options["path"], int(self.options.get("split", SPLIT)))


def placed_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.read.format("placed_lines").option("path", path).option("split", str(split)).load()


def placed_lines_stream(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(LineSource)
    return spark.readStream.format("placed_lines").option("path", path).option("split", str(split)).load()
