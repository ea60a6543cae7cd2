"""Text lines as a Spark data source: files in planned splits, and as a stream with byte offsets.

`spark.read.format("lines").load(path)` gives (file, split, n, offset, raw): a line
belongs to the split in which it begins, `n` counts from 1 within the split, `offset`
is the byte where it begins. `numbered` makes line numbers of a file from the counts
of its splits, so a file of any size is numbered without one task reading it whole.
The stream takes what was appended up to the last line end, and files that are new.

A path is a file, or a folder of files, of any file system that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

SCHEMA = "file string, split int, n bigint, offset bigint, raw string"
SPLIT_BYTES = 32 << 20
_STEP = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Size by name of the files of a path; names that begin with _ or . are not data."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


class Split(InputPartition):
    def __init__(self, file: str, number: int, start: int, end: int) -> None:
        self.file, self.number, self.start, self.end = file, number, start, end


def _lines(path: str, part: Split) -> Iterator[tuple]:
    """The lines that begin in a split; a task holds a step of bytes and a line."""
    system, _ = _opened(path)
    with system.open_input_file(part.file) as file:
        at = part.start - 1 if part.start else 0  # a line that begins at the start follows a line end
        file.seek(at)
        held, n, skip = b"", 0, part.start > 0
        while True:
            step = file.read(_STEP)
            rows = (held + step).split(b"\n")
            held = rows.pop() if step else b""
            for row in rows:
                if not skip and at < part.end and (step or row):  # the last line may have no end
                    n += 1
                    yield part.file, part.number, n, at, row.removesuffix(b"\r").decode("utf-8", "replace")
                skip, at = False, at + len(row) + 1
                if at >= part.end:
                    return
            if not step:
                return


def _splits(files: dict[str, int], size: int, seen: dict[str, int]) -> list[Split]:
    out = []
    for file, end in sorted(files.items()):
        first = seen.get(file, 0)
        out += [Split(file, k, a, min(a + size, end)) for k, a in enumerate(range(first, end, size))]
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Split]:
        return _splits(_files(self.path), self.size, {}) or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        return _lines(self.path, partition) if partition.file else iter(())


class _StreamReader(DataSourceStreamReader):
    """An offset has, for each file, the bytes up to its last line end."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {file: end for file, size in _files(self.path).items() if (end := self._ended(file, size))}

    def _ended(self, file: str, size: int) -> int:
        """Where the last line end of a file is, from its tail."""
        system, _ = _opened(self.path)
        with system.open_input_file(file) as handle:
            end = size
            while end > 0:
                start = max(0, end - _STEP)
                handle.seek(start)
                found = handle.read(end - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return _splits({f: n for f, n in end.items() if n > start.get(f, 0)}, self.size, start) or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        return _lines(self.path, partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        pass


class LinesSource(DataSource):
    """format("lines"); option `splitBytes` sets the size of a split."""

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return SCHEMA

    def _size(self) -> int:
        return max(1, int(self.options.get("splitBytes", SPLIT_BYTES)))

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"], self._size())

    def streamReader(self, schema: object) -> _StreamReader:  # noqa: N802
        return _StreamReader(self.options["path"], self._size())


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, split, n, offset, raw) of the lines of a path."""
    spark.dataSource.register(LinesSource)
    return spark.read.format("lines").option("splitBytes", split_bytes).load(path)


def stream_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream; `split` and `n` count within what a batch took of a file."""
    spark.dataSource.register(LinesSource)
    return spark.readStream.format("lines").option("splitBytes", split_bytes).load(path)


def numbered(lines: DataFrame) -> DataFrame:
    """(file, line, raw): each line with its number in its file, from the line counts of the splits before."""
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("many"))  # a row for each split
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "split", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("start"))
    return lines.join(starts, ["file", "split"]).select("file", (F.col("start") + F.col("n")).cast("bigint").alias("line"), "raw")
