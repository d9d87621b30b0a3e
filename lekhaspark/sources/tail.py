"""A growing file of lines as a stream: every whole line once, by byte offsets; a line that is still being written waits for its end.

The offset is the byte after the last line end, so a cut line is never read and never carried in memory: the next batch
begins where it began. A batch is cut into ranges of bytes; a range has the lines that begin in it, so one long append is read by many
tasks. The path may be anything that pyarrow's file systems open (file, hdfs, s3 and so on), on the driver and the executors alike.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 32 << 20
_STEP = 1 << 16


class Range(InputPartition):
    def __init__(self, start: int, end: int, first: bool):
        self.start, self.end, self.first = start, end, first


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    return system.open_input_file(name)


def last_line_end(path: str, after: int = 0) -> int:
    """The byte after the last line end of a file, `after` where there is none later. Reads back from the end of the file, one
    unfinished line at the most."""
    file = _open(path)
    if file is None:
        return after
    with file:
        end = file.size()
        while end > after:
            begin = max(after, end - _STEP)
            file.seek(begin)
            at = file.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return after


def lines_of(path: str, part: Range) -> Iterator[tuple[str, int]]:
    """(line, byte offset) of the lines that begin in a range."""
    with _open(path) as file:
        # a range that does not begin with the batch leaves the line that reaches into it to the range before
        skip = not part.first
        at = part.start - skip
        file.seek(at)
        held, used = b"", 0
        while at < part.end:
            end = held.find(b"\n", used)
            if end < 0:
                more = file.read(_STEP)
                if not more:
                    return
                held, used = held[used:] + more, 0
                continue
            if not skip:
                yield held[used:end].removesuffix(b"\r").decode("utf-8", "replace"), at
            skip = False
            at += end + 1 - used
            used = end + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes, self.end = path, range_bytes, 0

    def initialOffset(self) -> dict:
        return {"byte": 0}

    def latestOffset(self, *args, **kwargs) -> dict:
        self.end = last_line_end(self.path, self.end)
        return {"byte": self.end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.end = max(self.end, end["byte"])
        cuts = [*range(start["byte"], end["byte"], self.range_bytes), end["byte"]]
        return [Range(a, b, a == start["byte"]) for a, b in zip(cuts, cuts[1:])]

    def read(self, partition: Range) -> Iterator[tuple[str, int]]:
        return lines_of(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """Format "lines_tail", options path and range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "lines_tail"

    def schema(self) -> str:
        return "line string, offset long"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (line, offset) of a file that grows; a file that is not there yet has no lines."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("lines_tail").option("range_bytes", str(range_bytes)).load(path)
