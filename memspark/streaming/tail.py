"""A growing JSONL file as a stream by byte offset, and a sink that keeps every batch once.

The source's offset is the place after the last whole line, so a line that is still being written waits. A batch is the bytes
between two offsets, cut into ranges that tasks read for themselves; a line belongs to the range that its first byte is in.
The sink writes a batch into a folder of its number: a batch that runs again after a crash replaces its own rows. With
the offsets in the stream's checkpoint no line is lost or counted twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from ..storage import filesystem

#: Bytes of one task's range, and of one look backwards for the end of the last whole line.
RANGE_BYTES, LOOK = 64 << 20, 1 << 16


@dataclass
class Range(InputPartition):
    """Bytes [start, stop) of a file; first: whether a line begins at start."""

    start: int
    stop: int
    first: bool


def whole(path: str) -> int:
    """The place after the last line that has ended; 0 if there is none."""
    files, where = filesystem(path)
    if files.get_file_info(where).type.name != "File":
        return 0
    with files.open_input_file(where) as f:
        end = f.size()
        while end > 0:
            begin = max(0, end - LOOK)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return 0


def lines(path: str, part: Range) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that begin in a range."""
    files, where = filesystem(path)
    with files.open_input_file(where) as f:
        at = part.start
        if not part.first:  # the line that the byte before belongs to is another range's
            f.seek(at - 1)
            at += len(until_end(f)) - 1
        f.seek(at)
        while at < part.stop:
            line = until_end(f)
            if not line:
                return
            yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)


def until_end(f) -> bytes:
    """Bytes up to and with the next line end; the file stands after it."""
    out, start = b"", f.tell()
    while True:
        got = f.read(LOOK)
        at = got.find(b"\n")
        if at >= 0:
            out += got[: at + 1]
            f.seek(start + len(out))
            return out
        out += got
        if not got:
            return out


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": whole(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        cuts = [*range(start["at"], end["at"], self.range_bytes), end["at"]]
        return [Range(a, b, i == 0) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def read(self, partition: Range) -> Iterator[tuple[int, str]]:
        return lines(self.path, partition)


class Tail(DataSource):
    """Format `tail`: the lines of a growing file (option path; range_bytes) with their offsets."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "offset bigint, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def tailed(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """offset, line of a growing file, as a stream."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").option("path", path).option("range_bytes", range_bytes).load()


def keep_once(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived into root, a folder for each batch; the query ends when all is written."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
