"""A streaming source of text lines whose offsets are bytes of files.

A micro-batch is all bytes that came since the last one, cut into ranges of stated
size, so one large file is read by many tasks and a file that grows is read on from
where it was.  A line belongs to the range that holds its first byte.  Rows carry the
range and their place in it; ``number_arrived`` turns these into line numbers with the
line counts of earlier ranges.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, block bigint, at bigint, line string"
# A task reads at least and at most so many bytes.
LEAST_BYTES, MOST_BYTES = 1 << 20, 64 << 20
# Opening a file costs about as much as reading so many bytes.
_OPEN_BYTES = 1 << 16
_CHUNK_BYTES = 1 << 20
_BATCH_BYTES = 8 << 20
# Ranges in a batch up to which their line counts, a row each, are broadcast.
_BROADCAST_RANGES = 100_000


@dataclass
class ByteRanges(InputPartition):
    """What one task reads: (path, first byte, end) of one or more ranges."""

    ranges: list[tuple[str, int, int]]


def cut(ranges: list[tuple[str, int, int]], bytes_per_task: int) -> list[list[tuple[str, int, int]]]:
    """Ranges cut to at most ``bytes_per_task``, small ones put together."""
    tasks: list[list[tuple[str, int, int]]] = []
    room = 0
    for path, start, stop in ranges:
        for a in range(start, stop, bytes_per_task):
            b = min(stop, a + bytes_per_task)
            cost = b - a + _OPEN_BYTES
            if not tasks or cost > room:
                tasks.append([])
                room = bytes_per_task + _OPEN_BYTES
            tasks[-1].append((path, a, b))
            room -= cost
    return tasks


def lines_of_range(file, start: int, stop: int, chunk: int = _CHUNK_BYTES) -> Iterator[bytes]:
    """The lines, without their newline, that begin at a byte of [start, stop)."""
    at = start
    if start:
        # A line begins at ``start`` only if the byte before ends another one.
        at = _next_line(file, start - 1, stop, chunk)
        if at is None:
            return
    file.seek(at)
    rest = b""
    while at < stop:
        data = file.read(chunk)
        if not data:
            if rest:
                yield rest
            return
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            if at >= stop:
                return
            yield line
            at += len(line) + 1


def _next_line(file, start: int, stop: int, chunk: int) -> int | None:
    """Where the first line after byte ``start`` begins, if that is before ``stop``."""
    file.seek(start)
    while start < stop:
        data = file.read(chunk)
        if not data:
            return None
        found = data.find(b"\n")
        if found >= 0:
            return start + found + 1 if start + found + 1 < stop else None
        start += len(data)
    return None


def end_of_lines(file, size: int, known: int, chunk: int = _CHUNK_BYTES) -> int:
    """The byte behind the last newline of the first ``size`` bytes, looked for down to ``known``."""
    stop = size
    while stop > known:
        start = max(known, stop - chunk)
        file.seek(start)
        found = file.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return known


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path; one slash after ``file:`` is taken too."""
    local = re.sub("^file:/+", "/", path)
    if local.startswith("/"):
        return fs.LocalFileSystem(), local
    return fs.FileSystem.from_uri(path)


class ByteLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", "")
        self.growing = str(options.get("growing", "false")).lower() == "true"
        self.tasks = int(options.get("tasks", 32))
        self.least, self.most = int(options.get("leastbytes", LEAST_BYTES)), int(options.get("mostbytes", MOST_BYTES))
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_store(self.path)
        found = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = posixpath.relpath(info.path, root)
            hidden = any(part[0] in "._" for part in name.split("/"))
            if info.type == fs.FileType.File and not hidden and name.endswith(self.suffix) and info.size:
                found[name] = info.size if not self.growing else self._complete(store, info.path, name, info.size)
        return {name: end for name, end in found.items() if end}

    def _complete(self, store, path: str, name: str, size: int) -> int:
        looked, end = self.seen.get(name, (0, 0))
        if size > looked:
            with store.open_input_file(path) as file:
                end = end_of_lines(file, size, end)
            self.seen[name] = [size, end]
        return end

    def partitions(self, start: dict, end: dict) -> list[ByteRanges]:
        new = [(name, start.get(name, 0), stop) for name, stop in sorted(end.items()) if stop > start.get(name, 0)]
        total = sum(b - a for _, a, b in new)
        size = max(self.least, min(self.most, -(-total // self.tasks)))
        return [ByteRanges(task) for task in cut(new, size)]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        for name, start, stop in partition.ranges:
            with store.open_input_file(posixpath.join(root, name)) as file:
                held, size, at = [], 0, 0
                for line in lines_of_range(file, start, stop):
                    held.append(line.decode("utf-8", "replace"))
                    size += len(line) + 1
                    if size >= _BATCH_BYTES:
                        yield _rows(name, start, at, held)
                        at, held, size = at + len(held), [], 0
                if held:
                    yield _rows(name, start, at, held)


def _rows(name: str, start: int, at: int, lines: list[str]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * n), pa.array([start] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string())],
        names=["source", "block", "at", "line"],
    )


class ByteLines(DataSource):
    """Format ``byte_lines``; see ``read_line_stream`` for its options."""

    @classmethod
    def name(cls) -> str:
        return "byte_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ByteLinesReader:
        return ByteLinesReader({k.lower(): v for k, v in self.options.items()})


def read_line_stream(
    spark: SparkSession, path: str, suffix: str = "", *, growing: bool = False, least_bytes: int = LEAST_BYTES, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """A stream of ``source, block, at, line`` over the files below a folder, cut at newlines only.

    ``source`` is the file's path below the folder, ``block`` the first byte of the range
    that was read, ``at`` the line's place in it.  A task reads ``least_bytes`` to
    ``most_bytes``, so that four tasks per core share a batch.  Files whose path holds a
    part beginning with ``.`` or ``_`` are not looked at.

    By default a file is whole when it appears, and its last line counts without a
    newline too.  With ``growing``, lines are appended while the stream runs: only what
    a newline ends is read, the rest waits.  The bytes that were read must stay as they are;
    the stream's offset names every file, so it grows with their number as Spark's
    own log of files does.  Paths are local, or of a store that pyarrow can open.
    """
    spark.dataSource.register(ByteLines)
    # Else a run over what is there now stops after one batch, which may be an old one that had failed.
    spark.conf.set("spark.sql.streaming.triggerAvailableNowWrapper.enabled", "true")
    return (
        spark.readStream.format("byte_lines").option("path", path).option("suffix", suffix).option("growing", str(growing).lower())
        .option("tasks", 4 * spark.sparkContext.defaultParallelism).option("leastbytes", least_bytes).option("mostbytes", most_bytes).load()
    )


def line_counts(batch: DataFrame) -> DataFrame:
    """``source, block, n``: the lines of each range of a batch."""
    return batch.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))


def number_arrived(batch: DataFrame, counts: DataFrame) -> DataFrame:
    """``source, line_idx, line``: 0-based line numbers; ``counts`` has those of this and all earlier batches.

    Ranges of a file ascend with its bytes, whichever batch brought them.  What is joined
    is one row per range.
    """
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    if counts.count() <= _BROADCAST_RANGES:
        first = F.broadcast(first)
    return batch.join(first, ["source", "block"]).select("source", (F.col("at") + F.col("_before")).alias("line_idx"), "line")
