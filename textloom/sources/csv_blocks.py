"""CSV with quoted line breaks, read by many tasks.

A line of a file begins a record only if it does not stand inside quotes, which
depends on every line before.  So the lines of each byte block are looked at twice:
first to find, for both states a block can begin in, the state it ends in and how many
records begin in it; these, one row per block, are carried on through the file.  Then
every block knows its state and its first record's number and puts its own records
together.  Only records that cross the border of a block are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINES = ["source", "block", "at", "line"]
_SUMMARY = "source string, block bigint, ends_0 boolean, ends_1 boolean, begun_0 bigint, begun_1 bigint, bare_0 bigint, bare_1 bigint, crlf boolean"
_RECORDS = "source string, record bigint, block bigint, text string, whole boolean"
# Blocks up to which their states, a row each, are broadcast.
_BROADCAST_BLOCKS = 100_000


def inside_after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether what follows a line stands inside quotes.

    A quote opens at the start of a field only, and two of them stand for one; behind a
    closing quote everything up to the delimiter is text.
    """
    at = 0
    while True:
        if not inside:
            if line[at:at + 1] == '"':
                inside, at = True, at + 1
                continue
            at = line.find(delimiter, at) + 1
            if not at:
                return False
            continue
        at = line.find('"', at) + 1
        if not at:
            return True
        if line[at:at + 1] == '"':
            at += 1
            continue
        inside = False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )


def _in_order(batches: Iterator[pa.RecordBatch], also: int = 0) -> Iterator[tuple]:
    """The rows of a task; a block's lines must come as they stand in the file."""
    key, last = None, -1
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(len(_LINES) + also)]):
            if row[:2] == key and row[2] <= last:
                raise RuntimeError(f"lines of {key} came out of order")
            key, last = row[:2], row[2]
            yield row


def _summaries(lines: DataFrame, delimiter: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, begun, bare, crlf, out = None, None, None, None, False, []

        def result() -> tuple:
            return (*key, *states, *begun, *bare, crlf)

        for source, block, _, line in _in_order(batches):
            if (source, block) != key:
                if key is not None:
                    out.append(result())
                key, states, begun, bare = (source, block), [False, True], [0, 0], [0, 0]
                crlf = line.endswith("\r")
            quoted = '"' in line
            for i in (0, 1):
                if not states[i] and line:
                    begun[i] += 1
                    bare[i] += line == "\r"
                if quoted:
                    states[i] = inside_after(line, states[i], delimiter)
        if key is not None:
            out.append(result())
        names = [f.split()[0] for f in _SUMMARY.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4, pa.bool_()]
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return lines.mapInArrow(run, _SUMMARY)


def _carried(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state and the number of records before each block of one file."""
    blocks = blocks.sort_values("block")
    crlf, inside, before, rows = bool(blocks["crlf"].iloc[0]), False, 0, []
    for b in blocks.itertuples(index=False):
        rows.append((b.source, b.block, inside, before, crlf))
        begun, bare = (b.begun_1, b.bare_1) if inside else (b.begun_0, b.bare_0)
        before += begun - (bare if crlf else 0)
        inside = b.ends_1 if inside else b.ends_0
    return pd.DataFrame(rows, columns=["source", "block", "inside", "before", "crlf"])


def records(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """``source, record, text``: the records of CSV files, their header as record 0, without empty lines.

    Files are UTF-8, with lines ended by a newline or, if the first one is, by a carriage
    return and a newline.  A quote that is never closed makes the rest of its file one record.
    """
    lines = _lines(spark, path)
    blocks = _summaries(lines, delimiter).groupBy("source").applyInPandas(
        _carried, "source string, block bigint, inside boolean, before bigint, crlf boolean"
    )
    few = lines.rdd.getNumPartitions() <= _BROADCAST_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, number, held, out, size = None, False, 0, [], [], 0
        begun_here = False

        def close(ended: bool) -> None:
            nonlocal held, size
            if held:
                text = "\n".join(held)
                out.append((key[0], number, key[1], text, ended and begun_here))
                size += len(text)
                held = []

        def batch_of() -> pa.RecordBatch:
            nonlocal out, size
            columns = list(zip(*out))
            out, size = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                names=["source", "record", "block", "text", "whole"],
            )

        for source, block, _, line, start, before, crlf in _in_order(batches, 3):
            if (source, block) != key:
                close(False)
                key, inside, number, begun_here = (source, block), start, before - 1, False
            if crlf and line.endswith("\r"):
                line = line[:-1]
            if not inside:
                if not line:
                    continue
                number, begun_here = number + 1, True
            held.append(line)
            if '"' in line:
                inside = inside_after(line, inside, delimiter)
            if not inside:
                close(True)
                if size >= 1 << 22:
                    yield batch_of()
        close(False)
        if out:
            yield batch_of()

    known = lines.join(F.broadcast(blocks) if few else blocks, ["source", "block"]).select(*_LINES, "inside", "before", "crlf")
    if not few:
        # Such a join deals the lines out by block, and in any order.
        known = known.sortWithinPartitions("source", "block", "at")
    found = known.mapInArrow(run, _RECORDS)
    parts = F.array_sort(F.collect_list(F.struct("block", "text")))
    crossing = found.where("not whole").groupBy("source", "record").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return found.where("whole").select("source", "record", "text").unionByName(crossing)


def read_csv_blocks(spark: SparkSession, path: str | list[str], columns: list[str], delimiter: str = ",") -> DataFrame:
    """``source, line_idx`` and the text columns of CSV files, each file's header left out.

    Cells are those of Spark's own reader: an empty cell is null, a missing one too.
    """
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    rows = records(spark, path, delimiter).where("record > 0")
    cells = F.from_csv("text", schema, {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return rows.select("source", (F.col("record") - 1).alias("line_idx"), cells.alias("_cells")).select("source", "line_idx", "_cells.*")
