"""Removal of repeated byte strings by a column-wise collection transform.

Windows are cut into runs that share an anchor gram (``anchors``); equal windows lie
in runs with equal anchors, at equal places.  Runs whose anchor is unique hold
nothing repeated.  The others are the documents of small collections, one for each
anchor, aligned at it.  A collection is built column by column from the right: each
round puts one more symbol in front of every document's suffix, which turns the order
of the suffixes (the positional Burrows-Wheeler order) and their common prefixes of
one column into those of the next.  A window is repeated where the suffix that
starts with it shares at least its length with a neighbour.

The transform is kept for one column at a time and for one anchor at a time, in
memory, instead of for all suffixes of all texts in external files: a round costs the
number of documents of the collection, not all symbols inserted so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.anchors import PIECE, Hasher, runs
from textloom.llm.common import kept, row_key, small_batches, whole

WINDOW = 400
GRAM = 128
# An anchor with more different runs is cut again by longer grams.
MOST_VARIANTS = 2048
# Bytes of runs that are transformed in one group.
UNIT_BYTES = 2 << 20
# A run's place is one number: its start, then in 12 bits each where its anchor and its end lie behind that.



def _run_batches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for rows, data, first, last, base in _pieces(texts, window):
                start, stop, anchor, content, place = runs(data, first, last, window, gram, hasher)
                text = np.searchsorted(first, start, "right") - 1
                shift = base[text] - first[text]
                first_byte = (start + shift).astype(np.int64)
                at = (first_byte << 24) | ((place - start) << 12) | (stop - start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[text])), pa.array(anchor.view(np.int64)),
                     pa.array(content.view(np.int64)), pa.array(at)],
                    names=["id", "anchor", "content", "at"],
                )

    return run


def _pieces(texts: list[bytes], window: int):
    """(rows, data, first, last, base): texts side by side in pieces of about PIECE bytes.

    ``base`` is where in its text each begins; a longer text is cut so that every
    window lies in just one of its pieces.
    """
    rows, parts, base, size = [], [], [], 0
    step = PIECE - window + 1

    def packed():
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        last = np.cumsum(lengths)
        return np.array(rows), np.frombuffer(b"".join(parts), dtype=np.uint8), last - lengths, last, np.array(base, dtype=np.int64)

    for row, text in enumerate(texts):
        if len(text) < window:
            continue
        for begin in range(0, len(text) - window + 1, step):
            part = text[begin:begin + PIECE]
            if parts and size + len(part) > PIECE:
                yield packed()
                rows, parts, base, size = [], [], [], 0
            rows.append(row)
            parts.append(part)
            base.append(begin)
            size += len(part)
    if parts:
        yield packed()


def repeated_windows(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, first, last): ranges of starts of repeated windows in the rows (id, content) of ``texts``.

    Runs with one content are counted before anything is gathered, so copies cost
    one row each; only one run of each different content of an anchor is compared.
    """
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(_run_batches(window, gram), f"id {kind}, anchor long, content long, at long")
    variants = found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at")).alias("one")
    )
    shared = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.sum("n").alias("runs")).filter("runs > 1")
    known = kept(variants.join(shared.drop("runs"), "anchor"), "variants")
    copied = found.join(known.filter("n > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "id", F.shiftright("at", 24).alias("first"), (F.shiftright("at", 24) + F.col("at").bitwiseAND(4095) - window).alias("last")
    )
    several = known.filter("variants > 1").select("anchor", "variants", "n", "one.id", "one.at")
    wanted = several.groupBy("id").agg(F.collect_list(F.struct("anchor", "at", "n", "variants")).alias("wanted"))
    cut = kept(
        texts.join(wanted, "id").select("id", "content", "wanted").mapInArrow(
            _cut, f"id {kind}, anchor long, at long, n long, variants long, bytes binary"
        ),
        "runs",
    )
    out = copied.unionByName(_compared(cut.filter(F.col("variants") <= MOST_VARIANTS), kind, window))
    crowded = cut.filter(F.col("variants") > MOST_VARIANTS)
    if gram < window and not crowded.isEmpty():
        inner = repeated_windows(
            crowded.select(F.struct("id", F.shiftright("at", 24).alias("base")).alias("id"), F.col("bytes").alias("content")),
            window, gram + -(-(window - gram) // 2),
        )
        out = out.unionByName(inner.select(
            "id.id", (F.col("first") + F.col("id.base")).alias("first"), (F.col("last") + F.col("id.base")).alias("last")
        ))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for batch in batches:
        for row in range(batch.num_rows):
            text, wanted = batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
            for some in (wanted[i:i + 2000] for i in range(0, len(wanted), 2000)):
                first = [w["at"] >> 24 for w in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([row] * len(some)))]
                    + [pa.array([w[name] for w in some], pa.int64()) for name in ("anchor", "at", "n", "variants")]
                    + [pa.array([text[f:f + (w["at"] & 4095)] for f, w in zip(first, some)], pa.binary())],
                    names=["id", "anchor", "at", "n", "variants", "bytes"],
                )


def _compared(cut: DataFrame, kind: str, window: int) -> DataFrame:
    total = cut.agg(F.sum(F.length("bytes"))).first()[0] or 0
    unit = F.pmod(F.xxhash64("anchor"), F.lit(1 + total // UNIT_BYTES))

    def transform(group: pd.DataFrame) -> pd.DataFrame:
        at = group["at"].to_numpy()
        row, start, stop = repeated_in_collections(
            group["bytes"].tolist(), (at >> 12) & 4095, group["anchor"].to_numpy(), window
        )
        # Copies are settled already; they only stand for comparison.
        single = group["n"].to_numpy()[row] == 1
        row, start, stop = row[single], start[single], stop[single]
        out = group.iloc[row][["id"]].reset_index(drop=True)
        out["first"], out["last"] = (at[row] >> 24) + start, (at[row] >> 24) + stop
        return out

    return cut.groupBy(unit.alias("unit")).applyInPandas(transform, f"id {kind}, first long, last long")


def repeated_in_collections(parts: list[bytes], left: np.ndarray, anchor: np.ndarray, window: int):
    """(part, first, last): ranges of starts in a part whose window also stands in another part of the same anchor.

    ``left`` is where in each part its anchor begins; windows that are compared
    start there or before.
    """
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes + left
    # Order of the parts: by collection, then by the suffix that starts in the current column.
    order = np.argsort(anchor, kind="stable")
    collection = np.empty(len(parts), dtype=np.int64)
    collection[order] = np.cumsum(np.concatenate([[0], anchor[order][1:] != anchor[order][:-1]]))
    common = np.zeros(len(order), dtype=np.int32)  # of a suffix and the one before it
    marks_part, marks_start = [], []
    for column in range(int((sizes - left).max()) - 1, -int(left.max()) - 1, -1):
        if column < 0:
            order, common = _without(order, common, left[order] + column >= 0)
        there = column < (sizes - left)[order]
        symbol = np.zeros(len(order), dtype=np.int64)
        symbol[there] = data[base[order[there]] + column].astype(np.int64) + 1
        key = collection[order] * 257 + symbol
        moved = np.argsort(key, kind="stable")
        common = _next_common(common, moved, key, symbol)
        order = order[moved]
        if column <= 0:
            longest = common.copy()
            longest[:-1] = np.maximum(longest[:-1], common[1:])
            hit = order[longest >= window]
            marks_part.append(hit)
            marks_start.append(left[hit] + column)
    part, start = np.concatenate(marks_part), np.concatenate(marks_start)
    by = np.lexsort((start, part))
    part, start = part[by], start[by]
    fresh = np.ones(len(part), dtype=bool)
    fresh[1:] = (part[1:] != part[:-1]) | (start[1:] != start[:-1] + 1)
    firsts = np.flatnonzero(fresh)
    lasts = np.append(firsts[1:], len(part)) - 1 if len(part) else firsts
    return part[firsts], start[firsts], start[lasts]


def _without(order: np.ndarray, common: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order without some parts; what two others have in common is the least between them."""
    if stay.all():
        return order, common
    places = np.flatnonzero(stay)
    if not len(places):
        return order[:0], common[:0]
    begins = np.concatenate([[0], places[:-1] + 1])
    return order[places], np.minimum.reduceat(common[:places[-1] + 1], begins)


def _next_common(common: np.ndarray, moved: np.ndarray, key: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Common prefixes after a round: one more than the least between both tails, where both got the same symbol."""
    out = np.zeros(len(moved), dtype=np.int32)
    same = np.flatnonzero((key[moved][1:] == key[moved][:-1]) & (symbol[moved][1:] > 0)) + 1
    if len(same):
        pairs = np.stack([moved[same - 1] + 1, moved[same] + 1], axis=1).ravel()
        out[same] = np.minimum.reduceat(np.append(common, 0), pairs)[::2] + 1
    return out


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) per row of ``docs``.

    Every byte of the UTF-8 text that is covered by a string of ``window`` bytes which
    also starts anywhere else, in this or another row, is removed; strings are judged
    on the input.  Null text counts as empty; texts shorter than ``window`` lose
    nothing.  Each row counts as a text of its own, also one that equals another in
    all columns.  Only the two named columns are read; an empty table gives an empty
    table.
    """
    small_batches(docs.sparkSession)
    # Rows that are equal in both columns share an id and, rightly, what is repeated in them.
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.unhex(row_key(doc_id, text)).alias("id"),
        whole(text).cast("binary").alias("content"),
    )
    ranges = repeated_windows(rows.select("id", "content"), window).groupBy("id").agg(
        F.collect_set(F.struct("first", (F.col("last") + window).alias("stop"))).alias("ranges")
    )
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.join(ranges, "id", "left").select("_id", "content", "ranges").mapInArrow(
        _removed, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    ).withColumnRenamed("_id", doc_id)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, spans, left = [], [], [], []
        for content, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            pieces, at, removed, count = [], 0, 0, 0
            reach = -1
            for span in sorted(ranges or [], key=lambda r: (r["first"], r["stop"])):
                if span["first"] > reach:
                    pieces.append(content[at:span["first"]])
                    count += 1
                    begin = span["first"]
                else:
                    begin = reach
                removed += max(0, span["stop"] - begin)
                reach = max(reach, span["stop"])
                at = reach
            pieces.append(content[at:])
            sizes.append(len(content))
            gone.append(removed)
            spans.append(count)
            left.append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(left, pa.binary())],
            names=["_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )
