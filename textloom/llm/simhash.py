"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two halves.  Fingerprints that differ in at most three
bits differ in at most one bit of one half, so each half is indexed with each of
its bits left out in turn; equal variants meet in a shuffle and are verified.
Links between different fingerprints are joined into components on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import ascii_lower, kept, row_key, shuffled, small_batches, whole, whole_rows
from textloom.llm.components import components

SHINGLE = 3
MAX_BITS = 3
HALF = 32
# Fingerprints of one variant that are compared in one unit of work.
BLOCK = 4096
# Variants of up to so many fingerprints are compared side by side.
_NARROW = 16
_BITS_AT_ONCE = 1 << 17


def shingle_hashes(text: str, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of all words if they are fewer."""
    words = F.filter(F.split(ascii_lower(whole(text)), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    # The words are named first, so that each shingle does not split the text again.
    return F.transform(F.array(words), lambda w: F.transform(
        F.when(F.size(w) == 0, F.array().cast("array<int>"))
        .otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (size - 1)))),
        lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " ")),
    ))[0]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row its fingerprint: bits set in over half of its hashes; zero for a row without any."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    stops = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        # As many rows as fit in a chunk, one at least; a longer one is summed in parts.
        base = stops[row] - lengths[row]
        last = max(row + 1, int(np.searchsorted(stops, base + _BITS_AT_ONCE, "right")))
        filled = np.flatnonzero(lengths[row:last]) + row
        if len(filled) == 1:
            part = hashes[base:stops[last - 1]]
            counts = sum(
                (_unpacked(part[at:at + _BITS_AT_ONCE]).sum(axis=0, dtype=np.int64) for at in range(0, len(part), _BITS_AT_ONCE)),
                np.zeros(64, dtype=np.int64),
            )[None, :]
        elif len(filled):
            counts = np.add.reduceat(
                _unpacked(hashes[base:stops[last - 1]]), stops[filled] - lengths[filled] - base, axis=0, dtype=np.int32
            )
        if len(filled):
            majority = counts * 2 > lengths[filled][:, None]
            out[filled] = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]
        row = last
    return out


def _unpacked(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        hashes = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
        bits = majority_bits(hashes, np.diff(offsets))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(bits.view(np.int64), pa.int64())], names=["own", "fingerprint"]
        )


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(_id, row_key, fingerprint as a signed long) per row; zero for a null, empty or wordless text."""
    small_batches(docs.sparkSession)
    own = F.struct(F.col(doc_id).alias("_id"), row_key(doc_id, text).alias("row_key")).alias("own")
    rows = docs.select(own, shingle_hashes(text, shingle).alias("hashes"))
    kind = rows.schema["own"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"own {kind}, fingerprint long").select("own._id", "own.row_key", "fingerprint")


def near_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, row_key, fingerprint as a long, component_id, keeper).

    ``component_id`` is the smallest id that is reached over links of at most
    ``max_bits`` (up to 3) differing bits, the row's own included; ``keeper`` is the
    row_key of the row that has it.  Texts without words have fingerprint zero, which
    links like any other.  Repeated rows and ids each keep their row; null ids come
    last, so ``component_id`` is only null where a component has no other.  Only the
    two named columns are read; an empty table gives an empty table.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with one left-out bit find up to 3 differing bits")
    rows = kept(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(
        F.min(F.struct(F.col("_id").isNull().alias("unnamed"), "_id", "row_key")).alias("first")
    )
    found = components(links(nodes.select("fingerprint"), max_bits))
    placed = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    first = placed.groupBy("root").agg(F.min("first").alias("first"))
    named = placed.select("fingerprint", "root").join(first, "root").select("fingerprint", "first")
    return shuffled(rows).join(named, "fingerprint").select(
        F.col("_id").alias(doc_id), rows["row_key"], "fingerprint",
        F.col("first._id").alias("component_id"), F.col("first.row_key").alias("keeper"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, all columns kept.

    Of rows equal in id and text one stays, the least by the other columns.
    """
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    keepers = near_components(docs, **options).filter("row_key = keeper").select(F.col("row_key").alias("whole_key")).distinct()
    chosen = whole_rows(docs, doc_id, text).join(keepers, "whole_key", "left_semi")
    least = Window.partitionBy("whole_key").orderBy("whole_row")
    return chosen.withColumn("place", F.row_number().over(least)).filter("place = 1").select("whole_row.*")


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): pairs of different fingerprints within ``max_bits`` that join the same components as all such pairs.

    A variant that many fingerprints share is cut into blocks, and a unit of work
    is a pair of blocks; no unit grows with the variant.
    """
    halves = (F.col("fingerprint").bitwiseAND(F.lit((1 << HALF) - 1)), F.shiftrightunsigned("fingerprint", HALF))
    # Above, the number of the half and of the bit; below, the half without that bit.
    variants = [
        half.bitwiseAND(F.lit(((1 << HALF) - 1) & ~(1 << bit))).bitwiseOR(F.lit((number * HALF + bit) << HALF))
        for number, half in enumerate(halves) for bit in range(HALF)
    ]
    # Each row becomes 64, so a few rows must not share a task.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    indexed = nodes.repartition(parts, "fingerprint").select("fingerprint", F.explode(F.array(*variants)).alias("variant"))
    shared = indexed.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")
    # 64 times the rows that Spark takes them for.
    met = shuffled(indexed).join(shared.select("variant", blocks.alias("blocks")), "variant").select(
        "variant", "fingerprint", mine.alias("block"), "blocks"
    )
    units = met.select(
        "variant", "fingerprint", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        "variant", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "fingerprint"
    )
    parts = units.repartition("variant", "left", "right").sortWithinPartitions("variant", "left", "right", "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _whole_runs(batches):
            yield _pairs_of(keys, fps, max_bits)

    return parts.mapInArrow(compare, "a long, b long")


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows as (keys, fingerprints), cut only between units."""
    held_keys, held = np.zeros((0, 3), dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
        keys, fps = np.concatenate([held_keys, keys]), np.concatenate([held, batch.column(3).to_numpy()])
        if not len(fps):
            continue
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        cut = int(ends[-1]) if len(ends) else 0
        if cut:
            yield keys[:cut], fps[:cut]
        held_keys, held = keys[cut:], fps[cut:]
    if len(held):
        yield held_keys, held


def _pairs_of(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> pa.RecordBatch:
    variants = keys[:, 0] >> HALF
    starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]])
    sizes = np.diff(starts)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    narrow = (sizes <= _NARROW)[unit]
    found_a, found_b = [], []
    for step in range(1, min(_NARROW, int(sizes.max()))):
        i = np.flatnonzero((unit[step:] == unit[:-step]) & narrow[step:])
        a, b = fps[i], fps[i + step]
        near = _linked(a, b, variants[i], max_bits)
        found_a.append(a[near])
        found_b.append(b[near])
    for u in np.flatnonzero(sizes > _NARROW):
        mine = np.unique(fps[starts[u]:starts[u + 1]])
        label = _joined(mine, variants[starts[u]], max_bits)
        moved = label != np.arange(len(mine))
        found_a.append(mine[moved])
        found_b.append(mine[label[moved]])
    none = [np.zeros(0, dtype=np.int64)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(found_a or none)), pa.array(np.concatenate(found_b or none))], names=["a", "b"]
    )


def _linked(a: np.ndarray, b: np.ndarray, variant: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether fingerprints are linked and this variant is the one that reports the pair."""
    differ = (a ^ b).view(np.uint64)
    low, high = differ & np.uint64((1 << HALF) - 1), differ >> np.uint64(HALF)
    in_low = np.bitwise_count(low) <= 1
    half = np.where(in_low, low, high)
    # The place of a single set bit is the number of ones below it.
    bit = np.where(half == 0, 0, np.bitwise_count(half - np.uint64(1)).astype(np.int64))
    total = np.bitwise_count(differ)
    return (total > 0) & (total <= max_bits) & (variant == np.where(in_low, 0, HALF) + bit)


def _joined(mine: np.ndarray, variant: int, max_bits: int) -> np.ndarray:
    """For each fingerprint the smallest index in its component within the unit."""
    label = np.arange(len(mine))
    while True:
        before = label.copy()
        for at in range(0, len(mine), 256):
            near = _linked(mine[at:at + 256, None], mine[None, :], np.int64(variant), max_bits)
            best = np.where(near, label[None, :], len(mine)).min(axis=1)
            label[at:at + 256] = np.minimum(label[at:at + 256], best)
        label = label[label]
        if (label == before).all():
            return label
