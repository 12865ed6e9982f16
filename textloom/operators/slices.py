"""Row numbers and running values without putting a whole group into one task.

A plain window sends all rows of a partition key to one task.  Here rows are
first cut into slices that follow the requested order; work inside a slice is
bounded by the slice, and what a slice needs from earlier ones is one row per
(group, slice).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import durable

SLICE = "_slice"
# A slice of a seeded order holds about so many rows at most ...
_SLICE_ROWS = 1 << 20
# ... and is named by so many hex digits of the hash at least.
_HASH_DIGITS = 3
# Up to here Catalyst turns "row_number <= n" into a limit before the shuffle.
_GROUP_LIMIT = 1000


def range_slices(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition by group and order and name the partition.

    The order columns take part in the cut, so one hot group spreads over many
    slices.  The result is durable: the cut must be the same for every reader.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def _seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_slices(df: DataFrame, key: Column, seed: int) -> DataFrame:
    """Slice by a seeded hash of the row key; also adds the hash as ``_hash``."""
    hashed = df.withColumn("_hash", _seeded_hash(key, seed))
    digits = _HASH_DIGITS
    if (rows := df.count()) > _SLICE_ROWS * 16 ** digits:
        digits = math.ceil(math.log(rows / _SLICE_ROWS, 16))
    return hashed.withColumn(SLICE, F.substring("_hash", 1, digits))


def _number_within(sliced: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    keys = [*group, SLICE]
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    numbered = sliced.withColumn("_local", local).join(offsets, keys)
    return numbered.withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", SLICE)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """1-based ``row_number`` per group; the order must be total."""
    return _number_within(range_slices(df, group, order), group, order, out)


def number_by_hash(
    df: DataFrame, group: Sequence[str], key: Column, seed: int, out: str = "rn"
) -> DataFrame:
    """1-based position of each row in a seeded random order of its group."""
    sliced = hash_slices(df, key, seed)
    tie = key.cast("string")
    return _number_within(sliced, group, [F.col("_hash"), tie], out).drop("_hash")


def take_by_hash(
    df: DataFrame, group: Sequence[str], key: Column, seed: int, wanted: Callable[[Column, Column], Column], share: Column, out: str
) -> DataFrame:
    """Flag the first rows of a seeded order per group; ``wanted(size, share)`` says how many.

    ``share`` is one value per group.  How many rows a slice gives is joined to its rows by
    group and slice, so rows of a large group stay dealt out; only the one slice per group
    that is taken in part is sorted.  Rows are moved without their hash; that of the sorted
    ones is made again.
    """
    sliced = hash_slices(df, key, seed).drop("_hash")
    keys = [*group, SLICE]
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(share).alias("_share"))
    of_group = Window.partitionBy(*group)
    so_far = of_group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = counts.withColumn("_size", F.sum("_n").over(of_group)).withColumn("_upto", F.sum("_n").over(so_far))
    last = F.least(F.col("_size"), wanted(F.col("_size"), F.col("_share")))
    left = F.col("_last") - F.col("_upto") + F.col("_n")
    parts = sized.withColumn("_last", last).select(*keys, left.alias("_left"), (left >= F.col("_n")).alias("_all"))
    known = sliced.join(parts, keys, "left")
    on_edge = F.coalesce((F.col("_left") > 0) & ~F.col("_all"), F.lit(False))
    order = Window.partitionBy(*keys).orderBy(_seeded_hash(key, seed), key.cast("string"))
    sure = known.where(~on_edge).withColumn(out, F.coalesce(F.col("_all"), F.lit(False)))
    ranked = known.where(on_edge).withColumn(out, F.row_number().over(order) <= F.col("_left"))
    return sure.unionByName(ranked).select(*df.columns, out)


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group in the stated order.

    The same rows either way: up to _GROUP_LIMIT by a window that Spark limits
    before its shuffle, beyond it by slices.
    """
    if n > _GROUP_LIMIT:
        return number_rows(df, group, order, "_rn").where(F.col("_rn") <= n).drop("_rn")
    window = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def running_before(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, best: str, out: str
) -> DataFrame:
    """Best (``"min"`` or ``"max"``) value among the rows before each row."""
    pick = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
    if best not in pick:
        raise ValueError(f"best must be 'min' or 'max', not {best!r}")
    aggregate, combine = pick[best]
    sliced = range_slices(df.withColumn("_value", value), group, order)
    keys = [*group, SLICE]
    earlier_slices = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy(*keys).agg(aggregate("_value").alias("_slice_best"))
        .withColumn("_carried", aggregate("_slice_best").over(earlier_slices))
        .drop("_slice_best")
    )
    earlier_rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_local", aggregate("_value").over(earlier_rows))
        .join(carried, keys)
        .withColumn(out, combine("_local", "_carried"))
        .drop("_local", "_carried", "_value", SLICE)
    )
