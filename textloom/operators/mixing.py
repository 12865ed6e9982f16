"""Mixing, splitting, sampling, shuffling, packing and padding of training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import IGNORE, pad_right, take
from textloom.operators.slices import first_n, number_by_hash, number_rows, take_by_hash

DEFAULT_CHRF_EVAL_N = 64
TOKEN_COLUMNS = ("input_ids", "attention_mask", "labels")


def concat_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    if not parts:
        raise ValueError("no training data: give at least one part")
    return reduce(DataFrame.unionByName, parts)


def repeat_rows(df: DataFrame, times: Column | int, copy_col: str = "copy") -> DataFrame:
    """Each row ``times`` times, numbered from 1; never less than once."""
    times = F.lit(times) if isinstance(times, int) else times
    return df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), times))))


def with_group_size(df: DataFrame, group: Sequence[str], out: str = "_size") -> DataFrame:
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(out))
    return df.join(sizes, list(group))


def sample_frac(df: DataFrame, group: Sequence[str], key: Column, frac: Column | float, seed: int) -> DataFrame:
    """Exactly ``max(1, round(n * frac))`` rows per group in a seeded order.

    Rounds half to even.  A fraction of 1 keeps every row.
    """
    if isinstance(frac, (int, float)):
        if not 0.0 < frac <= 1.0:
            raise ValueError(f"a share of rows lies above 0 and at most at 1; {frac} does not")
        frac = F.lit(float(frac))
    def wanted(size: Column, share: Column) -> Column:
        return F.greatest(F.lit(1), F.rint(size * share))

    return take_by_hash(df, group, key, seed, wanted, frac, "_taken").where("_taken").drop("_taken")


def sample_rows(
    df: DataFrame, group: Sequence[str], key: Column, order: Sequence[Column],
    *, frac: float | None = None, n: int | None = None, seed: int = 0,
) -> DataFrame:
    """First n rows if n is given, else a seeded fraction, else everything."""
    if n is not None and n > 0:
        return first_n(df, group, order, n)
    if frac is not None:
        return sample_frac(df, group, key, frac, seed)
    return df


def seeded_shuffle(df: DataFrame, key: Column, seed: int, out: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in a seeded random order."""
    return number_by_hash(df, [], key, seed, out)


def _val_rows(size: Column, val_ratio: Column) -> Column:
    """A ratio above 1 is a row count, otherwise a share rounded up."""
    return F.when(val_ratio > 1, F.floor(val_ratio)).otherwise(F.ceil(size * val_ratio))


def train_val_split(df: DataFrame, group: Sequence[str], key: Column, val_ratio: Column | float, seed: int) -> DataFrame:
    """Add ``part``: ``val`` for the first rows of a seeded order, else ``train``."""
    ratio = F.lit(float(val_ratio)) if isinstance(val_ratio, (int, float)) else val_ratio
    flagged = take_by_hash(df, group, key, seed, _val_rows, ratio, "_val")
    return flagged.withColumn("part", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


@dataclass(frozen=True)
class MixEntry:
    """One dataset of a mix plan."""

    name: str
    role: str = "train"
    repeat: int = 1
    sample_frac: float | None = None
    sample_n: int | None = None
    val_ratio: float = 0.0
    metrics: Sequence[str] = field(default_factory=lambda: ["loss"])
    chrf_eval_n: int | None = None
    # Where its tokenized rows are, for jobs that read the datasets themselves.
    path: str | None = None
    split: str = "train"

    def checked(self) -> "MixEntry":
        if self.role not in ("train", "eval"):
            raise ValueError(f"dataset {self.name}: invalid role {self.role!r}")
        if self.sample_frac is not None and not 0.0 < self.sample_frac <= 1.0:
            raise ValueError(f"{self.name}: a share of rows lies above 0 and at most at 1; {self.sample_frac} does not")
        return self


PLAN_SCHEMA = (
    "name string, role string, repeat int, sample_frac double, sample_n bigint,"
    " val_ratio double, metrics array<string>, chrf_eval_n bigint"
)


def plan_table(spark, entries: Sequence[MixEntry], chrf_eval_n: int | None = None) -> DataFrame:
    """The plan as a table, with defaults filled in."""
    if not any(e.checked().role == "train" for e in entries):
        raise ValueError("the plan names no dataset to train on")
    fallback = DEFAULT_CHRF_EVAL_N if chrf_eval_n is None else chrf_eval_n
    rows = [
        (
            e.name, e.role, int(e.repeat), e.sample_frac, e.sample_n if e.sample_n and e.sample_n > 0 else None,
            float(e.val_ratio), sorted({m.lower() for m in (e.metrics or ["loss"])}),
            int(fallback if e.chrf_eval_n is None else e.chrf_eval_n),
        )
        for e in entries
    ]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def plan_gaps(data: DataFrame, plan: DataFrame) -> DataFrame:
    """Datasets on one side only: ``name, planned, n``; a mix would leave them out."""
    counts = data.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    lines = plan.groupBy("name").agg(F.lit(True).alias("planned"))
    both = lines.join(counts, "name", "full")
    return both.where(F.col("planned").isNull() | F.col("n").isNull()).select(
        "name", F.coalesce("planned", F.lit(False)).alias("planned"), F.coalesce("n", F.lit(0)).alias("n")
    )


def dataset_mix(
    data: DataFrame, plan: DataFrame, key: Sequence[str], order: Sequence[Column], seed: int, leak_safe: bool = True
) -> DataFrame:
    """Apply a whole mix plan: split, repeat and sample every dataset at once.

    ``data`` has a ``name`` column naming the dataset and a ``key`` unique in it;
    datasets without a line in the plan are left out (``plan_gaps`` lists them).
    Adds ``part`` (``train`` or ``eval``), ``eval_group`` and ``copy``.  With
    ``leak_safe`` copies of training rows are made after the split, so no row is
    on both sides; otherwise before it.  The plan is a settings list of a few
    rows and is broadcast.

    One ranking of the bare keys serves all datasets: a training set is ranked
    in a seeded order, an eval set in its stored order when it takes the first
    n rows and in a seeded order when it takes a share.
    """
    is_train = F.col("role") == "train"
    settings = F.broadcast(plan.select("name", "role", "repeat", "sample_frac", "sample_n", "val_ratio"))
    early = F.lit(True) if not leak_safe else ~is_train
    rows = repeat_rows(data.join(settings, "name"), F.when(early, F.col("repeat")).otherwise(1))

    seeded = is_train | (F.col("sample_n").isNull() & F.col("sample_frac").isNotNull())
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.col("copy").cast("string")))
    ids = ["name", *key, "copy"]
    keys = rows.select(*ids, F.when(seeded, draw).alias("_draw"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    ranking = [F.asc("_draw"), *[F.asc(f"_o{i}") for i in range(len(order))], *[F.asc(k) for k in (*key, "copy")]]
    ranks = number_rows(keys, ["name"], ranking, "_rank").select(*ids, "_rank")
    ranked = with_group_size(rows.join(ranks, ids), ["name"])

    rank, size = F.col("_rank"), F.col("_size")
    eval_size = F.when(is_train, _val_rows(size, F.col("val_ratio"))).otherwise(size)
    in_eval = rank <= eval_size
    share = F.greatest(F.lit(1), F.rint(eval_size * F.col("sample_frac")))
    wanted = (
        F.when(F.col("sample_n").isNotNull(), F.col("sample_n"))
        .when(F.col("sample_frac").isNotNull(), share).otherwise(eval_size)
    )
    split = (
        ranked.where(~in_eval | (rank <= wanted))
        .withColumn("part", F.when(in_eval, "eval").otherwise("train"))
        .withColumn(
            "eval_group",
            F.when(~in_eval, F.lit(None)).when(is_train, F.concat("name", F.lit("_val"))).otherwise(F.col("name")),
        )
    )
    if leak_safe:
        split = repeat_rows(
            split.withColumnRenamed("copy", "_early"), F.when(F.col("part") == "train", F.col("repeat")).otherwise(1)
        ).withColumn("copy", F.greatest("copy", "_early"))
    return split.select(*data.columns, "part", "eval_group", "copy")


def mix_summary(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows, metrics and chrF rows of the train part and of each eval group."""
    counts = mixed.groupBy("name", "part", "eval_group").agg(F.count(F.lit(1)).alias("n"))
    settings = F.broadcast(plan.select("name", "role", "metrics", "chrf_eval_n"))
    is_eval = F.col("part") == "eval"
    return counts.join(settings, "name").select(
        "name", "role", "part", "eval_group", "n",
        F.when(is_eval, F.array_join("metrics", ",")).alias("metrics"),
        F.when(is_eval, F.least("chrf_eval_n", "n")).alias("chrf_rows"),
    )


def pack_sequences(df: DataFrame, row_id: str, max_length: int, batch_rows: int = 256) -> DataFrame:
    """Greedy packing inside batches of consecutive rows.

    A row that would overflow starts a new sequence; each sequence is cut to
    ``max_length``; empty rows are skipped.  ``row_id`` is a dense 0-based row
    number; a batch holds at most ``batch_rows`` rows, so the ordered fold over
    it is bounded.
    """
    batched = df.select(
        F.floor(F.col(row_id) / F.lit(batch_rows)).alias("batch"),
        F.struct(F.col(row_id).alias("row_id"), *TOKEN_COLUMNS).alias("row"),
    ).where(F.size("row.input_ids") > 0)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("bins"))

    def place(state: Column, row: Column) -> Column:
        n = F.size(row["input_ids"])
        full = (state["used"] > 0) & (state["used"] + n > max_length)
        bin_id = F.when(full, state["bin"] + 1).otherwise(state["bin"])
        used = F.when(full, n).otherwise(state["used"] + n)
        return F.struct(used.alias("used"), bin_id.alias("bin"), F.concat(state["bins"], F.array(bin_id)).alias("bins"))

    placed = (
        batched.groupBy("batch").agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .withColumn("bins", F.aggregate("rows", start, place, lambda s: s["bins"]))
        .select("batch", F.explode(F.arrays_zip("bins", "rows")).alias("e"))
    )
    packed = placed.groupBy("batch", F.col("e.bins").alias("bin")).agg(
        F.sort_array(F.collect_list("e.rows")).alias("rows")
    )
    return packed.select(
        "batch", "bin",
        *[take(F.flatten(F.col(f"rows.{c}")), F.lit(max_length)).alias(c) for c in TOKEN_COLUMNS],
        F.size("rows").cast("bigint").alias("n_rows"),
    )


def pad_batches(df: DataFrame, key: Sequence[str], batch_size: int, pad_id: int = 0, multiple: int = 8) -> DataFrame:
    """Batches of rows of like length, padded to a multiple.

    Ids are filled with ``pad_id``, the mask with 0, labels with -100.  Only
    keys and lengths are sorted; ``key`` must be unique.
    """
    lengths = df.select(*key, F.size("input_ids").alias("_len"))
    numbered = number_rows(lengths, [], [F.asc("_len"), *[F.asc(k) for k in key]], "_at").withColumn(
        "batch", F.floor((F.col("_at") - 1) / F.lit(batch_size))
    )
    widths = numbered.groupBy("batch").agg(
        (F.ceil(F.max("_len") / F.lit(multiple)) * multiple).cast("int").alias("width")
    )
    width = F.col("width")
    return (
        df.join(numbered.join(widths, "batch").select(*key, "batch", "width"), list(key))
        .withColumn("input_ids", pad_right(F.col("input_ids"), width, pad_id))
        .withColumn("attention_mask", pad_right(F.col("attention_mask"), width, 0))
        .withColumn("labels", pad_right(F.col("labels"), width, IGNORE))
    )
