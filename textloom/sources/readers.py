"""Readers for prompts, parallel output files, tokenized sets and logs.

Every reader returns explicit keys (file and line number); nothing later relies
on the order of rows in a DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import blank_na, normalize_text, null_to_empty, strip
from textloom.sources.csv_blocks import read_csv_blocks

# Keys of a JSON output line, first match wins.
COMPLETION_KEYS = ["completion", "output", "text", "hyp", "prediction"]
TOKENIZED_COLUMNS = ["input_ids", "attention_mask", "labels"]
TOKENIZED_SCHEMA = "input_ids array<bigint>, attention_mask array<bigint>, labels array<bigint>"


def require_columns(df: DataFrame, required: Sequence[str], what: str = "table") -> DataFrame:
    """Return ``df`` or raise, naming what is missing, before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}; found {sorted(df.columns)}")
    return df


def read_csv(
    spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "utf-8", multi_line: bool = True
) -> DataFrame:
    """CSV with a header and quoted cells; every column is text.

    Cells with line breaks force one task per file here; ``read_csv_rows`` reads such
    files by blocks.
    """
    return (
        spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding)
        .option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("inferSchema", False)
        .csv(path)
    )


def read_csv_rows(
    spark: SparkSession, path: str | list[str], delimiter: str = ",", encoding: str = "utf-8", multi_line: bool = True
) -> DataFrame:
    """``source, line_idx`` and the columns of CSV files with a header; ``line_idx`` is the 0-based row in its file.

    Files in UTF-8 are read by blocks, line breaks in cells or not; any other charset
    takes a task per file.  Columns are named by the first file.
    """
    table = read_csv(spark, path, delimiter, encoding, multi_line)
    if multi_line and encoding.lower().replace("-", "") == "utf8":
        return read_csv_blocks(spark, path, table.columns, delimiter)
    return number_csv_rows(table)


def read_pairs(
    spark: SparkSession, path: str | list[str], prompt_col: str = "prompt", completion_col: str = "completion",
    delimiter: str = ",", encoding: str = "utf-8", na_values: list[str] | None = None, multi_line: bool = True,
) -> DataFrame:
    """``source, row_id, prompt, completion`` of CSV files, cleaned, without empty sides.

    ``row_id`` is the 0-based row in its file, so dropped rows leave gaps.
    """
    raw = require_columns(read_csv_rows(spark, path, delimiter, encoding, multi_line), [prompt_col, completion_col], "CSV")
    pairs = raw.select(
        "source", F.col("line_idx").alias("row_id"),
        normalize_text(blank_na(F.col(prompt_col), na_values)).alias("prompt"),
        normalize_text(blank_na(F.col(completion_col), na_values)).alias("completion"),
    )
    return nonempty_pairs(pairs)


def nonempty_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("prompt") != "") & (F.col("completion") != ""))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when the table is empty; looks at one row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Hash a small scanned table over all cores before heavy work per row.

    A file is read by as many tasks as it has row groups.  A scan that already
    has at least four splits per core, as any large table has, is left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= 4 * cores:
        return table
    return table.repartition(cores, *keys)


# A task reads blocks of some 128 MB, or as many small files as take as long (4 MB each
# at least), so about 32 rows of 200 bytes; together they stay below 64 MB.
_BROADCAST_TASKS = 10_000


def number_lines(raw: DataFrame, order: str = "_at") -> DataFrame:
    """0-based line number per file from the block and the order inside it.

    A task reads the lines of a block one after another and ``order`` counts them, so
    a line's place in its block is its distance from the block's first.  The line
    counts of the blocks before come from a table of one row per block, which is
    broadcast while the number of read tasks proves it small: no line is shuffled.
    """
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        raw.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if raw.rdd.getNumPartitions() <= _BROADCAST_TASKS:
        blocks = F.broadcast(blocks)
    return (
        raw.join(blocks, ["source", "_block"])
        .withColumn("line_idx", F.col(order) - F.col("_first") + F.col("_before"))
        .drop("_first", "_before", "_block", order)
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, line_idx, line`` of text files cut at newlines only."""
    raw = (
        spark.read.option("lineSep", "\n").text(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.col("value").alias("line"),
            F.monotonically_increasing_id().alias("_at"),
        )
    )
    return number_lines(raw)


def line_text(line: Column) -> Column:
    """Completion of an output line.

    A JSON object gives the first known key that holds a string, or nothing;
    any other line is the completion itself.
    """
    text = strip(null_to_empty(line))
    looks_like_object = text.startswith("{") & text.endswith("}")
    parsed = F.when(looks_like_object, F.try_parse_json(text))

    def string_at(key: str) -> Column:
        field = F.try_variant_get(parsed, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(parsed, f"$.{key}", "string"))

    found = F.coalesce(*[string_at(k) for k in COMPLETION_KEYS], F.lit(""))
    return F.when(parsed.isNotNull(), strip(found)).otherwise(text)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, place`` of the files, also of empty ones; ``place`` is the path's in the list given.

    Names only, which the reader of any table lists on the driver anyway; a scan would
    leave out empty files.
    """
    place: dict[str, int] = {}
    for i, p in enumerate([path] if isinstance(path, str) else path):
        for name in spark.read.text(p).inputFiles():
            # Without an authority the metadata column writes one slash.
            place.setdefault(re.sub("^([a-z]+):///", r"\1:/", name), i)
    return spark.createDataFrame(list(place.items()), "source string, place int")


def file_states(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, state`` of the files, empty ones too: length and time of change, without reading them."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("source"), F.concat_ws(":", "length", F.unix_micros("modificationTime")).alias("state")
    )


def read_parallel_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, line_idx, completion`` of output files, text or JSON lines."""
    lines = read_lines(spark, path)
    return lines.select("source", "line_idx", line_text(F.col("line")).alias("completion"))


def read_texts(spark: SparkSession, path: str, csv_field: str) -> DataFrame:
    """Hypotheses or references by suffix: lines of .txt/.out, a column of .csv."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("txt", "out"):
        return read_lines(spark, path).select("line_idx", F.col("line").alias("text"))
    if suffix == "csv":
        return require_columns(read_csv_rows(spark, path), [csv_field], path).select(
            "line_idx", F.col(csv_field).alias("text")
        )
    raise ValueError(f"unsupported file type: {path}; use .txt, .out or .csv")


def number_csv_rows(table: DataFrame) -> DataFrame:
    """0-based row number of a CSV in its file; a multi-line file is one block."""
    raw = table.select(
        "*", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    return number_lines(raw)


def read_prompts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``prompt_id, prompt`` from the ``prompt`` column of a CSV."""
    table = require_columns(read_csv_rows(spark, path), ["prompt"], "prompt file")
    numbered = require_rows(table, "no prompts found")
    return numbered.select(F.col("line_idx").alias("prompt_id"), "prompt")


def read_tokenized(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """Rows of one split of a tokenized set, or of the first split if absent."""
    table = spark.read.parquet(path)
    if "split" in table.columns:
        if table.where(F.col("split") == split).isEmpty():
            split = table.agg(F.min("split")).first()[0]
        table = table.where(F.col("split") == split).drop("split")
    return require_columns(table, TOKENIZED_COLUMNS, path)


# Fixed format: <base>_<top_p>_<temperature>/<method>/<set>/<corpus>/<dialect>.out
_RUN_PATH = r"([^/]+)_([0-9.]+)_([0-9.]+)/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.out$"
_RUN_FIELDS = ["base", "top_p", "temperature", "method", "lang_set", "corpus", "dialect"]


def run_path_fields(path: Column) -> list[Column]:
    """Columns carried by the path of an output file of a sampling run; empty and null for any other path."""
    fields = [F.regexp_extract(path, _RUN_PATH, i + 1).alias(name) for i, name in enumerate(_RUN_FIELDS)]
    fields[1:3] = [f.try_cast("double").alias(n) for f, n in zip(fields[1:3], _RUN_FIELDS[1:3])]
    return fields


def read_candidate_runs(spark: SparkSession, base: str, method: str, lang_set: str, corpus: str, dialect: str) -> DataFrame:
    """Lines of one dialect from the output files of all sampling runs."""
    lines = read_parallel_lines(spark, f"{base}_*_*/{method}/{lang_set}/{corpus}/{dialect}.out")
    return lines.select("*", *run_path_fields(F.col("source"))[1:3])


def dataset_name_fields(name: Column) -> list[Column]:
    """Kind, corpus and language pair of ``bi__corpus__src_tgt`` or ``src-tgt.csv``."""
    base = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    parts = F.split(base, "__")
    long_form = F.size(parts) >= 3
    pair = F.split(F.element_at(parts, -1), "[-_]")
    return [
        F.when(long_form, F.get(parts, F.lit(0))).otherwise("").alias("kind"),
        F.when(long_form, F.get(parts, F.lit(1))).otherwise("").alias("corpus"),
        F.when(F.size(pair) == 2, F.get(pair, F.lit(0))).otherwise("").alias("source_lang"),
        F.coalesce(F.when(F.size(pair) == 2, F.get(pair, F.lit(1))), F.element_at(parts, -1)).alias("target_lang"),
    ]
