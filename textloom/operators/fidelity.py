"""Dialect fidelity from classifier outputs, and its report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import clamp01, class_prob, group_prob, softmax
from textloom.functions.text import clean_text
from textloom.sources.dims import allowed_dim, class_dim, fidelity_grid


def with_dialect_class(df: DataFrame, country_col: str = "dialect") -> DataFrame:
    """Add class index, names and macro membership of a country code.

    Unknown codes keep their row with nulls.  The dimension has 18 fixed rows.
    """
    dim = F.broadcast(class_dim(df.sparkSession))
    return df.join(dim, df[country_col] == dim["country"], "left").drop(dim["country"])


def unknown_dialects(df: DataFrame, country_col: str = "dialect") -> DataFrame:
    """Country codes that the dimension does not hold, with their row counts."""
    dim = class_dim(df.sparkSession)
    missing = df.join(F.broadcast(dim), df[country_col] == dim["country"], "left_anti")
    return missing.groupBy(country_col).agg(F.count(F.lit(1)).alias("n"))


def with_lid_gate(df: DataFrame, code_col: str = "code", target_col: str = "target_lang", allowed: dict | None = None) -> DataFrame:
    """Flag rows whose language code is allowed for their target language."""
    dim = allowed_dim(df.sparkSession, allowed) if allowed else allowed_dim(df.sparkSession)
    flags = dim.select(F.col("target_lang").alias("_t"), F.col("code").alias("_c"), F.lit(True).alias("_ok"))
    matched = (F.col(target_col) == F.col("_t")) & (F.col(code_col) == F.col("_c"))
    return (
        df.join(F.broadcast(flags), matched, "left")
        .withColumn("lid_ok", F.coalesce(F.col("_ok"), F.lit(False)))
        .drop("_t", "_c", "_ok")
    )


def target_probs(df: DataFrame, country_col: str = "dialect") -> DataFrame:
    """Add ``prob`` and ``macro_prob`` of the target class from ``logits``, and ``known_dialect``."""
    probs = df.withColumn("_probs", softmax(F.col("logits")))
    return (
        with_dialect_class(probs, country_col)
        .withColumn("prob", class_prob(F.col("_probs"), F.col("class_idx")))
        .withColumn("macro_prob", group_prob(F.col("_probs"), F.col("same_macro")))
        .withColumn("known_dialect", F.col("class_idx").isNotNull())
        .drop("_probs", "class_idx", "dialect_name", "macro", "same_macro")
    )


def fidelity_rows(
    df: DataFrame, require_target_lang: bool = True, allow_msa: bool = False, allowed: dict | None = None
) -> DataFrame:
    """Per-row ``prob``, ``dialectness``, ``score``, ``macro_score``.

    Empty text, a failed language gate, an unknown dialect or a disallowed ``msa``
    target gives zeros.  Input: ``text, code, target_lang, logits, dialectness, dialect``.
    """
    gated = with_lid_gate(target_probs(df), allowed=allowed)
    valid: Column = (clean_text(F.col("text")) != "") & (F.col("known_dialect") | (F.col("dialect") == "msa"))
    if require_target_lang:
        valid = valid & F.col("lid_ok")
    if not allow_msa:
        valid = valid & (F.col("dialect") != "msa")

    def kept(x: Column) -> Column:
        return F.coalesce(F.when(valid, x), F.lit(0.0))

    dialectness = clamp01(F.col("dialectness").cast("double"))
    return gated.select(
        *[c for c in df.columns if c not in ("logits", "dialectness")],
        kept(F.col("prob")).alias("prob"),
        kept(dialectness).alias("dialectness"),
        kept(F.col("prob") * dialectness).alias("score"),
        kept(F.col("macro_prob") * dialectness).alias("macro_score"),
    )


METRICS = ("prob", "dialectness", "score", "macro_score")


def fidelity_scores(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means over all rows of each group, failed rows included as zeros."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in METRICS]
    )


_CELL = ["lang_set", "corpus", "dialect"]


def _cells(rows: DataFrame, grid: DataFrame | None) -> DataFrame:
    return fidelity_grid(rows.sparkSession) if grid is None else grid.select(*_CELL).distinct()


def fidelity_report(rows: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """One line per expected (set, corpus, dialect); what is missing scores 0.

    ``grid`` has the expected cells; by default the usual ones.
    """
    return _cells(rows, grid).join(fidelity_scores(rows, _CELL), _CELL, "left").fillna(0, ["n", *METRICS])


def report_leftovers(rows: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """Rows per (set, corpus, dialect) that the report's grid does not hold."""
    counts = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(_cells(rows, grid), _CELL, "left_anti")


def fidelity_counts(rows: DataFrame) -> DataFrame:
    """Rows and files per corpus with the grand total (null corpus)."""
    files = rows.groupBy("corpus", "dialect").agg(F.count(F.lit(1)).alias("n"))
    return files.rollup("corpus").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))


def manifest_mismatch(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are not on both sides: ``source, dialect, n``.

    A listed file without a line has ``n`` 0, a file with lines that is not listed a
    null dialect.
    """
    counts = lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    listed = manifest.groupBy("source").agg(F.min("dialect").alias("dialect"), F.lit(True).alias("_listed"))
    both = listed.join(counts, "source", "full")
    return both.where(F.col("_listed").isNull() | F.col("n").isNull()).select(
        "source", "dialect", F.coalesce("n", F.lit(0)).alias("n")
    )


def attach_manifest(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Join output lines to their manifest entry ``(source, dialect)``.

    The manifest names each file once; a line without an entry keeps a null
    dialect so the mismatch shows.
    """
    return lines.join(manifest.dropDuplicates(["source"]), "source", "left")
