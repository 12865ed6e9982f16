"""Candidates of a prompt: alignment, completeness, dedupe, posterior."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import collapse, null_to_empty, strip

# exp() is summed per power-of-e step of this width, so no maximum is needed
# beforehand and no sum can overflow.
_STEP = 8.0
# Sums of such fixed-point numbers are exact, so they do not depend on the order of rows:
# for shares of one, and for exp() within a step.
SHARES = "decimal(38,30)"
_POWERS = "decimal(38,24)"


def align_candidates(prompts: DataFrame, lines: DataFrame) -> DataFrame:
    """Join line *i* of every source to prompt *i*; blank lines are no candidates."""
    filled = lines.withColumn("completion", strip(null_to_empty(F.col("completion"))))
    return prompts.join(
        filled.where(F.col("completion") != "").withColumnRenamed("line_idx", "prompt_id"), "prompt_id"
    )


def short_sources(lines: DataFrame, n_prompts: int, sources: DataFrame | None = None) -> DataFrame:
    """Sources with fewer lines than prompts; empty when all are complete.

    ``sources`` lists all sources, so that one without any line is found too.
    """
    counts = lines.groupBy("source").agg((F.max("line_idx") + 1).alias("n_lines"))
    if sources is not None:
        counts = sources.select("source").distinct().join(counts, "source", "left").fillna(0, ["n_lines"])
    return (
        counts.where(F.col("n_lines") < n_prompts)
        .withColumn("n_prompts", F.lit(n_prompts).cast("bigint"))
    )


def dedupe_candidates(candidates: DataFrame) -> DataFrame:
    """First candidate of each white-space-collapsed text of a prompt.

    ``row_number = 1`` becomes a limit per map task before the shuffle, so a
    text copied a billion times sends one row per task.
    """
    window = Window.partitionBy("prompt_id", "_key").orderBy("cand_idx")
    return (
        candidates.withColumn("_key", collapse(F.col("completion")))
        .withColumn("_rn", F.row_number().over(window))
        .where(F.col("_rn") == 1)
        .drop("_key", "_rn")
    )


def group_softmax(
    df: DataFrame, group: Sequence[str], score: Column, temperature: float, out: str
) -> DataFrame:
    """Softmax of a score over the rows of each group.

    Uniform when the sum is zero or not finite (all minus infinity, a NaN, an
    infinite score).  The sums combine on the map side; only one row per group
    is joined back.  The result is the same to the last bit however rows are
    partitioned.
    """
    if temperature <= 0:
        raise ValueError(f"a softmax needs a positive temperature; {temperature} is none")
    scaled = df.withColumn("_x", score / F.lit(float(temperature)))
    x = F.col("_x")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    step = F.when(finite, F.floor(x / _STEP))
    parts = scaled.groupBy(*group, step.alias("_k")).agg(
        F.sum(F.when(finite, F.exp(x - F.lit(_STEP) * step)).otherwise(0.0).cast(_POWERS)).cast("double").alias("_z"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.isnan(x) | (x == float("inf")), 1).otherwise(0)).alias("_bad"),
    )
    # One entry per occupied step of the score range.
    stats = parts.groupBy(*group).agg(
        F.max("_k").alias("_top"), F.sum("_n").alias("_n"), F.max("_bad").alias("_bad"),
        F.sort_array(F.collect_list(F.struct("_k", "_z"))).alias("_parts"),
    ).select(
        *group, "_top", "_n", "_bad",
        F.aggregate(
            "_parts", F.lit(0.0),
            lambda acc, e: acc + F.coalesce(
                e["_z"] * F.exp(F.lit(_STEP) * (e["_k"] - F.col("_top"))), F.lit(0.0)
            ),
        ).alias("_total"),
    )
    usable = (F.col("_bad") == 0) & (F.col("_total") > 0)
    share = F.when(finite, F.exp(x - F.lit(_STEP) * F.col("_top")) / F.col("_total")).otherwise(0.0)
    return (
        scaled.join(stats, list(group))
        .withColumn(out, F.when(usable, share).otherwise(1.0 / F.col("_n")))
        .drop("_x", "_top", "_n", "_bad", "_total")
    )


def candidate_softmax(candidates: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Posterior ``p_model`` of each candidate among those of its prompt."""
    return group_softmax(candidates, ["prompt_id"], F.col("score_used"), temperature, "p_model")
