"""Metric logs in long form ``run, step, metric, value`` and what is read off them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.slices import running_before

LOG_KEYS = ("run", "step", "ts")


def _step(text: Column) -> Column:
    return text.try_cast("double").try_cast("bigint")


def rejected_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Lines ``metrics_long`` cannot place, with the reason and how often they stand there."""
    record = F.from_json(F.col(line_col), "map<string,string>")
    reasons = lines.select(F.col(line_col).alias("line"), record.alias("r")).select(
        "line",
        F.when(F.coalesce(F.size("r"), F.lit(0)) <= 0, "no record")
        .when(_step(F.try_element_at("r", F.lit("step"))).isNull(), "no step")
        .when(F.try_to_timestamp(F.try_element_at("r", F.lit("ts"))).isNull(), "no time").alias("reason"),
    )
    return reasons.where(F.col("reason").isNotNull()).groupBy("line", "reason").agg(F.count(F.lit(1)).alias("n"))


def metrics_long(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """JSON-line records with any metric keys to one row per metric.

    A key whose value is no finite number or infinity (NaN, text) gives no row.  A
    step may be written as a float; one that is no number, and a time that is none,
    are null.  Lines that are no JSON object give no rows (see ``rejected_lines``).
    """
    record = F.from_json(F.col(line_col), "map<string,string>")
    parsed = lines.select(record.alias("r")).select(
        F.try_element_at("r", F.lit("run")).alias("run"),
        _step(F.try_element_at("r", F.lit("step"))).alias("step"),
        F.try_to_timestamp(F.try_element_at("r", F.lit("ts"))).alias("ts"),
        F.explode(F.map_filter("r", lambda k, _: ~k.isin(*LOG_KEYS))).alias("metric", "_v"),
    )
    value = F.expr("try_cast(_v as double)")
    return parsed.withColumn("value", value).where(F.col("value").isNotNull() & ~F.isnan("value")).drop("_v")


def loss_and_perplexity(batches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean loss weighted by batch size, and its exponential."""
    total = F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))
    mean = F.coalesce(F.sum(F.col("loss") * F.col("n")), F.lit(0.0)) / total
    return batches.groupBy(*by).agg(mean.alias("loss"), F.exp(mean).alias("ppl"))


def macro_average(groups: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean over eval groups; a group without a value does not count."""
    return groups.groupBy(*by).agg(
        *[F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(f"{m}_avg_macro") for m in metrics]
    )


def average_lengths(df: DataFrame, by: Sequence[str], hyp_tokens: str, ref_tokens: str) -> DataFrame:
    """Mean hypothesis and reference length in tokens."""
    return df.groupBy(*by).agg(
        F.avg(F.size(hyp_tokens)).alias("avg_hyp_len"), F.avg(F.size(ref_tokens)).alias("avg_ref_len")
    )


def _oriented(mode: Column, value: Column) -> Column:
    """Value turned so that smaller is better in either mode."""
    return F.when(mode == "max", -value).otherwise(value)


def _with_modes(log: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Keep the tracked metrics; the modes are a short settings map."""
    bad = set(modes.values()) - {"min", "max"}
    if bad:
        raise ValueError(f"unknown mode: {sorted(bad)}")
    pairs = [F.lit(x) for item in modes.items() for x in item]
    return (
        log.where(F.col("metric").isin(*modes) & F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("mode", F.element_at(F.create_map(*pairs), F.col("metric")))
    )


def best_history(log: DataFrame, modes: dict[str, str], tie: Sequence[Column] = ()) -> DataFrame:
    """Every record that strictly improved on all earlier ones of its run and metric."""
    cost = _oriented(F.col("mode"), F.col("value"))
    before = running_before(
        _with_modes(log, modes), ["run", "metric"], [F.asc("step"), *tie], cost, "min", "_before"
    )
    better = F.col("_before").isNull() | (cost < F.col("_before"))
    return before.where(better).drop("_before")


def best_final(log: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Best value per run and metric with its earliest step."""
    cost = _oriented(F.col("mode"), F.col("value"))
    best = _with_modes(log, modes).groupBy("run", "metric", "mode").agg(
        F.min(F.struct(cost.alias("cost"), F.col("step"), F.col("value"))).alias("b")
    )
    return best.select("run", "metric", "mode", F.col("b.value").alias("best_value"), F.col("b.step").alias("best_step"))


def latest_eval(log: DataFrame, metric: str = "eval_loss") -> DataFrame:
    """Last record of the metric per run, beside its best value so far."""
    of_metric = log.where((F.col("metric") == metric) & F.col("value").isNotNull() & ~F.isnan("value"))
    grouped = of_metric.groupBy("run").agg(
        F.max(F.struct("step", "value")).alias("last"), F.min("value").alias("best_metric")
    )
    return grouped.select(
        "run", F.col("last.step").alias("step"), F.col("last.value").alias(metric), "best_metric"
    )
