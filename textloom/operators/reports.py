"""Reports over all corpora and directions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.overlap import corpus_scores
from textloom.sources.dims import mt_grid


def mt_report(pairs: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """chrF++ and BLEU of each expected corpus and direction; missing scores 0.

    Input: ``corpus, direction, hyp, ref, hyp_tokens, ref_tokens``.  ``grid`` has the
    expected ``corpus, direction``; by default the usual ones.
    """
    keys = ["corpus", "direction"]
    scores = corpus_scores(pairs, keys, "hyp", "ref", "hyp_tokens", "ref_tokens")
    wanted = mt_grid(pairs.sparkSession) if grid is None else grid.select(*keys).distinct()
    return wanted.join(scores, keys, "left").fillna(0, ["n", "chrf", "bleu"])


def unfinished(work: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Units of work whose output does not exist yet."""
    return work.join(finished.select(*keys), keys, "left_anti")


def macro_score(report: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Unweighted mean of report lines."""
    return report.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
