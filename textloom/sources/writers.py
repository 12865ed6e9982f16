"""Writers for tokenized sets, ranked rows, best texts and metric records."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import escape_newlines
from textloom.sources.commits import Files

# Columns of the ranked table in output order.
RANKED_COLUMNS = [
    "prompt_id", "rank_by_risk", "prompt", "completion", "token_count", "logp_sum",
    "score_used", "p_model", "risk_1_minus_chrf", "p_risk", "source",
    "sent_rep_penalty", "word_rep_penalty",
]
FIXED_POINT = ["logp_sum", "score_used", "p_model", "risk_1_minus_chrf", "p_risk"]


def fixed_point(x: Column, digits: int = 8) -> Column:
    """Decimal text with a fixed number of digits."""
    infinite = F.abs(x) == float("inf")
    return (
        F.when(F.isnan(x), "nan")
        .when(infinite, F.when(x > 0, "inf").otherwise("-inf"))
        .otherwise(F.format_string(f"%.{digits}f", x))
    )


def ranked_rows(ranked: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The 13 output columns as written to CSV, behind the columns of ``also``."""
    return ranked.withColumnRenamed("risk", "risk_1_minus_chrf").select(
        *also, *[fixed_point(F.col(c)).alias(c) if c in FIXED_POINT else F.col(c) for c in RANKED_COLUMNS]
    )


def write_ranked_csv(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV folder sorted by prompt and rank across its files."""
    rows = ranked_rows(ranked).repartitionByRange("prompt_id", "rank_by_risk").sortWithinPartitions(
        "prompt_id", "rank_by_risk"
    )
    rows.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_ranked_json(ranked: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The same rows as JSON lines, numbers unformatted."""
    ranked.withColumnRenamed("risk", "risk_1_minus_chrf").select(*RANKED_COLUMNS).write.mode(mode).json(path)


def best_lines(best: DataFrame) -> DataFrame:
    """``prompt_id`` and its best text on one line."""
    return best.select("prompt_id", escape_newlines(F.col("completion")).alias("line"))


def write_best_lines(best: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Best texts with their prompt id, tab separated, in prompt order."""
    best_lines(best).repartitionByRange("prompt_id").sortWithinPartitions("prompt_id").select(
        F.concat_ws("\t", F.col("prompt_id").cast("string"), F.col("line")).alias("value")
    ).write.mode(mode).text(path)


def write_tokenized(df: DataFrame, path: str, settings: dict, mode: str = "errorifexists") -> None:
    """Tokenized rows by split, and the settings that made them beside."""
    parted = df if "split" in df.columns else df.withColumn("split", F.lit("train"))
    parted.write.mode(mode).partitionBy("split").parquet(f"{path}/rows")
    one_row = df.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string")
    one_row.coalesce(1).write.mode(mode).text(f"{path}/settings")


def append_metrics(records: DataFrame, path: str, job: str | None = None) -> bool:
    """Append metric records as JSON lines with the UTC time of writing; returns whether they were written.

    The records appear together, by one rename.  Under the same ``job`` (letters, digits,
    dots, dashes) they are written once, however often a failed call is repeated.
    """
    if job is not None and not re.fullmatch("[A-Za-z0-9.-]+", job):
        raise ValueError(f"a job's name has letters, digits, dots and dashes only, unlike {job!r}")
    files, name = Files(records.sparkSession, path), job or uuid.uuid4().hex
    target = f"{path.rstrip('/')}/job={name}"
    if files.exists(target):
        return False
    staged = f"{path.rstrip('/')}/_staged/{name}-{uuid.uuid4().hex}"
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    records.withColumn("ts", stamp).write.json(staged)
    files.rename(staged, target)
    return True
