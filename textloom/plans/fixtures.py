"""Inputs of the queries, derived by Spark from the whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.chat import render_pair
from textloom.functions.text import words
from textloom.operators.candidates import align_candidates
from textloom.operators.tokens import build_vocabulary, encode
from textloom.session import durable
from textloom.sources.readers import spread

MAX_LENGTH = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that is heavy per row."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")


def r6(x: Column | str) -> Column:
    """Six decimals, as the SQL twins round too; also turns -0.0 into 0.0."""
    column = F.col(x) if isinstance(x, str) else x
    return F.round(column, 6) + F.lit(0.0)


def joined(array: Column | str) -> Column:
    """Digest of an array of numbers."""
    column = F.col(array) if isinstance(array, str) else array
    return F.md5(F.array_join(column.cast("array<string>"), ","))


def prompt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn, the assistant turn after it, and the conversation's system text."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answer = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    system = turns.where("role = 'system' AND turn = 0").select("conv_id", F.col("text").alias("system"))
    return user.join(answer, ["conv_id", "turn"]).join(system, "conv_id", "left")


def rendered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = prompt_pairs(spark, sf_dir)
    full, head = render_pair(F.col("prompt"), F.col("completion"), F.col("system"))
    return pairs.select("conv_id", "turn", full.alias("full_text"), head.alias("prompt_text"))


def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the rendered pairs over their own vocabulary, and the prompt length.

    Texts and ids have several readers and are kept once each.
    """
    texts = durable(rendered_pairs(spark, sf_dir).select(
        "conv_id", "turn", words(F.col("full_text")).alias("tokens"),
        F.size(words(F.col("prompt_text"))).alias("prompt_len"),
    ))
    ids = encode(texts, ["conv_id", "turn"], "tokens", build_vocabulary(texts, "tokens"), "full_ids")
    return durable(texts.drop("tokens").join(ids, ["conv_id", "turn"]))


def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as parallel output lines: a run is (conversation mod 4, turn).

    Some lines are blank, and the runs of residue 0 exist twice, as exact copies
    and with widened spaces.
    """
    turns = spread(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "turn")
    base = turns.select(
        F.concat(F.lit("run"), F.col("conv_id") % 4, F.lit("_"), F.col("turn")).alias("source"),
        F.floor(F.col("conv_id") / 4).alias("line_idx"),
        ((F.col("conv_id") % 4) * 1000 + F.col("turn")).alias("cand_idx"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, F.lit(" ")).otherwise(F.col("text")).alias("completion"),
    )
    first = base.where("cand_idx < 1000")

    def rerun(name: str, shift: int, text: Column) -> DataFrame:
        return first.select(
            F.concat(F.lit(name), F.col("source")).alias("source"), "line_idx",
            (F.col("cand_idx") + shift).alias("cand_idx"), text.alias("completion"),
        )

    copies = rerun("copy_", 10_000, F.col("completion"))
    widened = rerun("wide_", 20_000, F.replace(F.col("completion"), F.lit(" "), F.lit("  ")))
    return base.unionByName(copies).unionByName(widened)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user text of each four conversations."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.groupBy(F.floor(F.col("conv_id") / 4).alias("prompt_id")).agg(
        F.min_by("text", F.struct("conv_id", "turn")).alias("prompt")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned candidates with a stand-in for the model's log-probability."""
    aligned = align_candidates(prompts(spark, sf_dir), candidate_lines(spark, sf_dir))
    return (
        aligned.withColumn("logp_sum", F.length("completion") / F.lit(-100.0))
        .withColumn("token_count", F.size(words(F.col("completion"))).cast("bigint"))
        .withColumn("score_used", F.col("logp_sum") / F.col("token_count"))
    )


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference = document, hypothesis = the same with every third word dropped."""
    ref_tokens = words(F.col("text"))
    return (
        documents(spark, sf_dir)
        .select("doc_id", "lang", F.col("text").alias("ref"), ref_tokens.alias("ref_tokens"))
        .withColumn("hyp_tokens", F.filter("ref_tokens", lambda _, i: i % 3 != 2))
        .withColumn("hyp", F.array_join("hyp_tokens", " "))
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric records: user = run, event type = metric, id = step."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("n"),
    )
