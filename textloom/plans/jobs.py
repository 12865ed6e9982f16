"""Whole jobs from files to files: prepare, rank, evaluate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.arrays import length_norm_score
from textloom.functions.chat import DEFAULT_TEMPLATE, ChatTemplate, render_pair
from textloom.functions.ngrams import chrf_matrix
from textloom.functions.templates import UserTemplate
from textloom.functions.text import words
from textloom.operators import mbr
from textloom.operators.candidates import align_candidates, dedupe_candidates, short_sources
from textloom.operators.fidelity import attach_manifest, fidelity_rows, fidelity_scores
from textloom.operators.overlap import corpus_scores, pair_lines
from textloom.operators.slices import number_rows
from textloom.operators.tokens import tokenize, training_row
from textloom.session import configure, durable
from textloom.sources import readers, writers


def prepare_training_set(
    spark: SparkSession, csv_path: str, out: str, make_encoder: Callable[[], Callable[[str], list[int]]], *,
    max_length: int = 2048, system_prompt: str | None = None, template: ChatTemplate | UserTemplate = DEFAULT_TEMPLATE,
    delimiter: str = ",", encoding: str = "utf-8", prompt_col: str = "prompt", completion_col: str = "completion",
) -> None:
    """Prompt/completion CSV to a tokenized, masked set with its settings beside."""
    configure(spark)
    pairs = readers.read_pairs(spark, csv_path, prompt_col, completion_col, delimiter, encoding)
    readers.require_rows(pairs, "no rows left after cleaning prompt and completion")
    full, head = render_pair(F.col("prompt"), F.col("completion"), F.lit(system_prompt), template)
    texts = pairs.select("source", "row_id", full.alias("full"), head.alias("head"))
    encoded = tokenize(tokenize(texts, "full", make_encoder, "full_ids"), "head", make_encoder, "head_ids")
    rows = encoded.select("source", "row_id", *training_row(F.col("full_ids"), F.size("head_ids"), max_length))
    writers.write_tokenized(rows, out, {
        "csv_path": csv_path, "max_length": max_length, "system_prompt": system_prompt,
        "delimiter": delimiter, "encoding": encoding,
    })


def rank_outputs(
    spark: SparkSession, prompts_path: str, output_paths: str | list[str],
    add_logprobs: Callable[[DataFrame], DataFrame], *,
    length_norm: bool = False, temperature: float = 1.0, risk_temperature: float = 1.0,
    strict: bool = False, dedupe: bool = False, similarity: mbr.Similarity = chrf_matrix,
) -> DataFrame:
    """Ranked candidates of each prompt from parallel output files.

    ``add_logprobs`` adds ``logp_sum`` and ``token_count`` from the model.
    Sources are ordered as the paths are given, then by name.  With ``strict`` a
    short or empty file is an error.
    """
    configure(spark)
    prompts = readers.read_prompts(spark, prompts_path)
    lines = readers.read_parallel_lines(spark, output_paths)
    files = durable(readers.list_files(spark, output_paths))
    if strict:
        short = short_sources(lines, prompts.count(), files).limit(5).collect()
        if short:
            raise ValueError(f"files with too few lines: {[(r.source, r.n_lines) for r in short]}")
    sources = number_rows(files, [], [F.asc("place"), F.asc("source")], "cand_idx").drop("place")
    candidates = align_candidates(prompts, lines.join(sources, "source"))
    if dedupe:
        candidates = dedupe_candidates(candidates)
    # The model runs once, whatever reads its numbers later.
    scored = durable(add_logprobs(candidates).withColumn(
        "score_used", length_norm_score(F.col("logp_sum"), F.col("token_count"), length_norm)
    ))
    return mbr.rank_by_risk(scored, mbr.score_candidates(scored, temperature, risk_temperature, similarity))


def write_ranking(ranked: DataFrame, csv: str, best: str | None = None, json: str | None = None) -> None:
    """Write a ranking as CSV, and its best lines and JSON rows if asked for."""
    kept = durable(ranked)
    writers.write_ranked_csv(kept, csv)
    if best is not None:
        writers.write_best_lines(kept.where("rank_by_risk = 1"), best)
    if json is not None:
        writers.write_ranked_json(kept, json)


def evaluate_translation(
    spark: SparkSession, hyp_path: str, ref_path: str, hyp_field: str = "generations", ref_field: str = "completion",
    tokens: Callable[[Column], Column] = words,
) -> DataFrame:
    """One row ``n, chrf, bleu`` of a file pair; files of unequal length are an error."""
    configure(spark)
    pairs = durable(pair_lines(
        readers.read_texts(spark, hyp_path, hyp_field), readers.read_texts(spark, ref_path, ref_field), ["line_idx"]
    ))
    unpaired = pairs.where("mismatch").count()
    if unpaired:
        raise ValueError(f"{unpaired} lines of {hyp_path} and {ref_path} have no partner")
    split = pairs.withColumn("hyp_tokens", tokens(F.col("hyp"))).withColumn("ref_tokens", tokens(F.col("ref")))
    return corpus_scores(split, [], "hyp", "ref", "hyp_tokens", "ref_tokens")


def evaluate_fidelity(
    lines: DataFrame, manifest: DataFrame, add_classes: Callable[[DataFrame], DataFrame],
    target_lang: str = "ara", require_target_lang: bool = True, allow_msa: bool = False,
) -> DataFrame:
    """Fidelity means of each file: ``source, dialect, n`` and the four metrics.

    ``lines`` has ``source, text``; the manifest gives each source its dialect;
    ``add_classes`` adds ``code, logits, dialectness`` from the models.
    """
    configure(lines.sparkSession)
    classed = add_classes(attach_manifest(lines, manifest)).withColumn("target_lang", F.lit(target_lang))
    return fidelity_scores(fidelity_rows(classed, require_target_lang, allow_msa), ["source", "dialect"])
