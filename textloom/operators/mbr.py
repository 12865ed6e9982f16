"""Minimum-Bayes-risk ranking of the candidates of each prompt.

The risk of a candidate needs its similarity to every other one.  Equal texts
are merged first; then the texts of a prompt are cut into blocks and each pair
of blocks is one unit of work that returns one partial sum per hypothesis.  No
pair is ever a row, no unit grows with the prompt, and a prompt with few
candidates is a single unit.  Sums are taken in fixed-point numbers, so risks and
ranks are the same to the last bit however the work is divided.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.ngrams import chrf_matrix
from textloom.functions.repetition import with_repetition
from textloom.operators.candidates import SHARES, candidate_softmax, group_softmax
from textloom.operators.slices import number_rows
from textloom.session import durable

BLOCK_TEXTS = 64
BLOCK_CHARS = 1 << 20
# Fixed value: weight of each repetition penalty in the final risk.
REPETITION_WEIGHT = 0.1
# Partial risks are whole numbers of these two units, so their sums are exact in any order.
_UNIT, _REST = 2.0 ** 60, 2.0 ** 36

SCORES = ["p_model", "risk", "word_rep_penalty", "sent_rep_penalty", "risk_final", "p_risk"]

Similarity = Callable[[Sequence[str], Sequence[str]], np.ndarray]


def _tiles(texts: DataFrame, block_texts: int, block_chars: int) -> DataFrame:
    """Place each text in all (hypothesis block, reference block) units it takes part in."""
    sizes = texts.groupBy("prompt_id").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / F.lit(block_texts)),
            F.ceil(F.sum(F.length("completion")) / F.lit(block_chars)),
        ).cast("int").alias("_blocks")
    )
    placed = texts.join(sizes, "prompt_id").withColumn(
        "_block", F.pmod(F.xxhash64("text_id"), F.col("_blocks")).cast("int")
    )

    def unit(hyp_block, ref_block, is_hyp: bool, is_ref: bool):
        return F.struct(
            hyp_block.alias("hyp_block"), ref_block.alias("ref_block"),
            F.lit(is_hyp).alias("is_hyp"), F.lit(is_ref).alias("is_ref"),
        )

    own = F.col("_block")
    others = F.filter(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: b != own)
    units = F.concat(
        F.array(unit(own, own, True, True)),
        F.transform(others, lambda b: unit(own, b, True, False)),
        F.transform(others, lambda b: unit(b, own, False, True)),
    )
    # A stated number of partitions: the work of a unit is quadratic in its
    # bytes, so partitions must not be merged for being small.
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        placed.select("prompt_id", "completion", "mass", F.explode(units).alias("u"))
        .select("prompt_id", "completion", "mass", "u.*")
        .repartition(partitions, "prompt_id", "hyp_block", "ref_block")
        .groupBy("prompt_id", "hyp_block", "ref_block")
        .agg(F.collect_list(F.struct("completion", "mass", "is_hyp", "is_ref")).alias("m"))
        .select("prompt_id", "m.completion", "m.mass", "m.is_hyp", "m.is_ref")
    )


def merged_texts(candidates: DataFrame, *also: Column) -> DataFrame:
    """``prompt_id, completion, mass, text_id``: equal texts of a prompt as one, with the sum of their probabilities."""
    return candidates.groupBy("prompt_id", "completion").agg(
        F.sum(F.col("p_model").cast(SHARES)).cast("double").alias("mass"), F.min("cand_idx").alias("text_id"), *also
    )


def fixed_parts(risks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the last axis, of 1 at most as the shares of a prompt are, in two whole numbers that add up exactly."""
    scaled = risks * _UNIT
    units = np.floor(scaled)
    return units.astype(np.int64).sum(axis=-1), np.floor((scaled - units) * _REST).astype(np.int64).sum(axis=-1)


def risk_of(units: Column, rest: Column) -> Column:
    """The risk that summed parts stand for."""
    return (units.cast("double") + rest.cast("double") / F.lit(_REST)) / F.lit(_UNIT)


def unit_risks(units: DataFrame, similarity: Similarity, keys: Sequence[str]) -> DataFrame:
    """``keys, units, rest`` per hypothesis of a unit of work: its summed risk against the unit's references.

    A unit has arrays ``mass, is_hyp, is_ref, completion`` and one array per key; ``prompt_id`` is a column.
    """
    named = [k for k in keys if k != "prompt_id"]
    kinds = {f.name: f.dataType for f in units.schema}
    schema = ", ".join([f"prompt_id {kinds['prompt_id'].simpleString()}", *[f"{k} {kinds[k].elementType.simpleString()}" for k in named]])

    def partial_risks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for row in batch.to_dict("records"):
                is_hyp, is_ref = np.asarray(row["is_hyp"], bool), np.asarray(row["is_ref"], bool)
                hyps = [t for t, keep in zip(row["completion"], is_hyp) if keep]
                refs = [t for t, keep in zip(row["completion"], is_ref) if keep]
                mass = np.asarray(row["mass"], float)[is_ref]
                whole, rest = fixed_parts((1.0 - similarity(hyps, refs)) * mass)
                own = {k: [v for v, keep in zip(row[k], is_hyp) if keep] for k in named}
                done.append(pd.DataFrame({"prompt_id": row["prompt_id"], **own, "units": whole, "rest": rest}))
            if done:
                yield pd.concat(done, ignore_index=True)

    parts = units.mapInPandas(partial_risks, f"{schema}, units bigint, rest bigint")
    return parts.groupBy(*keys).agg(F.sum("units").alias("units"), F.sum("rest").alias("rest"))


def expected_risk(
    candidates: DataFrame,
    similarity: Similarity = chrf_matrix,
    block_texts: int = BLOCK_TEXTS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Add ``risk``: sum over j of ``p_model[j] * (1 - similarity(i, j))``.

    ``similarity(hyps, refs)`` returns a matrix in 0..1.
    """
    # Read for the block sizes and for the blocks, so kept: key, text and two numbers.
    texts = durable(merged_texts(candidates))
    keys = ["prompt_id", "completion"]
    sums = unit_risks(_tiles(texts, block_texts, block_chars), similarity, keys)
    return candidates.join(sums.select(*keys, risk_of(F.col("units"), F.col("rest")).alias("risk")), keys)


def final_risk(risked: DataFrame, repetition_weight: float = REPETITION_WEIGHT) -> DataFrame:
    """Add ``risk_final``: the expected risk plus the weighted repetition penalties."""
    penalty = F.col("word_rep_penalty") + F.col("sent_rep_penalty")
    return risked.withColumn("risk_final", F.col("risk") + repetition_weight * penalty)


def score_candidates(
    candidates: DataFrame,
    temperature: float = 1.0,
    risk_temperature: float = 1.0,
    similarity: Similarity = chrf_matrix,
    repetition_weight: float = REPETITION_WEIGHT,
) -> DataFrame:
    """Keys and numbers of aligned candidates: posterior, risk, penalties, final risk.

    Two results have several readers and are kept: the candidates with their
    posterior and penalties, without prompt text, and the risks, which hold no text
    any more.
    """
    bare = candidates.select("prompt_id", "cand_idx", "completion", "score_used")
    posterior = durable(candidate_softmax(with_repetition(bare), temperature))
    risked = final_risk(expected_risk(posterior, similarity), repetition_weight)
    numbers = durable(risked.select("prompt_id", "cand_idx", "score_used", *[c for c in SCORES if c != "p_risk"]))
    return group_softmax(numbers, ["prompt_id"], -F.col("risk_final"), risk_temperature, "p_risk")


def _ranking(scored: DataFrame) -> list:
    """Low final risk, then high model score, then candidate order.

    These are the orders of ``p_risk`` and ``p_model``, which underflow at a low
    temperature and so are not compared themselves.  Only a table that holds no risks
    is ranked by its probabilities.
    """
    if "risk_final" not in scored.columns:
        return [F.desc("p_risk"), F.desc("p_model"), F.asc("cand_idx")]
    return [F.asc("risk_final"), F.desc("score_used"), F.asc("cand_idx")]


def rank_by_risk(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Candidates with their numbers and ``rank_by_risk`` from 1.

    Only keys and numbers are sorted; the texts join by key.
    """
    ranks = number_rows(scored, ["prompt_id"], _ranking(scored), "rank_by_risk")
    return candidates.join(ranks.drop("score_used"), ["prompt_id", "cand_idx"])


def best_candidates(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """First-ranked candidate of each prompt.

    ``row_number = 1`` becomes a limit in each map task, so no prompt is sorted
    as a whole.
    """
    window = Window.partitionBy("prompt_id").orderBy(*_ranking(scored))
    best = scored.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") == 1).drop("_rn")
    return candidates.join(best.drop("score_used"), ["prompt_id", "cand_idx"])
