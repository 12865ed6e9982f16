"""The best candidate of each prompt without comparing all pairs: exact branch and bound.

References come in rounds, the most probable ones first.  After a round a hypothesis
has the risk against the references so far, and bounds on the rest: none of the rest
may count, or all of it; and lengths alone say how similar two texts can be at most.
A hypothesis whose lowest possible risk lies above another one's highest is dropped.
Those that are left meet every reference, in the same fixed-point sums as the full
ranking, so the result is the same to the last bit.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.ngrams import BETA, chrf_matrix, chrf_words
from textloom.functions.repetition import with_repetition
from textloom.operators.candidates import SHARES, candidate_softmax
from textloom.operators.mbr import (
    BLOCK_CHARS, BLOCK_TEXTS, REPETITION_WEIGHT, Similarity, merged_texts, risk_of, unit_risks,
)
from textloom.operators.slices import number_rows
from textloom.session import durable

# The references of a round are so many times those of all rounds before.
GROWTH = 4
# More than what rounding can add up to in a bound.
_SLACK = 1e-9
# Lengths of the references still to come are summed up in so many classes per doubling.
_CLASSES = 4
_KEY = ["prompt_id", "seq"]


@F.pandas_udf(T.StructType().add("chars", "long").add("words", "long"))
def _lengths(texts: pd.Series) -> pd.DataFrame:
    """The characters and words that chrF counts in a text."""
    return pd.DataFrame({"chars": [len("".join(t.split())) for t in texts], "words": [len(chrf_words(t)) for t in texts]})


def most_similar(chars: Column, words: Column, ref: Column) -> Column:
    """Upper bound on chrF with any reference of a class, by lengths.

    No order has more matches than the shorter side has grams, so the mean precision is
    at most the larger of the two ratios of reference to hypothesis length, over
    characters and words; the mean recall the other way round.
    """
    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, F.least(F.lit(1.0), part / whole)).otherwise(1.0)

    precision = F.greatest(share(ref["most_chars"], chars), share(ref["most_words"], words))
    recall = F.greatest(share(chars, ref["least_chars"]), share(words, ref["least_words"]))
    weight = BETA * BETA
    total = weight * precision + recall
    return F.when(total > 0, (1 + weight) * precision * recall / total).otherwise(0.0)


def _blocks(rows: DataFrame, name: str, block_texts: int, block_chars: int) -> DataFrame:
    """Per prompt how many blocks its texts make."""
    return rows.groupBy("prompt_id").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(block_texts)), F.ceil(F.sum("chars") / F.lit(block_chars)), F.lit(1)
    ).cast("int").alias(name))


def _units(hyps: DataFrame, refs: DataFrame, block_texts: int, block_chars: int) -> DataFrame:
    """Units of work: every block of hypotheses with every block of references of its prompt."""
    sizes = _blocks(hyps, "_h", block_texts, block_chars).join(_blocks(refs, "_r", block_texts, block_chars), "prompt_id")

    def dealt(rows: DataFrame, own: str, other: str, is_hyp: bool) -> DataFrame:
        placed = rows.join(sizes, "prompt_id").withColumn("_own", F.pmod(F.xxhash64("seq"), F.col(own)).cast("int"))
        blocks = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return blocks.select(
            "prompt_id", "seq", "completion", "mass", F.lit(is_hyp).alias("is_hyp"), F.lit(not is_hyp).alias("is_ref"),
            F.col("_own" if is_hyp else "_other").alias("_hb"), F.col("_other" if is_hyp else "_own").alias("_rb"),
        )

    both = dealt(hyps, "_h", "_r", True).unionByName(dealt(refs, "_r", "_h", False))
    # As in the full ranking: partitions are not merged for being small.
    partitions = int(hyps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = F.collect_list(F.struct("seq", "completion", "mass", "is_hyp", "is_ref")).alias("m")
    grouped = both.repartition(partitions, "prompt_id", "_hb", "_rb").groupBy("prompt_id", "_hb", "_rb").agg(members)
    return grouped.select("prompt_id", "m.seq", "m.completion", "m.mass", "m.is_hyp", "m.is_ref")


def _bounded(state: DataFrame, rest: DataFrame, length_bound: bool) -> DataFrame:
    """What is left of the hypotheses once ``rest``, the references still to come, is bounded."""
    size = F.floor(F.log2(F.greatest(F.col("chars"), F.lit(1))) * _CLASSES)
    classes = rest.groupBy("prompt_id", size.alias("_c")).agg(
        F.min("chars").alias("least_chars"), F.max("chars").alias("most_chars"), F.min("words").alias("least_words"),
        F.max("words").alias("most_words"), F.sum(F.col("mass").cast(SHARES)).cast("double").alias("mass"),
    )
    # As many classes as texts have lengths, by quarters of a doubling.
    lists = classes.groupBy("prompt_id").agg(F.collect_list(F.struct(
        "mass", "least_chars", "most_chars", "least_words", "most_words")).alias("_rest"))
    joined = state.join(lists, "prompt_id", "left")
    none = F.array().cast(lists.schema["_rest"].dataType)
    classes_of = F.coalesce("_rest", none)

    def summed(share) -> Column:
        return F.aggregate(classes_of, F.lit(0.0), lambda total, ref: total + ref["mass"] * share(ref))

    least = summed(lambda ref: 1.0 - most_similar(F.col("chars"), F.col("words"), ref)) if length_bound else F.lit(0.0)
    so_far = risk_of(F.col("units"), F.col("rest")) + F.col("penalty")
    ranged = joined.withColumns({"_low": so_far + least, "_high": so_far + summed(lambda ref: F.lit(1.0))}).drop("_rest")
    best = ranged.groupBy("prompt_id").agg(F.min("_high").alias("_best"))
    return ranged.join(best, "prompt_id").where(F.col("_low") <= F.col("_best") + _SLACK).drop("_low", "_high", "_best")


def best_by_bounds(
    candidates: DataFrame, temperature: float = 1.0, similarity: Similarity = chrf_matrix, repetition_weight: float = REPETITION_WEIGHT, *,
    block_texts: int = BLOCK_TEXTS, block_chars: int = BLOCK_CHARS, length_bound: bool | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The candidate the full ranking puts first, and what it took to find it.

    First ``prompt_id, cand_idx, completion, risk, risk_final`` per prompt; then ``prompt_id, texts,
    pairs, compared``: the different texts, their pairs, and the pairs that were compared.  The
    length bound holds for chrF; with another ``similarity`` it is left out unless asked for.
    """
    length_bound = similarity is chrf_matrix if length_bound is None else length_bound
    bare = candidates.select("prompt_id", "cand_idx", "completion", "score_used")
    posterior = candidate_softmax(with_repetition(bare), temperature)
    penalty = repetition_weight * (F.col("word_rep_penalty") + F.col("sent_rep_penalty"))
    first = F.max_by("cand_idx", F.struct(F.col("score_used"), -F.col("cand_idx"))).alias("cand_idx")
    texts = durable(merged_texts(posterior, F.max(penalty).alias("penalty"), F.max("score_used").alias("score_used"), first))
    sizes = durable(texts.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("texts")))
    most = sizes.agg(F.max("texts")).first()[0] or 0
    lengths = texts.withColumn("_l", _lengths("completion")).select("*", "_l.chars", "_l.words").drop("_l")
    if most > block_texts:
        numbered = number_rows(lengths, ["prompt_id"], [F.desc("mass"), F.asc("text_id")], "seq").withColumn("seq", F.col("seq") - 1)
    else:
        # One round for all: any number will do.
        numbered = lengths.withColumn("seq", F.col("text_id").cast("bigint"))
    rows = durable(numbered)
    state = rows.select(*_KEY, "penalty", "chars", "words", F.lit(0).cast("bigint").alias("units"), F.lit(0).cast("bigint").alias("rest"))
    compared, low, high = [], 0, block_texts
    while low < most:
        in_round = rows.where((F.col("seq") >= low) & (F.col("seq") < high)) if most > block_texts else rows
        refs = in_round.select(*_KEY, "completion", "mass", "chars")
        hyps = refs if not low else state.select(*_KEY).join(rows, _KEY).select(*_KEY, "completion", "mass", "chars")
        if not low and most > block_texts:
            hyps = rows.select(*_KEY, "completion", "mass", "chars")
        sums = unit_risks(_units(hyps, refs, block_texts, block_chars), similarity, _KEY)
        gained = sums.select(*_KEY, F.col("units").alias("_units"), F.col("rest").alias("_rest"))
        state = state.join(gained, _KEY, "left").withColumns({
            "units": F.col("units") + F.coalesce("_units", F.lit(0)), "rest": F.col("rest") + F.coalesce("_rest", F.lit(0))
        }).drop("_units", "_rest")
        n_hyps = hyps.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_n"))
        n_refs = refs.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("_m"))
        compared.append(n_hyps.join(n_refs, "prompt_id").select("prompt_id", (F.col("_n") * F.col("_m")).alias("compared")))
        if high < most:
            state = _bounded(state, rows.where(F.col("seq") >= high), length_bound)
        # Each round reads what the one before has left more than once.
        state = durable(state)
        low, high = high, high * GROWTH
    numbers = state.join(rows.select(*_KEY, "completion", "score_used", "cand_idx"), _KEY).withColumn(
        "risk", risk_of(F.col("units"), F.col("rest"))
    ).withColumn("risk_final", F.col("risk") + F.col("penalty"))
    order = F.struct("risk_final", (-F.col("score_used")).alias("s"), "cand_idx", "completion", "risk")
    best = numbers.groupBy("prompt_id").agg(F.min(order).alias("b")).select("prompt_id", "b.cand_idx", "b.completion", "b.risk", "b.risk_final")
    work = sizes.withColumn("pairs", F.col("texts") * F.col("texts"))
    if compared:
        done = reduce(DataFrame.unionByName, compared).groupBy("prompt_id").agg(F.sum("compared").alias("compared"))
        work = work.join(done, "prompt_id")
    return best, work
