"""Repetition penalties in [0, 1], all computed inside the row.

No penalty explodes or shuffles: distinct counts use hash sets over arrays, and
n-grams come from one linear regular-expression pass, so a long text costs time
in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.arrays import let
from textloom.functions.text import collapse, null_to_empty, split_sentences, strip, words

# Fixed values of the penalty curves.
WORD_ORDER = 4
CHAR_ORDER = 8
FREE_RUN = 3
RUN_SCALE = 8.0
MIN_SENTENCE_CHARS = 10
MAX_PERIOD = 6
MIN_LOOP_REPEATS = 3
COVER_FLOOR = 0.6
COVER_SPAN = 0.4


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping n-grams of code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def word_ngrams(text: Column, n: int) -> Column:
    """Overlapping n-grams of words, each joined by single spaces."""
    gram = " ".join(["[^ ]+"] * n)
    return F.regexp_extract_all(collapse(text), F.lit(f"(?=({gram}))[^ ]+"), F.lit(1))


def rep_ngram_penalty(text: Column, n: int = WORD_ORDER, level: str = "word") -> Column:
    """Share of n-grams that repeat an earlier one; 0 below ``2n`` tokens."""
    text = null_to_empty(text)
    if level == "word":
        grams = word_ngrams(text, n)
    elif level == "char":
        grams = char_ngrams(strip(text), n)
    else:
        raise ValueError(f"runs and grams are counted over words or characters, not over {level!r}")
    # 2n tokens make n + 1 grams.
    return let(
        grams,
        lambda g: F.when(F.size(g) > n, 1.0 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0),
    )


def _longest_equal_run(tokens: Column) -> Column:
    start = F.struct(
        F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")
    )

    def step(state: Column, token: Column) -> Column:
        run = F.when(state["last"] == token, state["run"] + 1).otherwise(F.lit(1))
        return F.struct(token.alias("last"), run.alias("run"), F.greatest(state["best"], run).alias("best"))

    return F.aggregate(tokens, start, step, lambda state: state["best"])


def max_run_penalty(text: Column, level: str = "char") -> Column:
    """Soft penalty for the longest run of one token beyond the free length."""
    text = null_to_empty(text)
    if level == "char":
        # Runs up to the free length cost nothing, so only longer ones are extracted.
        pattern = rf"(?s)(.)\1{{{FREE_RUN},}}"
        runs = F.regexp_extract_all(strip(text), F.lit(pattern), F.lit(0))
        longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    elif level == "word":
        longest = _longest_equal_run(words(text))
    else:
        raise ValueError(f"runs and grams are counted over words or characters, not over {level!r}")
    return 1.0 - F.exp(-F.greatest(F.lit(0), longest - FREE_RUN) / F.lit(RUN_SCALE))


def repeated_sentence_penalty(sentences: Column, zero_when_unique: bool = False) -> Column:
    """Larger of the repeated share and the share of the most frequent sentence.

    With no repeat at all the second share is still ``1/k``; set
    ``zero_when_unique`` to return 0 there.
    """
    long_ones = F.filter(sentences, lambda s: F.length(s) >= MIN_SENTENCE_CHARS)
    start = F.struct(
        F.lit(None).cast("string").alias("last"),
        F.lit(0).alias("run"), F.lit(0).alias("repeated"), F.lit(0).alias("top"),
    )

    def step(state: Column, sentence: Column) -> Column:
        run = F.when(state["last"] == sentence, state["run"] + 1).otherwise(F.lit(1))
        # The second copy brings in the first one too.
        gained = F.when(run == 1, 0).when(run == 2, 2).otherwise(1)
        return F.struct(
            sentence.alias("last"), run.alias("run"),
            (state["repeated"] + gained).alias("repeated"),
            F.greatest(state["top"], run).alias("top"),
        )

    def finish(state: Column) -> Column:
        peak = F.greatest(state["repeated"], state["top"])
        if zero_when_unique:
            peak = F.when(state["top"] > 1, peak).otherwise(F.lit(0))
        return peak

    peak = F.aggregate(F.array_sort(long_ones), start, step, finish)
    return F.when(F.size(long_ones) > 1, peak / F.size(long_ones)).otherwise(0.0)


def looping_penalty(
    sentences: Column, max_period: int = MAX_PERIOD, min_repeats: int = MIN_LOOP_REPEATS
) -> Column:
    """How far the sentences follow one short cycle, from 60% (0) to 100% (1)."""
    # Bound once: an expression inside the loop would be computed anew for every sentence.
    return let(sentences, lambda bound: _looping(bound, max_period, min_repeats))


def _looping(sentences: Column, max_period: int, min_repeats: int) -> Column:
    n = F.size(sentences)
    # A period that does not fit min_repeats times counts nothing.
    def agreeing(period: int) -> Column:
        return F.size(F.filter(sentences, lambda s, i: s == F.get(sentences, i % period)))

    hits = [
        F.when(n >= period * min_repeats, agreeing(period)).otherwise(0)
        for period in range(1, max_period + 1)
    ]
    cover = F.greatest(*hits, F.lit(0)) / n
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cover - COVER_FLOOR) / F.lit(COVER_SPAN)))
    return F.when(n >= max(6, 2 * min_repeats), scaled).otherwise(0.0)


def sentence_repetition(sentences: Column) -> Column:
    """Sentence-level penalty of a text given its sentences.

    They are bound once, also where an expression that splits a text is given.
    """
    return let(sentences, lambda s: F.greatest(repeated_sentence_penalty(s), looping_penalty(s)))


def word_repetition(text: Column) -> Column:
    """Token-level penalty: repeated 4-word and 8-character grams, long runs."""
    return F.greatest(
        rep_ngram_penalty(text, WORD_ORDER, "word"),
        rep_ngram_penalty(text, CHAR_ORDER, "char"),
        max_run_penalty(text, "char"),
    )


def with_repetition(df, text_col: str = "completion"):
    """Add ``word_rep_penalty`` and ``sent_rep_penalty``; sentences are split once."""
    return (
        df.withColumn("_sentences", split_sentences(F.col(text_col)))
        .withColumn("word_rep_penalty", word_repetition(F.col(text_col)))
        .withColumn("sent_rep_penalty", sentence_repetition(F.col("_sentences")))
        .drop("_sentences")
    )
