"""Repetition penalties of texts too long to hold all their n-grams in one row.

A long text is cut into pieces that overlap by an n-gram less one, the pieces are dealt
out, and their n-grams counted per row in an aggregation that combines before its
shuffle.  Grams are compared by content, so the penalties are those of the row-wise form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.repetition import (
    CHAR_ORDER, WORD_ORDER, char_ngrams, max_run_penalty, sentence_repetition, with_repetition, word_ngrams,
)
from textloom.functions.text import null_to_empty, split_sentences

# Characters of a text beyond which it is taken apart, and of one piece.
LONG_CHARS = 1 << 20
PIECE_CHARS = 1 << 16
_WORD_CHARS = 8
_BATCH_CHARS = 1 << 22


def char_pieces(text: str, size: int, order: int) -> Iterator[str]:
    """Pieces of the stripped text that hold each of its grams of ``order`` characters once."""
    start, stop = len(text) - len(text.lstrip()), len(text.rstrip())
    for at in range(start, stop - order + 1, size):
        yield text[at:min(stop, at + size + order - 1)]


def word_pieces(text: str, size: int, order: int) -> Iterator[str]:
    """The same over words, ``size`` grams a piece, joined by single spaces."""
    held: list[str] = []
    for match in re.finditer(r"\S+", text):
        held.append(match.group())
        if len(held) == size + order - 1:
            yield " ".join(held)
            held = held[size:]
    if len(held) >= order:
        yield " ".join(held)


def _pieces(df: DataFrame, key: Sequence[str], text: str, piece_chars: int) -> DataFrame:
    names = [f"_k{i}" for i in range(len(key))]
    rows = df.select(null_to_empty(F.col(text)).alias("_text"), *[F.col(k).alias(n) for k, n in zip(key, names)])
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = batch.column(0)[i].as_py()
                own = batch.slice(i, 1).select(names)
                cuts = ((False, char_pieces(whole, piece_chars, CHAR_ORDER)), (True, word_pieces(whole, max(1, piece_chars // _WORD_CHARS), WORD_ORDER)))
                for by_word, pieces in cuts:
                    held, size, first = [], 0, 0
                    for piece in pieces:
                        held.append(piece)
                        size += len(piece)
                        if size >= _BATCH_CHARS:
                            yield made(own, by_word, first, held)
                            held, size, first = [], 0, first + len(held)
                    if held:
                        yield made(own, by_word, first, held)

    def made(own: pa.RecordBatch, by_word: bool, first: int, pieces: list[str]) -> pa.RecordBatch:
        n = len(pieces)
        repeated = [c.take(pa.array([0] * n, pa.int64())) for c in own.columns]
        numbers = pa.array(range(first, first + n), pa.int64())
        return pa.RecordBatch.from_arrays([*repeated, pa.array([by_word] * n), numbers, pa.array(pieces, pa.string())], names=[*names, "by_word", "at", "piece"])

    return rows.select(*["_text", *names]).mapInArrow(run, f"{kinds}, by_word boolean, at bigint, piece string")


def gram_penalties(df: DataFrame, key: Sequence[str], text: str, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``key, word_grams, char_grams``: the penalties of repeated 4-word and 8-character grams of each row that has any.

    ``key`` names a row.  A task holds one text and, behind that, a piece at a time.
    """
    names = [f"_k{i}" for i in range(len(key))]
    # Pieces of one text go to many tasks.
    pieces = _pieces(df, key, text, piece_chars).repartition(*names, "by_word", "at")
    grams = pieces.select(*names, "by_word", F.explode(
        F.when(F.col("by_word"), word_ngrams(F.col("piece"), WORD_ORDER)).otherwise(char_ngrams(F.col("piece"), CHAR_ORDER))
    ).alias("gram"))
    counts = grams.groupBy(*names, "by_word", "gram").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.groupBy(*names, "by_word").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different"))
    order = F.when(F.col("by_word"), WORD_ORDER).otherwise(CHAR_ORDER)
    penalty = F.when(F.col("total") > order, 1.0 - F.col("different") / F.col("total")).otherwise(0.0)
    both = shares.groupBy(*names).agg(
        F.max(F.when(F.col("by_word"), penalty)).alias("word_grams"), F.max(F.when(~F.col("by_word"), penalty)).alias("char_grams")
    )
    return both.select(*[F.col(n).alias(k) for n, k in zip(names, key)], F.coalesce("word_grams", F.lit(0.0)).alias("word_grams"),
                       F.coalesce("char_grams", F.lit(0.0)).alias("char_grams"))


def with_repetition_of_any_length(
    df: DataFrame, key: Sequence[str], text: str = "completion", long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``with_repetition``, with texts of over ``long_chars`` characters counted in pieces.

    The columns of ``key`` name a row and are not null.  Runs and sentences are linear in the row and stay there.
    """
    is_long = F.coalesce(F.length(text), F.lit(0)) > long_chars
    short = with_repetition(df.where(~is_long), text)
    long = df.where(is_long)
    counted = gram_penalties(long, key, text, piece_chars)
    word = F.greatest(F.coalesce("word_grams", F.lit(0.0)), F.coalesce("char_grams", F.lit(0.0)), max_run_penalty(F.col(text), "char"))
    apart = long.join(counted, list(key), "left").withColumn("word_rep_penalty", word).drop("word_grams", "char_grams")
    apart = apart.withColumn("sent_rep_penalty", sentence_repetition(split_sentences(F.col(text))))
    return short.unionByName(apart)
