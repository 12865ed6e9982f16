"""Scores of hypothesis/reference tables: pairing, chrF++, BLEU, gram overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.ngrams import (
    BETA, BLEU_ORDER, CHRF_ORDERS, bleu_score, chrf_counts, chrf_score, token_counts,
)
from textloom.functions.text import strip


def pair_lines(hyps: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pair by key and flag keys that only one side has."""
    left = hyps.select(*keys, F.col("text").alias("hyp"), F.lit(True).alias("_h"))
    right = refs.select(*keys, F.col("text").alias("ref"), F.lit(True).alias("_r"))
    return (
        left.join(right, list(keys), "full_outer")
        .withColumn("mismatch", F.col("_h").isNull() | F.col("_r").isNull())
        .drop("_h", "_r")
    )


def gram_overlap(df: DataFrame, keys: Sequence[str], hyp_tokens: str, ref_tokens: str, max_order: int) -> DataFrame:
    """Per row and order: gram totals of both sides and clipped matches.

    Up to BLEU_ORDER the counts are made inside each row, so no gram is ever a row.
    For higher orders the rows are partitioned by their key once; both aggregations
    then run where the rows are and no gram crosses the network.  An order without
    any gram keeps its row of zeros.
    """
    if max_order <= BLEU_ORDER:
        counted = df.select(*keys, token_counts(F.col(hyp_tokens), F.col(ref_tokens)).alias("_c"))
        orders = F.array(*[
            F.struct(F.lit(n + 1).alias("order"), *[
                F.get("_c", F.lit(3 * n + i)).cast("long").alias(name) for i, name in enumerate(("hyp_grams", "ref_grams", "matches"))
            ]) for n in range(max_order)
        ])
        return counted.select(*keys, F.explode(orders).alias("o")).select(*keys, "o.*")
    return _gram_overlap_by_rows(df, keys, hyp_tokens, ref_tokens, max_order)


def _gram_overlap_by_rows(df: DataFrame, keys: Sequence[str], hyp_tokens: str, ref_tokens: str, max_order: int) -> DataFrame:
    def grams_of(tokens: Column, n: int, is_ref: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(tokens) - n)

        def gram(i: Column) -> Column:
            text = F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]) if n > 1 else F.get(tokens, i)
            return F.struct(F.lit(n).alias("order"), text.alias("gram"), F.lit(is_ref).alias("is_ref"))

        none = F.array().cast("array<struct<order:int,gram:string,is_ref:int>>")
        return F.when(F.size(tokens) >= n, F.transform(starts, gram)).otherwise(none)

    def grams(tokens: Column, is_ref: int) -> Column:
        return F.concat(*[grams_of(tokens, n, is_ref) for n in range(1, max_order + 1)])

    # A gramless marker per order keeps rows and orders that have no gram.
    markers = F.array(*[
        F.struct(F.lit(n).alias("order"), F.lit(None).cast("string").alias("gram"), F.lit(0).alias("is_ref"))
        for n in range(1, max_order + 1)
    ])
    exploded = df.repartition(*keys).select(
        *keys,
        F.explode(F.concat(grams(F.col(hyp_tokens), 0), grams(F.col(ref_tokens), 1), markers)).alias("g"),
    )
    present = F.col("g.gram").isNotNull()
    counted = exploded.groupBy(*keys, F.col("g.order").alias("order"), F.col("g.gram").alias("gram")).agg(
        F.sum(F.when(present & (F.col("g.is_ref") == 0), 1).otherwise(0)).alias("h"),
        F.sum(F.when(present & (F.col("g.is_ref") == 1), 1).otherwise(0)).alias("r"),
    )
    return counted.groupBy(*keys, "order").agg(
        F.sum("h").alias("hyp_grams"), F.sum("r").alias("ref_grams"), F.sum(F.least("h", "r")).alias("matches")
    )


def _as_columns(counts: str, n: int) -> list[Column]:
    return [F.get(F.col(counts), F.lit(i)) for i in range(n)]


def sentence_chrf(df: DataFrame, hyp: str = "hyp", ref: str = "ref", out: str = "chrf", beta: float = BETA) -> DataFrame:
    """chrF++ in 0..1 of each row."""
    n = 3 * CHRF_ORDERS
    counted = df.withColumn("_c", chrf_counts(F.col(hyp), F.col(ref)))
    spread = counted.select(*df.columns, *[c.alias(f"_c{i}") for i, c in enumerate(_as_columns("_c", n))])
    return spread.withColumn(out, chrf_score([F.col(f"_c{i}") for i in range(n)], beta)).select(*df.columns, out)


def _summed(df: DataFrame, by: Sequence[str], counts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Sum named count arrays per group, one column per position."""
    with_counts = df.select(*by, *[expr.alias(name) for name, (expr, _) in counts.items()])
    sums = [
        F.sum(c).alias(f"{name}{i}")
        for name, (_, n) in counts.items()
        for i, c in enumerate(_as_columns(name, n))
    ]
    return with_counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def _stripped(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: strip(F.coalesce(F.col(c), F.lit(""))) for c in columns})


def corpus_chrf(df: DataFrame, by: Sequence[str], hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """Corpus chrF++ in 0..100: counts summed over rows, one F at the end."""
    n = 3 * CHRF_ORDERS
    pairs = _stripped(df, hyp, ref)
    summed = _summed(pairs, by, {"_c": (chrf_counts(F.col(hyp), F.col(ref)), n)})
    return summed.select(*by, "n", (100.0 * chrf_score([F.col(f"_c{i}") for i in range(n)])).alias("chrf"))


def corpus_bleu(df: DataFrame, by: Sequence[str], hyp_tokens: str, ref_tokens: str) -> DataFrame:
    """Corpus BLEU-4 in 0..100 over token columns."""
    n = 3 * BLEU_ORDER
    summed = _summed(df, by, {"_b": (token_counts(F.col(hyp_tokens), F.col(ref_tokens)), n)})
    return summed.select(*by, "n", bleu_score([F.col(f"_b{i}") for i in range(n)]).alias("bleu"))


def corpus_scores(
    df: DataFrame, by: Sequence[str], hyp: str, ref: str, hyp_tokens: str, ref_tokens: str
) -> DataFrame:
    """chrF++ and BLEU of each group in one pass over the rows."""
    nc, nb = 3 * CHRF_ORDERS, 3 * BLEU_ORDER
    summed = _summed(_stripped(df, hyp, ref), by, {
        "_c": (chrf_counts(F.col(hyp), F.col(ref)), nc),
        "_b": (token_counts(F.col(hyp_tokens), F.col(ref_tokens)), nb),
    })
    return summed.select(
        *by, "n",
        (100.0 * chrf_score([F.col(f"_c{i}") for i in range(nc)])).alias("chrf"),
        bleu_score([F.col(f"_b{i}") for i in range(nb)]).alias("bleu"),
    )
