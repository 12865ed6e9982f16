"""Branch and bound against the full ranking, and ranks that no division of the work changes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions.ngrams import chrf_matrix, exact_match_matrix
from textloom.operators import candidates as C
from textloom.operators import mbr
from textloom.operators.mbr_bounds import _lengths, best_by_bounds, most_similar

SCHEMA = "prompt_id int, cand_idx int, completion string, score_used double"


def make(seed, sizes, spread, words=12):
    draw = random.Random(seed)
    rows = []
    for prompt, n in enumerate(sizes):
        base = [draw.choice(["alpha", "beta", "gam", "delta.", "é", "of"]) for _ in range(words)]
        for j in range(n):
            kind = draw.random()
            text = list(base) if kind < 0.3 else base[: draw.randint(1, words)] if kind < 0.6 else [draw.choice(["x", "yy", "zzz", "of"]) for _ in range(draw.randint(1, 2 * words))]
            if draw.random() < 0.7:
                text[draw.randrange(len(text))] = f"w{draw.randrange(400)}"
            gap = "  " if draw.random() < 0.1 else " "
            rows.append((prompt, j, gap.join(text), round(-draw.random() * spread, 1)))
    return rows


def first_of_ranking(df):
    ranked = mbr.rank_by_risk(df, mbr.score_candidates(df)).where("rank_by_risk = 1")
    return sorted((r.prompt_id, r.cand_idx, r.completion, r.risk, r.risk_final) for r in ranked.collect())


@pytest.mark.parametrize("spread,block", [(1.0, 8), (30.0, 8), (30.0, 64)])
def test_equals_the_full_ranking_to_the_last_bit(spark, spread, block):
    df = spark.createDataFrame(make(31, [150, 40, 7, 1], spread), SCHEMA)
    best, work = best_by_bounds(df, block_texts=block)
    assert sorted(map(tuple, best.collect())) == first_of_ranking(df)
    counts = {r.prompt_id: (r.texts, r.pairs, r.compared) for r in work.collect()}
    assert all(pairs == n * n and 0 < compared <= pairs for n, pairs, compared in counts.values())
    if spread > 10 and block == 8:
        # Most of the mass is in the first references.
        assert counts[0][2] < 0.35 * counts[0][1]


def test_other_similarities_have_no_length_bound(spark):
    df = spark.createDataFrame(make(32, [60], 5.0), SCHEMA)
    best, _ = best_by_bounds(df, similarity=exact_match_matrix, block_texts=4)
    scored = mbr.score_candidates(df, similarity=exact_match_matrix)
    want = mbr.rank_by_risk(df, scored).where("rank_by_risk = 1").first()
    assert best.first().cand_idx == want.cand_idx and best.first().risk == want.risk


def test_length_bound_holds(spark):
    texts = sorted({r[2] for r in make(33, [60], 1.0)} | {"", "a", "a b", "....", "é" * 40})
    sims = chrf_matrix(texts, texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("l", _lengths("t")).select("i", "l.chars", "l.words")
    ref = F.struct(*[F.col(f"b.{c}").alias(f"{side}_{c}") for side in ("least", "most") for c in ("chars", "words")])
    pairs = rows.alias("a").join(rows.alias("b"), F.lit(True)).select(
        F.col("a.i").alias("i"), F.col("b.i").alias("j"), most_similar(F.col("a.chars"), F.col("a.words"), ref).alias("u"))
    assert all(sims[r.i, r.j] <= r.u + 1e-12 for r in pairs.collect())


def test_empty_and_null_scores(spark):
    best, work = best_by_bounds(spark.createDataFrame([], SCHEMA))
    assert best.collect() == [] and work.collect() == []
    df = spark.createDataFrame([(0, 0, "a b", float("-inf")), (0, 1, "a c", float("-inf")), (0, 2, "a c", float("-inf"))], SCHEMA)
    assert best_by_bounds(df)[0].first().cand_idx == first_of_ranking(df)[0][1] == 1


def test_risks_and_ranks_are_bit_equal_at_any_partitioning(spark):
    rows = make(34, [90, 25], 2.0)
    # Texts of equal risk that differ in white space, and many equal scores.
    rows += [(p, 1000 + j, t.replace(" ", "\t"), s) for p, j, t, s in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n, blocks in ((1, 64), (8, 16), (211, 7)):
            spark.conf.set("spark.sql.shuffle.partitions", str(min(n, 24)))
            df = spark.createDataFrame(rows, SCHEMA).repartition(n)
            posterior = C.candidate_softmax(df)
            risks = mbr.expected_risk(posterior, block_texts=blocks)
            ranked = mbr.rank_by_risk(df, mbr.score_candidates(df, risk_temperature=0.05))
            results.append((
                sorted((r.prompt_id, r.cand_idx, r.p_model.hex(), r.risk.hex()) for r in risks.collect()),
                sorted((r.prompt_id, r.rank_by_risk, r.cand_idx, r.risk_final.hex(), r.p_risk.hex()) for r in ranked.collect()),
            ))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_fixed_parts():
    draw = np.random.default_rng(5)
    values = draw.random((3, 4000)) * 10.0 ** -draw.integers(0, 12, (3, 4000)) / 4000
    whole, rest = mbr.fixed_parts(values)
    shuffled = mbr.fixed_parts(values[:, draw.permutation(4000)])
    assert (whole == shuffled[0]).all() and (rest == shuffled[1]).all()
    assert np.allclose((whole + rest / mbr._REST) / mbr._UNIT, values.sum(axis=1), rtol=1e-14)
