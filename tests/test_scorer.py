"""The scorer hook: every row once and in order, or an error that names it."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators.tokens import length_batches, score_texts

SCHEMA = "doc long, part string, score double"


def texts(spark, n=300):
    draw = random.Random(41)
    rows = [(i // 3, "abc"[i % 3], None if i == 7 else "x" * draw.choice([0, 1, 5, 80, 3000])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc long, part string, text string").repartition(3)


def lengths():
    def score(frame):
        sizes = frame["text"].fillna("").str.len()
        assert len(frame) <= 16 and (len(frame) == 1 or len(frame) * sizes.max() <= 4000)
        return frame[["doc", "part"]].assign(score=sizes.astype(float))

    return score


@pytest.mark.parametrize("rows,chars,hold", [(16, 4000, 4096), (5, 300, 4096), (16, 4000, 7), (1, 1, 50)])
def test_results_do_not_depend_on_batches(spark, rows, chars, hold):
    given, df = texts(spark)
    found = score_texts(df, lengths, SCHEMA, rows, key=["doc", "part"], text="text", batch_chars=chars, hold_rows=hold)
    assert sorted((r.doc, r.part, r.score) for r in found.collect()) == sorted((d, p, float(len(t or ""))) for d, p, t in given)


@pytest.mark.parametrize("change,said", [
    (lambda f: f[f["doc"] != 5], "lost row {'doc': 5"), (lambda f: f.iloc[::-1], "another order row"),
    (lambda f: f.loc[[*f.index, *f.index[f["doc"] == 9]]], "twice, row {'doc': 9"),
])
def test_lost_doubled_and_moved_rows_are_errors(spark, change, said):
    _, df = texts(spark, 60)

    def make():
        return lambda frame: change(frame[["doc", "part"]].assign(score=0.0))

    with pytest.raises(Exception) as caught:
        score_texts(df, make, SCHEMA, 16, key=["doc", "part"]).collect()
    assert said in str(caught.value)


def test_without_a_key_the_number_is_compared(spark):
    _, df = texts(spark, 30)
    with pytest.raises(Exception, match="rows for"):
        score_texts(df, lambda: lambda f: f[["doc", "part"]].assign(score=0.0).iloc[1:], SCHEMA).collect()
    ok = score_texts(df, lambda: lambda f: f[["doc", "part"]].assign(score=1.0), SCHEMA)
    assert ok.agg(F.sum("score")).first()[0] == 30


def test_length_batches():
    assert length_batches([5, 1, 5, 1], 2, 100) == [[1, 3], [0, 2]]
    assert length_batches([50, 1, 200], 8, 100) == [[1, 0], [2]]
    assert length_batches([], 8, 100) == []
