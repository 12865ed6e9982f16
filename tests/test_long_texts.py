"""Penalties of long texts in pieces against the form that stays in the row."""

import random

from pyspark.sql import functions as F

from textloom.functions.repetition import looping_penalty, sentence_repetition, with_repetition
from textloom.functions.text import split_sentences
from textloom.operators.long_texts import char_pieces, gram_penalties, with_repetition_of_any_length, word_pieces


def random_text(draw, longest):
    parts = ["ab", "c", "éè", "\U0001F600", "same same same", ". ", "\n", "\t", " ", "\x1c", "word", "aaaaaaaaaaaa", "　"]
    return "".join(draw.choice(parts) + draw.choice(["", " "]) for _ in range(draw.randint(0, longest)))


def test_pieces_hold_each_gram_once():
    draw = random.Random(51)
    for _ in range(200):
        text, size = random_text(draw, 40), draw.randint(1, 20)
        bare, words = text.strip(), text.split()
        chars = [p[i:i + 8] for p in char_pieces(text, size, 8) for i in range(len(p) - 7)]
        assert chars == [bare[i:i + 8] for i in range(len(bare) - 7)]
        grams = [" ".join(p.split()[i:i + 4]) for p in word_pieces(text, size, 4) for i in range(len(p.split()) - 3)]
        assert grams == [" ".join(words[i:i + 4]) for i in range(len(words) - 3)]


def test_same_penalties_as_in_the_row(spark):
    draw = random.Random(52)
    rows = [(i, i % 3, random_text(draw, draw.choice([3, 60, 400]))) for i in range(60)] + [(100, 0, None), (101, 1, ""), (102, 2, " \n")]
    df = spark.createDataFrame(rows, "a long, b int, completion string")
    want = {r.a: (r.word_rep_penalty, r.sent_rep_penalty) for r in with_repetition(df).collect()}
    for limit, piece in ((-1, 50), (100, 7), (10 ** 9, 50)):
        found = with_repetition_of_any_length(df, ["a", "b"], long_chars=limit, piece_chars=piece)
        assert {r.a: (r.word_rep_penalty, r.sent_rep_penalty) for r in found.collect()} == want
        assert sorted(found.columns) == sorted([*df.columns, "word_rep_penalty", "sent_rep_penalty"])


def test_one_long_text_is_many_tasks(spark):
    text = " ".join(str(i % 5000) for i in range(300_000))
    df = spark.createDataFrame([(1, text)], "a long, t string")
    found = gram_penalties(df, ["a"], "t", piece_chars=1 << 14).first()
    words = text.split()
    grams = {tuple(words[i:i + 4]) for i in range(len(words) - 3)}
    chars = {text[i:i + 8] for i in range(len(text) - 7)}
    assert found.word_grams == 1 - len(grams) / (len(words) - 3) and found.char_grams == 1 - len(chars) / (len(text) - 7)
    assert gram_penalties(df.where(F.lit(False)), ["a"], "t").collect() == []


def test_sentences_are_split_once(spark):
    df = spark.createDataFrame([("One is here. Two is here. " * 4,)], "t string")
    for penalty in (sentence_repetition, looping_penalty):
        found = df.select(penalty(split_sentences(F.col("t"))).alias("p"))
        # Inside a loop over sentences it would be split again for each of them.
        assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        assert found.first().p == 1.0
