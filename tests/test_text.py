import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import chat, repetition as R, text as T
from tests import plain

ALPHABET = list("ab cدو。؟! .;\n\t　😀é,") + ["aa ", "word ", "the end. "]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += ["aaaa" * rng.randint(1, 6) for _ in range(5)]
    texts += ["Same long sentence. " * k for k in range(1, 8)]
    texts += ["first one here. second one here. " * k for k in range(1, 6)]
    return texts


def column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_normalize_hand_cases(spark):
    assert column(spark, [None, "NaN", " nan ", "\tx ", ""], T.normalize_text) == ["", "", "", "x", ""]


def test_strip_and_words_follow_python(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(T.SPACES) == sorted(spaces)
    texts = [f"{s}a{s}{s}b{s}" for s in spaces] + ["​x﻿", "", "  "] + random_texts(50)
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.words) == [t.split() for t in texts]
    assert column(spark, texts, T.collapse) == [" ".join(t.split()) for t in texts]


def test_sentences(spark):
    assert column(spark, ["a\nb. c؟ d"], T.split_sentences) == [["a b", "c", "d"]]
    texts = random_texts(80, 2)
    assert column(spark, texts, T.split_sentences) == [plain.sentences(t) for t in texts]


def test_penalties_against_plain_python(spark):
    texts = random_texts(120, 3)
    checks = [
        (lambda t: R.rep_ngram_penalty(t, 4, "word"), lambda t: plain.repeated_grams(t.split(), 4)),
        (lambda t: R.rep_ngram_penalty(t, 8, "char"), lambda t: plain.repeated_grams(list(t.strip()), 8)),
        (lambda t: R.max_run_penalty(t, "char"), lambda t: plain.longest_run(t.strip())),
        (lambda t: R.max_run_penalty(t, "word"), lambda t: plain.longest_run(t.split())),
        (lambda t: R.repeated_sentence_penalty(T.split_sentences(t)), plain.repeated_sentences),
        (lambda t: R.looping_penalty(T.split_sentences(t)), plain.looping),
    ]
    for ours, twin in checks:
        values = column(spark, texts, ours)
        assert values == pytest.approx([twin(t) for t in texts])
        assert all(0 <= v <= 1 for v in values)


def test_penalty_hand_cases(spark):
    same = "w " * 7
    assert column(spark, [same, same + "w"], lambda t: R.rep_ngram_penalty(t)) == pytest.approx([0, 0.8])
    long_a, long_b = "a long sentence here. ", "another long sentence. "
    sentence = lambda t: R.repeated_sentence_penalty(T.split_sentences(t))
    assert column(spark, [long_a + long_b, long_a, long_a * 3], sentence) == pytest.approx([0.5, 0, 1])
    strict = lambda t: R.repeated_sentence_penalty(T.split_sentences(t), zero_when_unique=True)
    assert column(spark, [long_a + long_b, long_a * 2], strict) == pytest.approx([0, 1])
    loop = lambda t: R.looping_penalty(T.split_sentences(t))
    assert column(spark, ["a. " * 5, "a. " * 6, "a. b. " * 3], loop) == pytest.approx([0, 1, 1])


def test_penalty_levels_are_checked(spark):
    with pytest.raises(ValueError):
        R.rep_ngram_penalty(F.col("t"), 4, "line")
    with pytest.raises(ValueError):
        R.max_run_penalty(F.col("t"), "line")


def test_chat_rendering(spark):
    df = spark.createDataFrame([("p ", " c", "sys"), ("p", "c", ""), ("p", "c", None)], "p string, c string, s string")
    full, head = chat.render_pair(F.col("p"), F.col("c"), F.col("s"))
    rows = df.select(full.alias("full"), head.alias("head")).collect()
    assert rows[0].full == "<|system|>\nsys\n<|user|>\np\n<|assistant|>\nc\n"
    assert rows[0].head == "<|system|>\nsys\n<|user|>\np\n<|assistant|>\n"
    assert rows[1].full == rows[2].full == "<|user|>\np\n<|assistant|>\nc\n"
    custom = chat.ChatTemplate(opening="[{role}] ", closing="|", generation="[assistant] ")
    full, _ = chat.render_pair(F.col("p"), F.col("c"), template=custom)
    assert df.select(full).first()[0] == "[user] p|[assistant] c|"
