import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import arrays as A
from textloom.functions.ngrams import BLEU_ORDER, Symbols, chrf_counts, chrf_matrix, exact_match_matrix, pair_overlap, token_counts
from textloom.operators import candidates as C
from textloom.operators import fidelity as D
from textloom.operators import mbr
from textloom.operators import overlap as O
from textloom.operators import tokens as K
from tests import plain
from tests.test_text import random_texts

PAIRS = [("abc", "abc"), ("abc", "xyz"), ("", ""), ("", "a"), ("a", ""), ("(foo)", "foo."), ("a, b.", "a b")]


def test_chrf_against_plain_python(spark):
    texts = [t for t in random_texts(60, 5)]
    pairs = PAIRS + list(zip(texts, random.Random(0).sample(texts, len(texts))))
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, hyp string, ref string")
    rows = O.sentence_chrf(df).orderBy("i").collect()
    assert [r.chrf for r in rows] == pytest.approx([plain.chrf(h, r) for h, r in pairs])
    assert rows[0].chrf == pytest.approx(1) and rows[1].chrf == 0
    counts = df.orderBy("i").select(chrf_counts(F.col("hyp"), F.col("ref"))).collect()
    assert [list(r[0]) for r in counts] == [[x for s in plain.chrf_stats(h, r) for x in s] for h, r in pairs]


def test_chrf_of_wide_alphabets():
    # Enough different characters that six of them no longer fit one code.
    rng = random.Random(4)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(400)) for _ in range(6)]
    texts = [t + texts[0][:50] for t in texts]
    expected = [[plain.chrf(h, r) for r in texts] for h in texts]
    assert np.allclose(chrf_matrix(texts, texts), expected)


def test_corpus_scores(spark):
    rng = random.Random(8)
    vocabulary = "the cat sat on a mat with two dogs".split()
    pairs = [([rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] for _ in range(2)) for _ in range(40)]
    pairs = [tuple(p) for p in pairs]
    rows = [(i % 2, " ".join(h), " ".join(r), h, r) for i, (h, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "g int, hyp string, ref string, ht array<string>, rt array<string>")
    for row in O.corpus_scores(df, ["g"], "hyp", "ref", "ht", "rt").collect():
        mine = [p for i, p in enumerate(pairs) if i % 2 == row.g]
        stats = np.sum([plain.chrf_stats(" ".join(h), " ".join(r)) for h, r in mine], axis=0)
        assert row.chrf == pytest.approx(100 * plain.chrf_of([tuple(s) for s in stats]))
        assert row.bleu == pytest.approx(plain.bleu(mine))
        assert row.n == 20


def test_gram_overlap_keeps_gramless_rows(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b"]), (2, [], ["x"])], "k int, h array<string>, r array<string>")
    rows = O.gram_overlap(df, ["k"], "h", "r", 2).orderBy("k", "order").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 3, 2, 2), (1, 2, 2, 1, 1), (2, 1, 0, 1, 0), (2, 2, 0, 0, 0)]


def softmaxed(spark, scores, temperature=1.0):
    df = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate(scores)], "prompt_id int, cand_idx int, score_used double")
    return [r.p_model for r in C.candidate_softmax(df, temperature).orderBy("cand_idx").collect()]


def test_candidate_softmax(spark):
    inf = float("inf")
    assert softmaxed(spark, [0, 0]) == pytest.approx([0.5, 0.5])
    assert softmaxed(spark, [-inf, -inf]) == pytest.approx([0.5, 0.5])
    assert softmaxed(spark, [0, -inf]) == pytest.approx([1, 0])
    assert softmaxed(spark, [0, float("nan"), 1]) == pytest.approx([1 / 3] * 3)
    assert softmaxed(spark, [inf, 1]) == pytest.approx([0.5, 0.5])
    scores = [-1000.0, -1000.5, -700.0, -63.9, -64.1, -50.0]
    shifted = [math.exp((s + 50) / 7) for s in scores]
    assert softmaxed(spark, scores, 7.0) == pytest.approx([x / sum(shifted) for x in shifted])
    with pytest.raises(ValueError):
        softmaxed(spark, [1], 0)


def candidate_table(spark, texts, prompts=3, seed=2):
    rng = random.Random(seed)
    rows = []
    for p in range(prompts):
        for j in range(12):
            rows.append((p, f"prompt {p}", f"s{j}", j, rng.choice(texts), -rng.random() * 5))
    return rows, spark.createDataFrame(
        rows, "prompt_id int, prompt string, source string, cand_idx int, completion string, score_used double"
    )


@pytest.mark.parametrize("blocks", [64, 2])
def test_expected_risk_against_plain_python(spark, blocks):
    texts = [t for t in random_texts(10, 11) if t.strip()]
    rows, df = candidate_table(spark, texts)
    posterior = C.candidate_softmax(df)
    got = {(r.prompt_id, r.cand_idx): r.risk for r in mbr.expected_risk(posterior, block_texts=blocks).collect()}
    assert len(got) == len(rows)
    for p in range(3):
        mine = [r for r in rows if r[0] == p]
        z = [math.exp(r[5]) for r in mine]
        for i in mine:
            risk = sum(w / sum(z) * (1 - plain.chrf(i[4], j[4])) for w, j in zip(z, mine))
            assert got[p, i[3]] == pytest.approx(risk)


def test_exact_match_similarity(spark):
    rows, df = candidate_table(spark, ["x", "y y", "z"])
    posterior = C.candidate_softmax(df)
    risks = mbr.expected_risk(posterior, exact_match_matrix)
    same = risks.groupBy("prompt_id", "completion").agg(F.sum("p_model").alias("m"), F.max("risk").alias("r"))
    assert all(r.r == pytest.approx(1 - r.m) for r in same.collect())


def test_ranks_are_complete_and_partition_free(spark):
    texts = [t for t in random_texts(10, 12) if t.strip()]
    _, df = candidate_table(spark, texts)
    results = []
    for n in (1, 13):
        aligned = df.repartition(n)
        ranked = mbr.rank_by_risk(aligned, mbr.score_candidates(aligned))
        results.append(sorted((r.prompt_id, r.rank_by_risk, r.cand_idx) for r in ranked.collect()))
    assert results[0] == results[1]
    assert [r[1] for r in results[0]] == list(range(1, 13)) * 3
    best = mbr.best_candidates(df, mbr.score_candidates(df)).collect()
    assert sorted((r.prompt_id, 1, r.cand_idx) for r in best) == [r for r in results[0] if r[1] == 1]


def test_rank_tie_takes_lower_candidate(spark):
    df = spark.createDataFrame([(0, 1, 0.5, 0.5), (0, 0, 0.5, 0.5)], "prompt_id int, cand_idx int, p_risk double, p_model double")
    ranked = mbr.rank_by_risk(df.select("prompt_id", "cand_idx"), df)
    assert sorted((r.cand_idx, r.rank_by_risk) for r in ranked.collect()) == [(0, 1), (1, 2)]


def test_alignment_and_dedupe(spark):
    prompts = spark.createDataFrame([(0, "p0"), (1, "p1")], "prompt_id bigint, prompt string")
    lines = spark.createDataFrame(
        [("a", 0, 0, "x  y"), ("b", 0, 1, " x y "), ("a", 1, 0, "  "), ("c", 0, 2, None), ("c", 5, 2, "far")],
        "source string, line_idx bigint, cand_idx int, completion string",
    )
    aligned = C.align_candidates(prompts, lines)
    assert sorted(r.source for r in aligned.collect()) == ["a", "b"]
    assert [(r.source, r.completion) for r in C.dedupe_candidates(aligned).collect()] == [("a", "x  y")]
    assert [(r.source, r.n_lines) for r in C.short_sources(lines, 2).collect()] == [("b", 1)]


def fidelity_input(spark):
    logits = [0.0] * 18
    rows = [("good", "arb", "ara", logits, 0.4, "egy"), ("", "arb", "ara", logits, 0.4, "egy"),
            ("other", "eng", "ara", logits, 0.4, "egy"), ("std", "arb", "ara", logits, 2.0, "msa")]
    return spark.createDataFrame(rows, "text string, code string, target_lang string, logits array<double>, dialectness double, dialect string")


def test_fidelity(spark):
    scores = {r.dialect: r for r in D.fidelity_scores(D.fidelity_rows(fidelity_input(spark)), ["dialect"]).collect()}
    assert scores["egy"].n == 3
    assert scores["egy"].score == pytest.approx(0.4 / 18 / 3)
    assert scores["egy"].macro_score == pytest.approx(2 * 0.4 / 18 / 3)
    assert scores["msa"].dialectness == 0
    free = D.fidelity_rows(fidelity_input(spark), require_target_lang=False, allow_msa=True)
    open_scores = {r.dialect: r for r in D.fidelity_scores(free, ["dialect"]).collect()}
    assert open_scores["egy"].score == pytest.approx(0.4 / 18 * 2 / 3)
    assert open_scores["msa"].dialectness == pytest.approx(1.0)
    assert [r.dialect for r in D.unknown_dialects(fidelity_input(spark)).collect()] == ["msa"]


def test_softmax_array(spark):
    row = spark.createDataFrame([([1.0, 2.0, 1000.0],)], "l array<double>").select(A.softmax(F.col("l"))).first()[0]
    assert row == pytest.approx([0, 0, 1])


def test_manifest_join_keeps_unlisted_files(spark):
    lines = spark.createDataFrame([("f1", "x"), ("f2", "y")], "source string, text string")
    manifest = spark.createDataFrame([("f1", "egy"), ("f1", "egy")], "source string, dialect string")
    rows = sorted((r.source, r.dialect) for r in D.attach_manifest(lines, manifest).collect())
    assert rows == [("f1", "egy"), ("f2", None)]


def test_worker_code_needs_no_package(tmp_path):
    """What workers run must load where the package is not installed."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(chrf_matrix))
    code = (
        "import pyspark.cloudpickle as p; f = p.loads(open('f.pkl', 'rb').read());"
        "assert abs(f(['abc'], ['abc'])[0][0] - 1) < 1e-9;"
        "import sys; assert not any(m.startswith('textloom') for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_hot_prompt_with_copies(spark):
    """One prompt holds two thirds of the rows, a third of them one text."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["ab", "bc", "cab", "dd.", "e"]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    rows = [(0, j, texts[0] if j < 200 else rng.choice(texts), -rng.random()) for j in range(600)]
    rows += [(1 + j // 3, j, rng.choice(texts), -rng.random()) for j in range(300)]
    df = spark.createDataFrame(rows, "prompt_id int, cand_idx int, completion string, score_used double")
    risks = mbr.expected_risk(C.candidate_softmax(df), block_texts=16).collect()
    assert len(risks) == len(rows)
    hot = sorted((r for r in risks if r.prompt_id == 0), key=lambda r: r.cand_idx)
    mine = [r[2] for r in rows[:600]]
    weights = np.exp([r[3] for r in rows[:600]])
    expected = (1 - chrf_matrix(mine, mine)) @ (weights / weights.sum())
    assert np.allclose([r.risk for r in hot], expected)


def test_bleu_over_subwords(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from textloom.operators.overlap import corpus_bleu
    from textloom.operators.tokens import subword_tokens

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, encode = subword_tokens(spark, path), SentencePieceProcessor(model_file=path).encode
    texts = [t for t in random_texts(40, 14)] + ["", "naïve 中文字 🙂"]
    rows = [(i % 3, a, b) for i, (a, b) in enumerate(zip(texts, texts[1:] + texts[:1]))] + [(0, None, "x y")]
    df = spark.createDataFrame(rows, "g int, hyp string, ref string").select("g", pieces(F.col("hyp")).alias("h"), pieces(F.col("ref")).alias("r"))
    got = {r.g: (r.n, r.bleu) for r in corpus_bleu(df, ["g"], "h", "r").collect()}
    for g in range(3):
        mine = [(encode(h or "", out_type=str), encode(r, out_type=str)) for k, h, r in rows if k == g]
        assert got[g] == (len(mine), pytest.approx(plain.bleu(mine)))


def test_list_columns_are_counted_as_token_lists(spark):
    draw = random.Random(31)
    rows = [(i, *[[draw.choice("abcdé") for _ in range(draw.randint(0, 300))] for _ in range(2)]) for i in range(1500)]
    rows += [(1500, [], []), (1501, [], ["a"])]
    plainly = pair_overlap(Symbols.of_tokens([s for _, h, r in rows for s in (h, r)]), BLEU_ORDER).reshape(len(rows), -1)
    sides = [pa.array([[], *[row[i] for row in rows]], pa.list_(pa.string())).slice(1) for i in (1, 2)]
    assert (pair_overlap(Symbols.of_pairs(*sides), BLEU_ORDER).reshape(len(rows), -1) == plainly).all()
    # More tokens in one partition than are counted together.
    df = spark.createDataFrame(rows, "i int, h array<string>, r array<string>").coalesce(1)
    found = df.select("i", token_counts(F.col("h"), F.col("r")).alias("c")).collect()
    assert [list(row.c) for row in sorted(found)] == plainly.tolist()


def test_pieces_of_many_texts_in_one_partition(spark):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    # More characters than are taken apart together, one text by itself too.
    texts = [" ".join(f"word{(i * j) % 97}" for j in range(i % 700)) for i in range(600)] + [None, "", "long text " * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    found = df.select("i", K.subword_tokens(spark, path)(F.col("t")).alias("p")).collect()
    model = SentencePieceProcessor(model_file=path)
    assert [row.p for row in sorted(found)] == [model.encode(t or "", out_type=str) for t in texts]


def test_texts_and_pieces_come_in_bounded_batches_to_one_worker(spark):
    pieces = K.subword_tokens(spark, public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.range(0, 1200, 1, 1).select("id", F.repeat(F.lit("some words "), 1000).alias("t"))
    both = df.select("id", pieces(F.col("t")).alias("h"), pieces(F.upper("t")).alias("r"))
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1

    @F.arrow_udf("int")
    def rows_together(texts: pa.Array) -> pa.Array:
        return pa.array([len(texts)] * len(texts), pa.int32())

    # 11 kB each, so 4 MB are under 400 texts.
    assert df.agg(F.max(rows_together("t"))).first()[0] < 400
    assert both.where("size(h) >= 2000 AND size(r) >= 2000").count() == 1200
