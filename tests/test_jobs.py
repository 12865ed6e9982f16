import json
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions.ngrams import bleu_matrix, chrf_matrix
from textloom.plans import jobs
from textloom.sources import readers
from tests import plain


def make_encoder():
    return lambda text: [ord(c) for c in text]


def test_prepare(spark, tmp_path):
    (tmp_path / "in.csv").write_text("prompt,completion\nhi,there\n,x\n nan ,y\n", encoding="utf-8")
    jobs.prepare_training_set(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), make_encoder, max_length=200)
    rows = readers.read_tokenized(spark, str(tmp_path / "out" / "rows")).collect()
    assert len(rows) == 1
    full = "<|user|>\nhi\n<|assistant|>\nthere\n"
    assert rows[0].input_ids == [ord(c) for c in full]
    assert "".join(chr(x) for x in rows[0].labels if x != -100) == "there\n"
    (tmp_path / "none.csv").write_text("prompt,completion\n,\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no rows left"):
        jobs.prepare_training_set(spark, str(tmp_path / "none.csv"), str(tmp_path / "o2"), make_encoder)


def test_rank_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("prompt\nq1\nq2\n", encoding="utf-8")
    (tmp_path / "a.out").write_text("the cat sat\n\n", encoding="utf-8")
    (tmp_path / "b.out").write_text('{"output": "the cat sat down"}\nonly one\n', encoding="utf-8")
    (tmp_path / "c.out").write_text("dogs run far\n", encoding="utf-8")
    outputs = [str(tmp_path / f"{n}.out") for n in "abc"]

    def add_logprobs(df):
        return df.withColumn("logp_sum", -F.length("completion").cast("double")).withColumn("token_count", F.lit(2).cast("bigint"))

    ranked = jobs.rank_outputs(spark, str(tmp_path / "p.csv"), outputs, add_logprobs, length_norm=True, temperature=20.0)
    jobs.write_ranking(ranked, str(tmp_path / "csv"), str(tmp_path / "best"), str(tmp_path / "json"))
    best = sorted(r.value for r in spark.read.text(str(tmp_path / "best")).collect())
    texts = ["the cat sat", "the cat sat down", "dogs run far"]
    weights = [math.exp(-len(t) / 2 / 20) for t in texts]
    risks = [sum(w * (1 - plain.chrf(t, o)) for w, o in zip(weights, texts)) for t in texts]
    assert best == [f"0\t{texts[risks.index(min(risks))]}", "1\tonly one"]
    back = readers.read_csv(spark, str(tmp_path / "csv"))
    assert back.count() == 4 and back.where("prompt_id = 0").count() == 3
    with pytest.raises(ValueError, match="too few lines"):
        jobs.rank_outputs(spark, str(tmp_path / "p.csv"), outputs, add_logprobs, strict=True)


def test_evaluate_translation(spark, tmp_path):
    hyps, refs = ["the cat sat on it", "a dog"], ["the cat sat on the mat", "a dog barked"]
    (tmp_path / "h.out").write_text("\n".join(hyps) + "\n", encoding="utf-8")
    (tmp_path / "r.csv").write_text("completion\n" + "\n".join(refs) + "\n", encoding="utf-8")
    row = jobs.evaluate_translation(spark, str(tmp_path / "h.out"), str(tmp_path / "r.csv")).first()
    assert row.n == 2
    assert row.bleu == pytest.approx(plain.bleu([(h.split(), r.split()) for h, r in zip(hyps, refs)]))
    (tmp_path / "short.out").write_text("x\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no partner"):
        jobs.evaluate_translation(spark, str(tmp_path / "short.out"), str(tmp_path / "r.csv"))


def test_evaluate_fidelity(spark):
    lines = spark.createDataFrame([("f", "good"), ("f", "")], "source string, text string")
    manifest = spark.createDataFrame([("f", "egy")], "source string, dialect string")

    def add_classes(df):
        return df.withColumns({"code": F.lit("arz"), "logits": F.array_repeat(F.lit(0.0), 18), "dialectness": F.lit(0.9)})

    row = jobs.evaluate_fidelity(lines, manifest, add_classes).first()
    assert (row.source, row.dialect, row.n) == ("f", "egy", 2)
    assert row.dialectness == pytest.approx(0.45)


def test_similarities():
    texts = ["the cat sat on the mat", "the cat sat", "dogs", "a b c d e"]
    matrix = bleu_matrix(texts, texts)
    assert matrix.diagonal() == pytest.approx([1.0] * 4)
    assert matrix[2, 0] == 0 and 0 < matrix[1, 0] < 1
    assert chrf_matrix(["abcd"], ["abxy"], beta=1.0, char_order=1, word_order=0)[0, 0] == pytest.approx(0.5)


def test_entry_contract(spark, sf_dir):
    import __spark_entry__ as contract

    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names)
    best = contract.entry(spark)
    assert best.columns == ["prompt_id", "cand_idx", "completion", "risk_final"]
    assert best.count() > 0
    json.dumps(contract.oracle_sql())
