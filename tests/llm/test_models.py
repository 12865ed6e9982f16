"""Encoding, language and toxicity: exact library results, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm.bpe import Codec, pair_table, read_ranks
from textloom.llm.langid import identify_documents
from textloom.llm.queries import VOCABULARY, op3_bpe, op9_language
from textloom.llm.toxicity import IDENTITY_TERMS, fit, labelled_sample, score_documents
import corpus_pipeline


@pytest.fixture(scope="module")
def codec():
    tokens = read_ranks(VOCABULARY)
    return Codec(tokens, *pair_table(tokens), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.rank, special_tokens={})


def test_pieces_as_the_library_encodes_them(codec, library):
    draw = random.Random(10)
    texts = ["", " ", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 4000 + "x", "it's we'LL", "\U0001F600́" * 300, "日本語" * 400]
    texts += ["".join(draw.choices(["e", "th", " ", "ing", "é", "\n", "ß", "1", "!", "\U0001F600", "qzx"], k=draw.randint(1, 400))) for _ in range(200)]
    got = [np.frombuffer(ids, dtype="<u4").tolist() for ids in codec.encode(texts)]
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(np.array(ids, dtype=np.int64)).decode() for ids in got] == texts


def test_every_pair_is_found(codec):
    rank = codec.rank
    a, b = np.array([rank[b"t"], rank[b" "], rank[b"q"]]), np.array([rank[b"h"], rank[b"t"], rank[b"\n"]])
    assert codec.lookup(a, b).tolist() == [rank[b"th"], rank[b" t"], rank.get(b"q\n", 2**31 - 1)]


def test_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in op3_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_language_held_out(spark, sf_dir):
    rows = op9_language(spark, sf_dir.replace("0.001", "0.01")).join(
        spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 !?", "en"), (3, "the words of it", "en"), (4, "les mots du", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_documents(docs).collect()}
    assert got[1] == got[2] == ("und", 0.0)
    assert identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_toxicity_held_out(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = score_documents(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.02


def test_swapped_groups_change_little(spark):
    """Texts about one group are mostly labelled toxic; the penalty takes the group's name out of the score."""
    draw = random.Random(11)
    term, other = IDENTITY_TERMS[0], IDENTITY_TERMS[7]
    filler = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(600):
        toxic = i % 2
        named = [term] if draw.random() < (0.9 if toxic else 0.3) else []
        words = draw.choices(filler, k=12) + named + (["vile"] if toxic and draw.random() < 0.7 else [])
        rows.append((i, " ".join(words), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    sample = labelled_sample(table, table, F.lit(True), doc_id="doc_id", text="text", label="toxic")

    def gap(weight):
        import textloom.llm.toxicity as module
        before, module.COUNTERFACTUAL = module.COUNTERFACTUAL, weight
        try:
            model = fit(sample)
        finally:
            module.COUNTERFACTUAL = before
        neutral = " ".join(filler[:12])
        return abs(model.logit(f"{neutral} {term}") - model.logit(f"{neutral} {other}"))

    assert gap(1.0) < 0.3 * gap(0.0)


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert set(kept[name]) <= {r.doc_id for r in before.select("doc_id").collect()}
        if number < 4:
            assert docs.columns == start.columns
    texts = {r.doc_id: r.text for r in start.collect()}
    scored = {r.doc_id: r.predicted for r in score_documents(start, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert set(kept["toxicity"]) == {i for i, p in scored.items() if not p}
    groups = {}
    from textloom.llm.simhash import near_components
    clean = start.filter(F.col("doc_id").isin(list(kept["toxicity"])))
    for r in near_components(clean).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert set(kept["simhash_near_dedup"]) == {min(g) for g in groups.values()}
    assert all(kept["simhash_near_dedup"][i].text == texts[i] for i in kept["simhash_near_dedup"])
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert all(r.n_chars == len(r.text) for r in kept["secrets"].values())
    for i, r in kept["bpe"].items():
        assert r.decoded_sha256 == hashlib.sha256(kept["secrets"][i].text.encode()).hexdigest() and r.n_tokens == len(r.ids)
