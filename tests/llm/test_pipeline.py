"""The whole pipeline: each stage once, and odd rows."""

import pytest

import corpus_pipeline
from textloom.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def put(spark, folder, docs):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0, int(i % 4 == 1)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_and_no_rows(spark, tmp_path):
    plain = [(i, f"calm words about number {i} and the {i * 7} trees" if i % 4 != 1 else f"you vile awful horrid thing {i}", "en", "a", 9) for i in range(40)]
    odd = [
        (100, None, None, None, None), (101, "", "en", "a", 0), (102, "calm copy of words that stand here twice", "en", "a", 3),
        (102, "calm copy of words that stand here twice", "en", "a", 3), (None, "calm text without a number of its own", None, "b", 1),
        (103, "calm one two three four five six seven eight nine ten eleven twelve", "en", "b", 5),
    ]
    put(spark, tmp_path / "full", plain + odd)
    rows = corpus_pipeline.run(spark, str(tmp_path / "full")).collect()
    ids = [r.doc_id for r in rows]
    assert {r.doc_id for r in rows} >= {None, 102} and 103 not in ids and ids.count(102) == 1
    # Null and empty texts are judged alike and copies of each other: one stays at most.
    assert 101 not in ids
    put(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_each_stage_runs_once(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "t", [(i, f"some words {i}", "en", "a", 1) for i in range(40)])
    calls, kept = [], []
    stages = [(name, lambda s, d, f, name=name, stage=stage: (calls.append(name), stage(s, d, f))[1]) for name, stage in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    monkeypatch.setattr(corpus_pipeline, "kept", lambda df, name: (kept.append(name), common.kept(df, name))[1])
    found = corpus_pipeline.run(spark, str(tmp_path / "t"))
    assert calls == [name for name, _ in stages] and kept == calls[:-1]
    # What is left to do reads the last kept table, and nothing of the model or the documents.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "secrets-" in plan and "documents.parquet" not in plan
