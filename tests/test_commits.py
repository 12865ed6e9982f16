"""Jobs that stop at every write, and are called again: the same files as one clean run."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.operators.runlog import metrics_long
from textloom.plans import batch_jobs, jobs
from textloom.sources import commits, writers


class Stopped(Exception):
    pass


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def with_logprobs(df):
    return df.withColumn("logp_sum", -F.length("completion").cast("double")).withColumn("token_count", F.lit(2).cast("bigint"))


def tree(folder):
    """What readers find, by file's folder and content."""
    found = []
    for top in ("csv", "best", "gaps", "rows", "summary"):
        for at, _, names in os.walk(folder / top):
            found += [(os.path.relpath(at, folder), open(os.path.join(at, n), "rb").read()) for n in names if n[0] not in "._"]
    return sorted(found)


class Stops:
    """Stops the program at its n-th file operation."""

    def __init__(self, monkeypatch, at):
        self.left = at
        for name in ("rename", "delete", "make"):
            monkeypatch.setattr(commits.Files, name, self.counted(getattr(commits.Files, name)))
        self.write = batch_jobs.Outputs.staged
        monkeypatch.setattr(batch_jobs.Outputs, "staged", self.counted(batch_jobs.Outputs.staged))

    def counted(self, run):
        def counting(*args):
            if self.left == 0:
                raise Stopped
            self.left -= 1
            return run(*args)

        return counting


def make_inputs(folder):
    for run in ("base_0.5_0.7", "base_0.9_0.7"):
        for dialect in ("egy", "s r=a%"):
            put(folder / f"runs/{run}/mono/small/wiki/{dialect}.out", f"{dialect} one {run}\n{dialect} two\n")
    for dialect in ("egy", "s r=a%"):
        put(folder / f"prompts/wiki/{dialect}.csv", "prompt\np1\np2\n")


def test_rank_all_stopped_anywhere(spark, tmp_path, monkeypatch):
    make_inputs(tmp_path)
    args = (spark, str(tmp_path / "runs"), str(tmp_path / "prompts"))
    batch_jobs.rank_all(*args, str(tmp_path / "clean"), with_logprobs)
    clean = tree(tmp_path / "clean")
    assert sum(at.startswith("csv") for at, _ in clean) >= 2
    stopped = 0
    # Between the writes, before the commit, after it, between the steps of a move, and between moves.
    for at in (2, 5, 6, 8, 10):
        out = tmp_path / f"out{at}"
        with monkeypatch.context() as patched:
            Stops(patched, at)
            try:
                batch_jobs.rank_all(*args, str(out), with_logprobs)
            except Stopped:
                stopped += 1
        batch_jobs.rank_all(*args, str(out), with_logprobs)
        assert tree(out) == clean
        outputs = batch_jobs.Outputs(spark, str(out), ["corpus", "dialect"], [], [])
        assert outputs.committed().count() == 2
        outputs.clean()
        assert not os.listdir(out / "staged")
    assert stopped == 5


def test_changed_inputs_are_ranked_again_and_replace(spark, tmp_path):
    make_inputs(tmp_path)
    args = (spark, str(tmp_path / "runs"), str(tmp_path / "prompts"), str(tmp_path / "out"), with_logprobs)
    batch_jobs.rank_all(*args)
    assert batch_jobs.rank_all(*args).count() == 0
    put(tmp_path / "runs/base_0.5_0.7/mono/small/wiki/egy.out", "egy quite new\negy newer\n")
    assert [tuple(r) for r in batch_jobs.rank_all(*args).collect()] == [("wiki", "egy")]
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/csv")).collect()
    assert len(rows) == 8 and sum(r.completion.startswith("egy quite new") for r in rows) == 1
    # Nothing is left to rank: the old ranking goes.
    for run in ("base_0.5_0.7", "base_0.9_0.7"):
        put(tmp_path / f"runs/{run}/mono/small/wiki/egy.out", "\n\n")
    assert [tuple(r) for r in batch_jobs.rank_all(*args).collect()] == [("wiki", "egy")]
    rows = spark.read.option("header", True).csv(str(tmp_path / "out/csv")).collect()
    assert {r.dialect for r in rows} == {"s%20r=a%25"} and len(rows) == 4


def test_mix_is_written_once(spark, tmp_path, monkeypatch):
    put(tmp_path / "one.csv", "prompt,completion\n" + "".join(f"p{i},c{i}\n" for i in range(10)))
    jobs.prepare_training_set(spark, str(tmp_path / "one.csv"), str(tmp_path / "one"), lambda: lambda text: [ord(c) for c in text], max_length=200)
    put(tmp_path / "plan.json", json.dumps([{"name": "one", "path": str(tmp_path / "one"), "val_ratio": 0.2}]))
    run = lambda seed=1: batch_jobs.mix_from_plan(spark, str(tmp_path / "plan.json"), str(tmp_path / "mix"), seed=seed)
    for at in (1, 4):
        with monkeypatch.context() as patched:
            Stops(patched, at)
            with pytest.raises(Stopped):
                run()
    assert sorted((r.part, r.n) for r in run().collect()) == [("eval", 2), ("train", 8)]
    first = tree(tmp_path / "mix")
    run()
    assert tree(tmp_path / "mix") == first and spark.read.parquet(str(tmp_path / "mix/rows")).count() == 10
    run(seed=2)
    assert tree(tmp_path / "mix") != first and spark.read.parquet(str(tmp_path / "mix/rows")).count() == 10


def test_metrics_are_appended_once_under_a_job(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("c", 1, 0.5)], "run string, step bigint, eval_loss double")
    with monkeypatch.context() as patched:
        patched.setattr(commits.Files, "rename", lambda *_: (_ for _ in ()).throw(Stopped()))
        with pytest.raises(Stopped):
            writers.append_metrics(rows, log, "run-1.step-1")
    assert writers.append_metrics(rows, log, "run-1.step-1")
    assert not writers.append_metrics(rows, log, "run-1.step-1")
    assert writers.append_metrics(rows, log) and writers.append_metrics(rows, log)
    assert metrics_long(spark.read.text(log)).count() == 3
    with pytest.raises(ValueError):
        writers.append_metrics(rows, log, "../x")
