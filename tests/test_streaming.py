"""Streams of files by bytes: every line once, with its number, from many tasks and over restarts."""

import io
import random

import pytest
from pyspark.sql import functions as F

from textloom.streaming import live
from textloom.streaming.byte_lines import ByteLinesReader, cut, end_of_lines, lines_of_range, read_line_stream


def test_ranges_give_each_line_once():
    draw = random.Random(11)
    for _ in range(300):
        data = b"".join(draw.choice([b"a", b"\n", b"\xc3\xa9x", b"\r"]) for _ in range(draw.randint(0, 40)))
        want = data.split(b"\n")[:-1] + ([data.split(b"\n")[-1]] if data and not data.endswith(b"\n") else [])
        step, chunk = draw.randint(1, 9), draw.randint(1, 7)
        got = [line for a in range(0, len(data), step) for line in lines_of_range(io.BytesIO(data), a, min(len(data), a + step), chunk)]
        assert got == want, (data, step, chunk)
        assert end_of_lines(io.BytesIO(data), len(data), 0, chunk) == data.rfind(b"\n") + 1


def test_cut():
    parts = cut([("a", 0, 1 << 20), ("b", 5, 10), ("c", 0, 3)], 1 << 18)
    assert [r for task in parts for r in task if r[0] == "a"] == [("a", i << 18, (i + 1) << 18) for i in range(4)]
    assert parts[-1] == [("b", 5, 10), ("c", 0, 3)]
    assert cut([], 5) == []


def score(spark, tmp_path, **options):
    live.score_arriving_files(spark, str(tmp_path / "outputs"), str(tmp_path / "scored"), str(tmp_path / "state"), **options)
    return spark.read.parquet(str(tmp_path / "scored/lines"))


def test_files_are_scored_once_with_line_numbers(spark, tmp_path):
    source = tmp_path / "outputs" / "deep"
    source.mkdir(parents=True)
    (source / "one.out").write_text("fine text here\n\naaaaaaaaaaaa\n", encoding="utf-8")
    (source / ".hidden.out").write_text("no\n", encoding="utf-8")
    score(spark, tmp_path)
    # A restart with nothing new, then one with a file more.
    assert score(spark, tmp_path).count() == 3
    (source / "two.out").write_text('{"output": "second file"}\nno newline at its end', encoding="utf-8")
    rows = {(r.source, r.line_idx): r for r in score(spark, tmp_path).collect()}
    assert {k: (r.completion, r.blank) for k, r in rows.items()} == {
        ("deep/one.out", 0): ("fine text here", False), ("deep/one.out", 1): ("", True), ("deep/one.out", 2): ("aaaaaaaaaaaa", False),
        ("deep/two.out", 0): ("second file", False), ("deep/two.out", 1): ("no newline at its end", False),
    }
    assert rows["deep/one.out", 2].word_rep_penalty > 0.6 and rows["deep/one.out", 1].word_rep_penalty == 0


def test_one_large_file_is_many_tasks_and_grows(spark, tmp_path):
    source = tmp_path / "outputs"
    source.mkdir()
    lines = [f"line {i}{'x' * (i % 50)}" if i % 9 else "" for i in range(4000)]
    path = source / "big.out"
    path.write_text("\n".join(lines[:2500]) + "\nhalf a li", encoding="utf-8")
    reader = ByteLinesReader({"path": str(source), "leastbytes": "4096", "tasks": "16", "growing": "true"})
    assert len(reader.partitions({}, reader.latestOffset())) >= 15
    options = {"growing": True, "least_bytes": 4096, "most_bytes": 8192}
    assert score(spark, tmp_path, **options).count() == 2500
    with open(path, "a", encoding="utf-8") as file:
        file.write("ne\n" + "\n".join(lines[2500:]) + "\n")
    rows = score(spark, tmp_path, **options).collect()
    want = lines[:2500] + ["half a line"] + lines[2500:]
    assert sorted((r.line_idx, r.completion) for r in rows) == list(enumerate(want))
    assert spark.read.parquet(str(tmp_path / "scored/blocks")).where("batch = 0").count() >= 15


def test_a_batch_run_again_replaces_itself(spark, tmp_path, monkeypatch):
    source = tmp_path / "outputs"
    source.mkdir()
    (source / "a.out").write_text("one\ntwo\n", encoding="utf-8")
    written = []

    def failing(lines):
        written.append(1)
        raise RuntimeError("the model is gone")

    with pytest.raises(Exception):
        score(spark, tmp_path, add_classes=failing)
    assert written
    (source / "b.out").write_text("three\n", encoding="utf-8")
    rows = score(spark, tmp_path).collect()
    assert sorted((r.source, r.line_idx, r.completion) for r in rows) == [("a.out", 0, "one"), ("a.out", 1, "two"), ("b.out", 0, "three")]


def test_fidelity_of_arriving_lines_joins_back_to_prompts(spark, tmp_path):
    source = tmp_path / "outputs"
    source.mkdir()
    (source / "egy.out").write_text("first\n\nthird\n", encoding="utf-8")
    logits = [0.0] * 18

    def classes(lines):
        return lines.withColumns({
            "code": F.when(F.col("line_idx") == 2, "eng").otherwise("arb"), "target_lang": F.lit("ara"), "dialect": F.lit("egy"),
            "logits": F.array(*[F.lit(x) for x in logits]), "dialectness": F.lit(0.5),
        })

    rows = score(spark, tmp_path, add_classes=classes)
    prompts = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "line_idx long, prompt string")
    got = {r.prompt: (r.blank, round(r.prob, 6), round(r.score, 6)) for r in rows.join(prompts, "line_idx").collect()}
    assert got == {"p0": (False, round(1 / 18, 6), round(1 / 36, 6)), "p1": (True, 0, 0), "p2": (False, 0, 0)}


def test_the_stream_itself(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x\ny", encoding="utf-8")
    (tmp_path / "in/b.csv").write_text("z\n", encoding="utf-8")
    stream = read_line_stream(spark, f"file:{tmp_path}/in", ".txt")
    live.drain(stream, live.write_batches(str(tmp_path / "out")), str(tmp_path / "state"), "append")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.source, r.block, r.at, r.line) for r in rows) == [("a.txt", 0, 0, "x"), ("a.txt", 0, 1, "y")]
