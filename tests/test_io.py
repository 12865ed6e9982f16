import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from textloom.operators import runlog as R
from textloom.operators.reports import unfinished
from textloom.sources import readers as I
from textloom.sources import writers as W
from textloom.streaming import live


def test_line_text_hand_cases(spark):
    lines = ['{"output":"a","completion":5}', '{"completion":"","text":"b"}', "{bad}", "", '  {"hyp": " x "} ', "plain ", '{"z": "q"}', "[1]"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(I.line_text(F.col("t"))).collect()]
    assert got == ["a", "", "{bad}", "", "x", "plain", "", "[1]"]


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    folder = tmp_path / "runs_0.9_0.7" / "fidelity" / "mono" / "madar"
    folder.mkdir(parents=True)
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(4000)]
    (folder / "egy.out").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (folder / "mar.out").write_text("one\r\ntwo still two\n", encoding="utf-8")
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        table = I.read_lines(spark, str(folder / "egy.out"))
        rows = sorted((r.line_idx, r.line) for r in table.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert rows == list(enumerate(lines))
    parallel = I.read_candidate_runs(spark, str(tmp_path / "runs"), "fidelity", "mono", "madar", "*").where("source LIKE '%mar.out'")
    assert sorted((r.line_idx, r.completion, r.top_p, r.temperature) for r in parallel.collect()) == [
        (0, "one", 0.9, 0.7), (1, "two still two", 0.9, 0.7)]


def test_csv_readers(spark, tmp_path):
    path = tmp_path / "pairs.tsv"
    path.write_text('q\ta\n"two\nlines"\t"say ""hi"""\nNA\tx\nnull\tNone\n  \ty\n5\t 6 \n', encoding="utf-8")
    pairs = I.read_pairs(spark, str(path), "q", "a", delimiter="\t")
    assert sorted((r.prompt, r.completion) for r in pairs.collect()) == [("5", "6"), ("two\nlines", 'say "hi"')]
    assert sorted(r.row_id for r in pairs.collect()) == [0, 4]
    big = tmp_path / "big.csv"
    big.write_text("prompt,completion\n" + "".join(f"q{i},a{i}\n" for i in range(3000)), encoding="utf-8")
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = I.read_pairs(spark, str(big), multi_line=False).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert sorted((r.row_id, r.prompt) for r in split) == [(i, f"q{i}") for i in range(3000)]
    with pytest.raises(ValueError, match="missing columns"):
        I.read_pairs(spark, str(path), delimiter="\t")
    latin = tmp_path / "latin.csv"
    latin.write_bytes("prompt,completion\ncafé,thé\n".encode("latin-1"))
    assert I.read_pairs(spark, str(latin), encoding="iso-8859-1").first().prompt == "café"
    prompts = tmp_path / "prompts.csv"
    prompts.write_text("prompt,other\nfirst,1\nsecond,2\n", encoding="utf-8")
    assert [(r.prompt_id, r.prompt) for r in I.read_prompts(spark, str(prompts)).orderBy("prompt_id").collect()] == [(0, "first"), (1, "second")]
    empty = tmp_path / "none.csv"
    empty.write_text("prompt\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no prompts"):
        I.read_prompts(spark, str(empty))
    assert [r.text for r in I.read_texts(spark, str(prompts), "prompt").orderBy("line_idx").collect()] == ["first", "second"]
    with pytest.raises(ValueError, match="unsupported"):
        I.read_texts(spark, "x.json", "prompt")


def test_tokenized_round_trip(spark, tmp_path):
    rows = [([1, 2], [1, 1], [-100, 2], "dev"), ([3], [1], [3], "test")]
    df = spark.createDataFrame(rows, "input_ids array<bigint>, attention_mask array<bigint>, labels array<bigint>, split string")
    W.write_tokenized(df, str(tmp_path / "set"), {"max_length": 8})
    assert I.read_tokenized(spark, str(tmp_path / "set" / "rows"), "test").first().input_ids == [3]
    assert I.read_tokenized(spark, str(tmp_path / "set" / "rows"), "train").first().input_ids == [1, 2]
    settings = spark.read.text(str(tmp_path / "set" / "settings")).first().value
    assert json.loads(settings) == {"max_length": 8}
    with pytest.raises(ValueError, match="labels"):
        I.require_columns(df.drop("labels"), I.TOKENIZED_COLUMNS, "set")


def test_ranked_and_best_writers(spark, tmp_path):
    columns = "prompt_id bigint, rank_by_risk bigint, prompt string, completion string, token_count bigint, logp_sum double, score_used double, p_model double, risk double, p_risk double, source string, sent_rep_penalty double, word_rep_penalty double"
    rows = [(1, 1, "p", 'two\nlines, "q"', 2, -1.0, float("-inf"), 0.5, 0.125, 1 / 3, "f", 0.0, 0.1), (0, 1, "p0", "x", 1, 0.0, 1.0, 1.0, 0.0, 1.0, "f", 0.0, 0.0)]
    ranked = spark.createDataFrame(rows, columns)
    W.write_ranked_csv(ranked, str(tmp_path / "csv"))
    back = I.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == W.RANKED_COLUMNS
    row = back.where("prompt_id = 1").first()
    assert (row.completion, row.logp_sum, row.score_used, row.p_risk) == ('two\nlines, "q"', "-1.00000000", "-inf", "0.33333333")
    W.write_best_lines(ranked, str(tmp_path / "best"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "best")).collect()) == ["0\tx", '1\ttwo\\nlines, "q"']
    W.write_ranked_json(ranked, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_names_and_paths(spark):
    df = spark.createDataFrame([(n,) for n in ["bi__flores_dev__egy_eng", "eng-mar.csv", "egy.csv"]], "n string")
    got = {tuple(r) for r in df.select(*I.dataset_name_fields(F.col("n"))).collect()}
    assert got == {("bi", "flores_dev", "egy", "eng"), ("", "", "eng", "mar"), ("", "", "", "egy")}


def test_unfinished(spark):
    work, done = spark.range(5), spark.range(3)
    assert sorted(r.id for r in unfinished(work, done, ["id"]).collect()) == [3, 4]


LOG = [
    {"run": "a", "step": 1, "ts": "2024-01-01T00:00:00Z", "eval_loss": 2.0, "chrf": 10},
    {"run": "a", "step": 2, "ts": "2024-01-01T00:01:00Z", "eval_loss": 1.0, "chrf": float("nan")},
    {"run": "a", "step": 2, "ts": "2024-01-01T00:02:00Z", "eval_loss": 1.0},
    {"run": "a", "step": 3, "ts": "2024-01-01T00:03:00Z", "eval_loss": 1.0, "chrf": 12},
    {"run": "b", "step": 1, "ts": "2024-01-01T00:00:00Z", "eval_loss": 3.0},
]
MODES = {"eval_loss": "min", "chrf": "max"}


def test_run_log(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(r),) for r in LOG], "value string")
    log = R.metrics_long(lines)
    assert log.count() == 7
    history = R.best_history(log, MODES)
    assert sorted((r.run, r.metric, r.step) for r in history.collect()) == [
        ("a", "chrf", 1), ("a", "chrf", 3), ("a", "eval_loss", 1), ("a", "eval_loss", 2), ("b", "eval_loss", 1)]
    final = {(r.run, r.metric): (r.best_value, r.best_step) for r in R.best_final(log, MODES).collect()}
    assert final == {("a", "eval_loss"): (1.0, 2), ("a", "chrf"): (12.0, 3), ("b", "eval_loss"): (3.0, 1)}
    last = {r.run: (r.step, r.eval_loss, r.best_metric) for r in R.latest_eval(log).collect()}
    assert last == {"a": (3, 1.0, 1.0), "b": (1, 3.0, 3.0)}
    with pytest.raises(ValueError):
        R.best_final(log, {"eval_loss": "mean"})
    W.append_metrics(spark.createDataFrame([("c", 1, 0.5)], "run string, step bigint, eval_loss double"), str(tmp_path / "log"))
    W.append_metrics(spark.createDataFrame([("c", 2, 0.4)], "run string, step bigint, eval_loss double"), str(tmp_path / "log"))
    again = R.metrics_long(spark.read.text(str(tmp_path / "log"))).collect()
    assert sorted((r.step, r.value) for r in again) == [(1, 0.5), (2, 0.4)]
    assert all(abs(r.ts - datetime.utcnow()) < timedelta(hours=1) for r in again)


def test_losses(spark):
    rows = [("g", 1.0, 3), ("g", 2.0, 1), ("h", 1e6, 1)]
    got = {r.g: (r.loss, r.ppl) for r in R.loss_and_perplexity(spark.createDataFrame(rows, "g string, loss double, n bigint"), ["g"]).collect()}
    assert got["g"] == pytest.approx((1.25, 3.4903429574618414)) and got["h"][1] == float("inf")
    groups = spark.createDataFrame([("r", 1.0, None), ("r", 3.0, float("nan"))], "run string, loss double, chrf double")
    macro = R.macro_average(groups, ["run"], ["loss", "chrf"]).first()
    assert (macro.loss_avg_macro, macro.chrf_avg_macro) == (2.0, None)


def test_log_stream_equals_batch(spark, tmp_path):
    source, out = tmp_path / "log", tmp_path / "out"
    source.mkdir()
    (source / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in LOG[:3]), encoding="utf-8")

    def drain_all():
        records = live.distinct_records(live.read_log_stream(spark, str(source)))
        live.drain(records, live.write_batches(str(out / "records")), str(out / "c1"), "append")
        best = live.best_so_far(live.read_log_stream(spark, str(source)), MODES)
        live.drain(best, live.write_batches(str(out / "best")), str(out / "c2"), "update")

    drain_all()
    (source / "b.jsonl").write_text("".join(json.dumps(r) + "\n" for r in LOG[3:]), encoding="utf-8")
    drain_all()
    records = spark.read.parquet(str(out / "records"))
    assert records.count() == records.select("run", "metric", "step").distinct().count()
    batch = R.metrics_long(spark.read.text(str(source)))
    newest = live.newest_per_key(spark, str(out / "best"), ["run", "metric", "mode"])
    key = lambda df: sorted((r.run, r.metric, r.best_value, r.best_step) for r in df.collect())
    assert key(newest) == key(R.best_final(batch, MODES))


def test_late_records_are_dropped(spark, tmp_path):
    source, out = tmp_path / "log", tmp_path / "out"
    source.mkdir()

    def arrive(name, step, ts):
        (source / name).write_text(json.dumps({"run": "a", "step": step, "ts": ts, "eval_loss": 1.0}) + "\n", encoding="utf-8")
        records = live.distinct_records(live.read_log_stream(spark, str(source)), "1 hour")
        live.drain(records, live.write_batches(str(out / "rows")), str(out / "state"), "append")

    arrive("a.jsonl", 1, "2024-01-01T10:00:00Z")
    arrive("b.jsonl", 2, "2024-01-01T08:00:00Z")
    arrive("c.jsonl", 3, "2024-01-01T09:30:00Z")
    arrive("d.jsonl", 1, "2024-01-01T10:10:00Z")
    assert sorted(r.step for r in spark.read.parquet(str(out / "rows")).collect()) == [1, 3]


@pytest.mark.parametrize("lateness, steps, dropped", [("1 hour", [1], 2), (None, [1, 2, 3], 0)])
def test_late_records_are_kept_or_counted(spark, tmp_path, lateness, steps, dropped):
    source, out = tmp_path / "log", tmp_path / "out"
    source.mkdir()
    lost = []
    for name, found, hour in (("new.jsonl", [1], 10), ("old.jsonl", [2, 3], 8)):
        lines = [{"run": name, "step": s, "ts": f"2024-01-01T{hour:02}:00:00Z", "eval_loss": 1.0} for s in found]
        (source / name).write_text("".join(json.dumps(r) + "\n" for r in lines), encoding="utf-8")
        records = live.distinct_records(live.read_log_stream(spark, str(source)), lateness)
        lost.append(live.drain(records, live.write_batches(str(out / "rows")), str(out / "state"), "append"))
    assert lost == [0, dropped] and sorted(r.step for r in spark.read.parquet(str(out / "rows")).collect()) == steps


def test_dropped_rows_of_many_batches_are_summed(spark, tmp_path):
    source, out = tmp_path / "log", tmp_path / "out"
    source.mkdir()
    for i, hour in enumerate((10, 8, 7, 6, 11)):
        line = {"run": "a", "step": i, "ts": f"2024-01-01T{hour:02}:00:00Z", "eval_loss": 1.0}
        (source / f"{i}.jsonl").write_text(json.dumps(line) + "\n", encoding="utf-8")
        os.utime(source / f"{i}.jsonl", (1.7e9 + i, 1.7e9 + i))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    records = live.distinct_records(R.metrics_long(lines))
    # The watermark a batch is held against is that of the batch before.
    assert live.drain(records, live.write_batches(str(out / "rows")), str(out / "state"), "append") == 2
    assert sorted(r.step for r in spark.read.parquet(str(out / "rows")).collect()) == [0, 1, 4]
