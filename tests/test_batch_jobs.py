import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import candidates as C
from textloom.operators import fidelity as D
from textloom.operators import mbr
from textloom.operators.runlog import metrics_long, rejected_lines
from textloom.operators.slices import take_by_hash, number_by_hash
from textloom.plans import batch_jobs, jobs
from textloom.sources import readers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def with_logprobs(df):
    return df.withColumn("logp_sum", -F.length("completion").cast("double")).withColumn("token_count", F.lit(2).cast("bigint"))


def test_ranks_follow_the_risk_when_probabilities_vanish(spark):
    risks = [0.9, 0.2, 0.25, 0.98, 0.921, 0.2]
    rows = [(0, i, r, -float(i), 0.0) for i, r in enumerate(risks)]
    df = spark.createDataFrame(rows, "prompt_id int, cand_idx int, risk_final double, score_used double, p_risk double")
    got = {r.cand_idx: r.rank_by_risk for r in mbr.rank_by_risk(df.select("prompt_id", "cand_idx"), df).collect()}
    assert [got[i] for i in range(6)] == [4, 1, 3, 6, 5, 2]


def test_empty_files_and_given_order(spark, tmp_path):
    put(tmp_path / "p.csv", "prompt\nq1\nq2\nq3\n")
    put(tmp_path / "a.out", "x y\nx y\nx y\n")
    put(tmp_path / "b.out", "x  y\nx y\nz z\n")
    put(tmp_path / "e.out", "")
    paths = {n: str(tmp_path / f"{n}.out") for n in "abe"}
    ranked = jobs.rank_outputs(spark, str(tmp_path / "p.csv"), [paths["b"], paths["a"]], with_logprobs, dedupe=True)
    first = {r.prompt_id: r.source[-5:] for r in ranked.where("cand_idx = 1").collect()}
    assert first == {0: "b.out", 1: "b.out", 2: "b.out"}
    with pytest.raises(ValueError, match="e.out', 0"):
        jobs.rank_outputs(spark, str(tmp_path / "p.csv"), [paths["a"], paths["e"]], with_logprobs, strict=True)
    lines = readers.read_parallel_lines(spark, [paths["a"], paths["e"]])
    files = readers.list_files(spark, [paths["a"], paths["e"]])
    assert [(r.source[-5:], r.n_lines) for r in C.short_sources(lines, 3, files).collect()] == [("e.out", 0)]


def test_odd_logs_and_paths(spark):
    lines = ['{"run":"r","step":1.0,"ts":"2024-01-01T00:00:00Z","loss":2}', '{"run":"r","step":2,"ts":"n/a","loss":1}', "{cut", "", '{"run":"r","loss":1}']
    log = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted((str(r.step), r.value) for r in metrics_long(log).collect()) == [("1", 2.0), ("2", 1.0), ("None", 1.0)]
    assert sorted(r.reason for r in rejected_lines(log).collect()) == ["no record", "no record", "no step", "no time"]
    paths = spark.createDataFrame([("f:/b_x_y/m/s/c/d.out",), ("f:/b_0.5_1.2.3/m/s/c/d.out",)], "p string")
    rows = paths.select(*readers.run_path_fields(F.col("p"))).collect()
    assert rows[0].top_p is None and (rows[1].top_p, rows[1].temperature) == (0.5, None)


def test_unknown_dialect_scores_nothing(spark):
    row = spark.createDataFrame([("text", "arz", "ara", [0.0] * 18, 0.7, "pes")], "text string, code string, target_lang string, logits array<double>, dialectness double, dialect string")
    got = D.fidelity_rows(row).first()
    assert (got.prob, got.dialectness, got.score, got.macro_score) == (0, 0, 0, 0)
    lines = spark.createDataFrame([("a.out",), ("a.out",), ("x.out",)], "source string")
    manifest = spark.createDataFrame([("a.out", "egy"), ("b.out", "syr")], "source string, dialect string")
    assert sorted(map(tuple, D.manifest_mismatch(lines, manifest).collect())) == [("b.out", "syr", 0), ("x.out", None, 1)]


@pytest.mark.parametrize("share", [0.0, 0.003, 0.5, 0.999, 1.0, 7.0])
def test_boundary_slice_takes_what_a_full_order_would(spark, share):
    df = spark.range(5000).select("id", (F.col("id") % 5 > 0).cast("int").alias("g"))

    def wanted(size, s):
        return F.ceil(size * s)

    got = {r.id: r.taken for r in take_by_hash(df, ["g"], F.col("id"), 3, wanted, F.lit(share), "taken").collect()}
    sizes = {0: 1000, 1: 4000}
    ranked = number_by_hash(df, ["g"], F.col("id"), 3).collect()
    assert got == {r.id: r.rn <= -(-sizes[r.g] * share // 1) for r in ranked}


def test_lines_of_many_blocks_keep_their_numbers(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1), ("c", 0)):
        put(tmp_path / f"{name}.txt", "".join(f"{name} {i}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.read_lines(spark, f"{tmp_path}/*.txt")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert all(f"{r.source[-5]} {r.line_idx}" == r.line for r in rows.collect()) and rows.count() == 3001
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rank_all(spark, tmp_path):
    for run in ("base_0.5_0.7", "base_0.9_0.7"):
        for corpus, dialect in (("wiki", "egy"), ("wiki", "syr")):
            put(tmp_path / f"runs/{run}/mono/small/{corpus}/{dialect}.out", f"{dialect} one {run}\n{dialect} two\n")
    for dialect in ("egy", "syr"):
        put(tmp_path / f"prompts/wiki/{dialect}.csv", "prompt\np1\np2\n")
    args = (spark, str(tmp_path / "runs"), str(tmp_path / "prompts"), str(tmp_path / "out"), with_logprobs)
    assert sorted(map(tuple, batch_jobs.rank_all(*args).collect())) == [("wiki", "egy"), ("wiki", "syr")]
    best = spark.read.text(f"{tmp_path}/out/best").collect()
    assert sorted((r.dialect, r.value) for r in best if r.value.startswith("1")) == [("egy", "1\tegy two"), ("syr", "1\tsyr two")]
    assert readers.read_csv(spark, f"{tmp_path}/out/csv").count() == 8
    put(tmp_path / "runs/base_0.5_0.7/mono/small/news/egy.out", "late\n")
    put(tmp_path / "prompts/news/egy.csv", "prompt\np1\n")
    assert [tuple(r) for r in batch_jobs.rank_all(*args).collect()] == [("news", "egy")]
    assert readers.read_csv(spark, f"{tmp_path}/out/csv").count() == 9


def test_rank_all_leaves_what_is_not_whole(spark, tmp_path):
    for dialect, text in (("egy", "a\nb\n"), ("syr", "a\n"), ("irq", ""), ("mor", "a\nb\n"), ("tun", "a\nb\nc\n")):
        put(tmp_path / f"runs/base_0.5_0.7/mono/small/wiki/{dialect}.out", text)
        if dialect != "mor":
            put(tmp_path / f"prompts/wiki/{dialect}.csv", "prompt\np1\np2\n")
    args = (spark, str(tmp_path / "runs"), str(tmp_path / "prompts"), str(tmp_path / "out"), with_logprobs)

    def gaps():
        return sorted((r.dialect, r.n_lines, r.n_prompts) for r in spark.read.parquet(f"{tmp_path}/out/gaps").collect())

    assert sorted(r.dialect for r in batch_jobs.rank_all(*args).collect()) == ["egy", "tun"]
    assert gaps() == [("irq", 0, 2), ("mor", 2, 0), ("syr", 1, 2), ("tun", 3, 2)]
    put(tmp_path / "runs/base_0.5_0.7/mono/small/wiki/syr.out", "a\nb\n")
    put(tmp_path / "prompts/wiki/mor.csv", "prompt\np1\np2\n")
    assert sorted(r.dialect for r in batch_jobs.rank_all(*args).collect()) == ["mor", "syr"] and gaps() == [("irq", 0, 2)]
    assert readers.read_csv(spark, f"{tmp_path}/out/csv").count() == 8


def test_evaluate_all(spark, tmp_path):
    from textloom.sources.dims import MT_CORPORA, mt_grid

    corpus, direction = MT_CORPORA[0], mt_grid(spark).first().direction
    put(tmp_path / f"h/{corpus}/{direction}.out", "the cat sat\na dog\nextra\n")
    put(tmp_path / f"r/{corpus}/{direction}.csv", "completion\nthe cat sat\na dog\n")
    put(tmp_path / f"h/{corpus}/xxx-yyy.out", "a\nb\n")
    put(tmp_path / f"r/{corpus}/xxx-yyy.csv", "completion\na\nb\n")
    report, unpaired, left = batch_jobs.evaluate_all_translations(spark, str(tmp_path / "h"), str(tmp_path / "r"))
    rows = {(r.corpus, r.direction): r for r in report.collect()}
    assert rows[(corpus, direction)].n == 2 and rows[(corpus, direction)].chrf == pytest.approx(100.0)
    assert sum(r.n for r in rows.values()) == 2 and [tuple(r) for r in unpaired.collect()] == [(corpus, direction, 1)]
    assert [tuple(r) for r in left.collect()] == [(corpus, "xxx-yyy", 2)]


def test_report_fidelity(spark, tmp_path):
    from textloom.sources.dims import fidelity_grid

    cell = fidelity_grid(spark).first()
    put(tmp_path / f"t/{cell.lang_set}/{cell.corpus}/{cell.dialect}.out", "good\nbetter\n")
    put(tmp_path / f"t/{cell.lang_set}/{cell.corpus}/zzz.out", "lost\n")
    put(tmp_path / f"t/{cell.lang_set}/{cell.corpus}/yyy.out", "")

    def add_classes(df):
        return df.withColumns({"code": F.lit("arz"), "logits": F.array_repeat(F.lit(0.0), 18), "dialectness": F.lit(0.9)})

    report, left, empty = batch_jobs.report_fidelity(spark, str(tmp_path / "t"), add_classes)
    assert {(r.corpus, r.dialect): r.n for r in report.where("n > 0").collect()} == {(cell.corpus, cell.dialect): 2}
    assert [(r.dialect, r.n) for r in left.collect()] == [("zzz", 1)]
    assert [r.source[-7:] for r in empty.collect()] == ["yyy.out"]


def test_mix_from_plan(spark, tmp_path):
    def encoder():
        return lambda text: [ord(c) for c in text]

    for name, n in (("one", 10), ("two", 4)):
        put(tmp_path / f"{name}.csv", "prompt,completion\n" + "".join(f"p{i},c{i}\n" for i in range(n)))
        jobs.prepare_training_set(spark, str(tmp_path / f"{name}.csv"), str(tmp_path / name), encoder, max_length=200)
    plan = [{"name": "one", "path": str(tmp_path / "one"), "repeat": 2, "val_ratio": 0.2}, {"name": "two", "path": str(tmp_path / "two"), "role": "eval", "sample_n": 3}]
    put(tmp_path / "plan.json", json.dumps(plan))
    summary = batch_jobs.mix_from_plan(spark, str(tmp_path / "plan.json"), str(tmp_path / "mix"), seed=1).collect()
    assert sorted((r.name, r.part, r.n) for r in summary) == [("one", "eval", 2), ("one", "train", 16), ("two", "eval", 3)]
    rows = spark.read.parquet(str(tmp_path / "mix" / "rows"))
    assert rows.count() == 21 and rows.select("pos").distinct().count() == 21
    put(tmp_path / "bad.json", json.dumps([{"name": "one", "path": str(tmp_path / "one"), "speed": 2}]))
    with pytest.raises(ValueError, match="speed"):
        batch_jobs.mix_from_plan(spark, str(tmp_path / "bad.json"), str(tmp_path / "m2"), seed=1)


def test_everything_over_cells_of_ones_own(spark, tmp_path):
    put(tmp_path / "h/news/aa-bb.out", "the cat sat\na dog\n")
    put(tmp_path / "r/news/aa-bb.csv", "completion\nthe cat sat\na dog\nmore\n")
    put(tmp_path / "t/mono/blog/egy.out", "good\n\n")
    put(tmp_path / "t/mono/blog/syr.out", "other\n")
    put(tmp_path / "t/mono/blog/irq.out", "")

    def add_classes(df):
        return df.withColumns({"code": F.lit("arz"), "logits": F.array_repeat(F.lit(0.0), 18), "dialectness": F.lit(0.9)})

    mt_cells = spark.createDataFrame([("news", "aa-bb"), ("news", "bb-aa")], "corpus string, direction string")
    fidelity_cells = spark.createDataFrame([("mono", "blog", "egy")], "lang_set string, corpus string, dialect string")
    scores, problems = batch_jobs.score_everything(
        spark, str(tmp_path / "h"), str(tmp_path / "r"), str(tmp_path / "t"), add_classes, mt_cells=mt_cells, fidelity_cells=fidelity_cells)
    got = {(r.task, r.corpus, r.target, r.metric): (round(r.value, 4), r.n) for r in scores.collect()}
    assert got["translation", "news", "aa-bb", "chrf"] == (100.0, 2) and got["translation", "news", "bb-aa", "bleu"] == (0.0, 0)
    assert got["fidelity", "blog", "egy", "prob"] == (round(1 / 36, 4), 2) and len(got) == 8
    found = sorted((r.task, r.problem, r.name.split("/")[-1], r.n) for r in problems.collect())
    assert found == [("fidelity", "empty file", "irq.out", 0), ("fidelity", "outside the report", "syr", 1), ("translation", "lines without a partner", "aa-bb", 1)]
