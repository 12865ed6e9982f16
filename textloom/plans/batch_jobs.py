"""Jobs over whole trees of files: each is one Spark job over all files, not a loop over them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.arrays import length_norm_score
from textloom.functions.text import words
from textloom.operators import mbr
from textloom.operators.candidates import align_candidates
from textloom.operators.fidelity import METRICS, fidelity_report, fidelity_rows, report_leftovers
from textloom.operators.mixing import MixEntry, concat_parts, dataset_mix, mix_summary, plan_gaps, plan_table, seeded_shuffle
from textloom.operators.overlap import pair_lines
from textloom.operators.reports import mt_report, unfinished
from textloom.operators.slices import number_rows
from textloom.session import configure, durable
from textloom.sources import readers, writers
from textloom.sources.commits import SIGNATURE, Outputs
from textloom.sources.dims import mt_grid

# <corpus>/<name>.<suffix> at the end of a path
_LEAF = r"([^/]+)/([^/]+)\.[A-Za-z0-9]+$"
_WORK = ["corpus", "dialect"]


def _leaf(path: Column, name: str) -> list[Column]:
    return [F.regexp_extract(path, _LEAF, 1).alias("corpus"), F.regexp_extract(path, _LEAF, 2).alias(name)]


def rank_all(
    spark: SparkSession, runs: str, prompts: str, out: str, add_logprobs: Callable[[DataFrame], DataFrame], *,
    method: str = "*", lang_set: str = "*", length_norm: bool = False, temperature: float = 1.0, risk_temperature: float = 1.0,
) -> DataFrame:
    """Rank the outputs of all runs for every corpus and dialect that is not done yet; returns what was done.

    Outputs are ``<runs>/<base>_<top_p>_<temperature>/<method>/<set>/<corpus>/<dialect>.out``,
    prompts ``<prompts>/<corpus>/<dialect>.csv``.  Rankings go to ``<out>/csv`` and the
    best lines to ``<out>/best``, in folders by corpus and dialect; both and the list of
    what is done (``<out>/commits``) count together or not at all, whenever the job stops.
    A later call skips what is done as long as its files keep their length and time, and
    ranks it again, in place of the old ranking, if one has changed or come.  A corpus and
    dialect without prompts, or with a file of fewer lines than prompts, is left for a later
    call; ``<out>/gaps`` lists the files of this call whose lines do not match their prompts.
    """
    configure(spark)
    outputs = Outputs(spark, out, _WORK, ["csv", "best", "gaps"], ["csv", "best"])
    job = outputs.begin()
    pattern = f"{runs}/*_*_*/{method}/{lang_set}/*/*.out"
    files = readers.list_files(spark, pattern).select("source", *_leaf(F.col("source"), "dialect"))
    states = readers.file_states(spark, pattern).unionByName(readers.file_states(spark, f"{prompts}/*/*.csv"))
    state = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "state"))), "\n"), 256)
    signed = states.select(*_leaf(F.col("source"), "dialect"), "source", "state").groupBy(*_WORK).agg(state.alias(SIGNATURE))
    todo = durable(unfinished(files.join(signed, _WORK), outputs.committed(), [*_WORK, SIGNATURE]))
    every = readers.read_parallel_lines(spark, pattern)

    def unit(line: str) -> Column:
        return F.concat_ws("/", *_WORK, F.format_string("%012d", F.col(line)))

    rows = readers.require_columns(readers.read_csv_rows(spark, f"{prompts}/*/*.csv"), ["prompt"], "prompts")
    prompted = rows.select(*_leaf(F.col("source"), "dialect"), "line_idx", "prompt")
    n_lines = every.groupBy("source").agg((F.max("line_idx") + 1).alias("n_lines"))
    n_prompts = prompted.groupBy(*_WORK).agg((F.max("line_idx") + 1).alias("n_prompts"))
    counts = durable(todo.join(n_lines, "source", "left").join(n_prompts, _WORK, "left").fillna(0, ["n_lines", "n_prompts"]))
    counts.where("n_lines <> n_prompts or n_prompts = 0").drop(SIGNATURE).write.parquet(outputs.staged(job, "gaps"))
    short = counts.where("n_lines < n_prompts or n_prompts = 0").select(*_WORK).distinct()
    todo = durable(todo.join(short, _WORK, "left_anti"))
    lines = every.join(number_rows(todo, _WORK, [F.asc("source")], "cand_idx"), "source")
    asked = prompted.select(unit("line_idx").alias("prompt_id"), "prompt")
    given = lines.select("source", "cand_idx", "completion", unit("line_idx").alias("line_idx"))
    scored = durable(add_logprobs(align_candidates(asked, given)).withColumn(
        "score_used", length_norm_score(F.col("logp_sum"), F.col("token_count"), length_norm)
    ))
    ranked = mbr.rank_by_risk(scored, mbr.score_candidates(scored, temperature, risk_temperature))
    parts = F.split("prompt_id", "/")
    named = durable(ranked.withColumns({"corpus": parts[0], "dialect": parts[1], "prompt_id": parts[2].cast("bigint")}))
    in_order = named.repartitionByRange(*_WORK, "prompt_id", "rank_by_risk").sortWithinPartitions(*_WORK, "prompt_id", "rank_by_risk")
    table = writers.ranked_rows(in_order, _WORK)
    table.write.partitionBy(*_WORK).option("header", True).option("quote", '"').option("escape", '"').csv(outputs.staged(job, "csv"))
    best = in_order.where("rank_by_risk = 1").select(*_WORK, F.concat_ws(
        "\t", F.col("prompt_id").cast("string"), writers.escape_newlines(F.col("completion"))
    ).alias("value"))
    best.write.partitionBy(*_WORK).text(outputs.staged(job, "best"))
    finished = durable(todo.select(*_WORK, SIGNATURE).distinct())
    outputs.commit(job, finished)
    outputs.publish(job)
    return finished.select(*_WORK)


def evaluate_all_translations(
    spark: SparkSession, hyps: str, refs: str, ref_field: str = "completion", tokens: Callable[[Column], Column] = words,
    grid: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The translation report of ``<hyps>/<corpus>/<direction>.out`` against ``<refs>/<corpus>/<direction>.csv``.

    The second table counts, by corpus and direction, lines without a partner; they
    are not scored.  The third counts paired lines of a corpus or direction that the
    report does not hold.  ``grid`` has the ``corpus, direction`` of the report, by default
    the usual ones.
    """
    configure(spark)
    grid = mt_grid(spark) if grid is None else grid
    keys = ["corpus", "direction", "line_idx"]
    given = readers.read_parallel_lines(spark, f"{hyps}/*/*.out").select(
        *_leaf(F.col("source"), "direction"), "line_idx", F.col("completion").alias("text")
    )
    rows = readers.require_columns(readers.read_csv_rows(spark, f"{refs}/*/*.csv"), [ref_field], "references")
    wanted = rows.select(*_leaf(F.col("source"), "direction"), "line_idx", F.col(ref_field).alias("text"))
    pairs = durable(pair_lines(given, wanted, keys))
    split = pairs.where(~F.col("mismatch")).withColumns({"hyp_tokens": tokens(F.col("hyp")), "ref_tokens": tokens(F.col("ref"))})
    unpaired = pairs.where("mismatch").groupBy("corpus", "direction").agg(F.count(F.lit(1)).alias("n"))
    left = split.groupBy("corpus", "direction").agg(F.count(F.lit(1)).alias("n")).join(grid, ["corpus", "direction"], "left_anti")
    return mt_report(split, grid), unpaired, left


def report_fidelity(
    spark: SparkSession, tree: str, add_classes: Callable[[DataFrame], DataFrame], *,
    target_lang: str = "ara", require_target_lang: bool = True, allow_msa: bool = False, grid: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fidelity report of ``<tree>/<set>/<corpus>/<dialect>.out``, over the cells of ``grid`` or the usual ones.

    With it: rows outside the report's grid by set, corpus and dialect, and the files
    without any line.
    """
    configure(spark)
    path = f"{tree}/*/*/*.out"
    lang_set = F.regexp_extract("source", r"([^/]+)/[^/]+/[^/]+$", 1).alias("lang_set")
    lines = readers.read_parallel_lines(spark, path).select(
        "source", "line_idx", F.col("completion").alias("text"), lang_set, *_leaf(F.col("source"), "dialect"),
        F.lit(target_lang).alias("target_lang"),
    )
    rows = durable(fidelity_rows(add_classes(lines), require_target_lang, allow_msa))
    empty = readers.list_files(spark, path).select("source").join(rows.select("source").distinct(), "source", "left_anti")
    return fidelity_report(rows, grid), report_leftovers(rows, grid), empty


def score_everything(
    spark: SparkSession, hyps: str, refs: str, tree: str, add_classes: Callable[[DataFrame], DataFrame], *,
    ref_field: str = "completion", tokens: Callable[[Column], Column] = words, target_lang: str = "ara",
    require_target_lang: bool = True, allow_msa: bool = False, mt_cells: DataFrame | None = None, fidelity_cells: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Translation and fidelity of one set of runs in one job.

    First ``task, lang_set, corpus, target, metric, value, n``, a row per metric of both
    reports (``target`` is the direction or dialect); then ``task, problem, name, n`` for all that
    neither report counts: lines without a partner, cells outside a report, empty files.
    """
    mt, unpaired, mt_left = evaluate_all_translations(spark, hyps, refs, ref_field, tokens, mt_cells)
    fid, fid_left, empty = report_fidelity(
        spark, tree, add_classes, target_lang=target_lang, require_target_lang=require_target_lang, allow_msa=allow_msa, grid=fidelity_cells
    )

    def long(report: DataFrame, task: str, lang_set: Column, target: str, metrics: Sequence[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")
        return report.select(F.lit(task).alias("task"), lang_set.alias("lang_set"), "corpus", F.col(target).alias("target"), "n", each).select(
            "task", "lang_set", "corpus", "target", "m.metric", "m.value", "n"
        )

    def problem(rows: DataFrame, task: str, what: str, names: Sequence[str], n: Column) -> DataFrame:
        return rows.select(F.lit(task).alias("task"), F.lit(what).alias("problem"), F.concat_ws("/", *names).alias("name"), n.alias("n"))

    scores = long(mt, "translation", F.lit(None).cast("string"), "direction", ["chrf", "bleu"]).unionByName(
        long(fid, "fidelity", F.col("lang_set"), "dialect", list(METRICS))
    )
    problems = [
        problem(unpaired, "translation", "lines without a partner", ["corpus", "direction"], F.col("n")),
        problem(mt_left, "translation", "outside the report", ["corpus", "direction"], F.col("n")),
        problem(fid_left, "fidelity", "outside the report", ["lang_set", "corpus", "dialect"], F.col("n")),
        problem(empty, "fidelity", "empty file", ["source"], F.lit(0).cast("bigint")),
    ]
    return scores, reduce(DataFrame.unionByName, problems)


def read_plan(spark: SparkSession, path: str) -> list[MixEntry]:
    """Mix entries from a JSON file: a list of objects with the fields of ``MixEntry``."""
    known = {f.name for f in fields(MixEntry)}
    lines = spark.read.option("multiLine", True).json(path)
    if unknown := set(lines.columns) - known:
        raise ValueError(f"the plan holds settings that are not known: {sorted(unknown)}")
    # A plan is a short list of settings.
    return [MixEntry(**{k: v for k, v in row.asDict().items() if v is not None}).checked() for row in lines.collect()]


def mix_from_plan(spark: SparkSession, plan_path: str, out: str, *, seed: int, leak_safe: bool = True) -> DataFrame:
    """Read, check, mix, shuffle and write the tokenized datasets of a plan; returns the mix's summary.

    Each dataset is a tokenized set as ``prepare_training_set`` writes it.  Rows go to
    ``<out>/rows`` by part and evaluation group, with ``pos`` as their place in the
    shuffled order of their part; the summary goes to ``<out>/summary``.  Both appear
    together; a call that stopped is made good by the next one, and a call after a whole
    one with the same plan, seed and datasets only returns its summary.
    """
    configure(spark)
    entries = read_plan(spark, plan_path)
    outputs = Outputs(spark, out, ["mix"], ["rows", "summary"], [])
    job = outputs.begin()
    states = reduce(DataFrame.unionByName, [readers.file_states(spark, f"{e.path}/rows/*/*.parquet") for e in entries])
    inputs = states.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "source", "state"))), "\n"), 256)).first()[0]
    unit = spark.createDataFrame([("mix", f"{inputs} {entries} {seed} {leak_safe}")], f"mix string, {SIGNATURE} string")
    if unit.join(outputs.committed(), ["mix", SIGNATURE], "left_anti").isEmpty():
        return spark.read.parquet(f"{out}/summary")
    key = ["source", "row_id"]
    parts = [
        readers.require_columns(readers.read_tokenized(spark, f"{e.path}/rows", e.split), key, e.name).withColumn("name", F.lit(e.name))
        for e in entries
    ]
    data, plan = concat_parts(parts), plan_table(spark, entries)
    if gaps := plan_gaps(data, plan).limit(5).collect():
        raise ValueError(f"datasets without rows: {[g.name for g in gaps]}")
    mixed = durable(dataset_mix(data, plan, key, [F.col(k) for k in key], seed, leak_safe))
    place = F.concat_ws(":", "name", *[F.col(k).cast("string") for k in key], F.col("copy").cast("string"), "part")
    shuffled = seeded_shuffle(mixed, place, seed)
    shuffled.write.partitionBy("part").parquet(outputs.staged(job, "rows"))
    mix_summary(mixed, plan).write.parquet(outputs.staged(job, "summary"))
    outputs.commit(job, unit)
    outputs.publish(job)
    return spark.read.parquet(f"{out}/summary")
