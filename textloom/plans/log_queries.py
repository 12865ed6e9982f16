"""Queries over metric logs, as batch tables and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from textloom.operators import runlog as R
from textloom.plans import twins as T
from textloom.plans.fixtures import metric_log, r6, table
from textloom.plans.registry import query
from textloom.session import shared_folder
from textloom.sources.readers import line_text, spread
from textloom.functions.repetition import with_repetition
from textloom.streaming import live
from textloom.streaming.metric_state import follow_metrics, improvements, late_records, metric_records, track_metrics

MODES = {"view": "min", "click": "max", "purchase": "max"}
_LOG = """
    log AS (SELECT user_id::VARCHAR AS run, event_id AS step, event_type AS metric, value,
                   (props->>'$.k')::BIGINT AS n FROM events),
    tracked AS (SELECT *, CASE WHEN metric = 'view' THEN 'min' ELSE 'max' END AS mode,
                       CASE WHEN metric = 'view' THEN value ELSE -value END AS cost
                FROM log WHERE metric IN ('view', 'click', 'purchase'))"""
_BEST = f"""
    WITH {_LOG}
    SELECT run, metric, mode, arg_min(value, (cost, step)) AS best_value, arg_min(step, (cost, step)) AS best_step
    FROM tracked GROUP BY run, metric, mode"""


def _log_lines(events, odd=False, carried=()):
    """Events as the JSON lines a training run appends; ``odd``: some steps as floats, some times unreadable."""
    step, time = F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if odd:
        step = F.when(F.col("event_id") % 19 == 0, F.concat(step, F.lit(".0"))).otherwise(step)
        time = F.when(F.col("event_id") % 23 == 0, "n/a").otherwise(time)
    return events.select(*carried, F.concat(
        F.lit('{"run":"'), F.col("user_id"), F.lit('","step":'), step, F.lit(',"ts":"'),
        time, F.lit('","'), F.col("event_type"), F.lit('":'),
        F.when(F.col("event_id") % 17 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string")),
        F.lit(',"eval_k":'), F.get_json_object("props", "$.k"), F.lit("}"),
    ).alias("value"))


@query("metrics_long", """
    SELECT user_id::VARCHAR AS run, event_id AS step, event_type AS metric, value FROM events WHERE event_id % 17 <> 0
    UNION ALL SELECT user_id::VARCHAR, event_id, 'eval_k', (props->>'$.k')::DOUBLE FROM events""")
def metrics_long(spark, sf_dir):
    lines = _log_lines(table(spark, sf_dir, "events"), odd=True)
    return R.metrics_long(lines.unionAll(lines.select(F.lit("cut {")))).select("run", "step", "metric", "value")


@query("rejected_lines", """
    SELECT reason, sum(n)::BIGINT AS n, count(*) AS k FROM (
        SELECT 'no time' AS reason, 1 AS n FROM events WHERE event_id % 23 = 0
        UNION ALL SELECT 'no record', count(*) FROM events) GROUP BY reason""")
def rejected_lines(spark, sf_dir):
    lines = _log_lines(table(spark, sf_dir, "events"), odd=True)
    found = R.rejected_lines(lines.unionAll(lines.select(F.lit("cut {"))))
    return found.groupBy("reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))


@query("loss_ppl", f"""
    WITH {_LOG}
    SELECT run, {T.r6('loss')} AS loss, {T.r6('exp(loss)')} AS ppl
    FROM (SELECT run, sum(value / 100 * n) / greatest(1, sum(n)) AS loss FROM log GROUP BY run)""")
def loss_ppl(spark, sf_dir):
    batches = metric_log(spark, sf_dir).withColumn("loss", F.col("value") / 100)
    return R.loss_and_perplexity(batches, ["run"]).select("run", r6("loss").alias("loss"), r6("ppl").alias("ppl"))


@query("macro_average", f"""
    WITH {_LOG}, groups AS (
        SELECT run, metric AS eval_group, avg(value) AS eval_loss,
               CASE WHEN metric IN ('view', 'click') THEN max(value) END AS eval_chrfpp FROM log GROUP BY run, metric)
    SELECT run, {T.r6('avg(eval_loss)')} AS eval_loss_avg_macro, {T.r6('avg(eval_chrfpp)')} AS eval_chrfpp_avg_macro
    FROM groups GROUP BY run""")
def macro_average(spark, sf_dir):
    groups = metric_log(spark, sf_dir).groupBy("run", F.col("metric").alias("eval_group")).agg(
        F.avg("value").alias("eval_loss"), F.max("value").alias("_peak")
    ).withColumn("eval_chrfpp", F.when(F.col("eval_group").isin("view", "click"), F.col("_peak")))
    macro = R.macro_average(groups, ["run"], ["eval_loss", "eval_chrfpp"])
    return macro.select("run", *[r6(c).alias(c) for c in ("eval_loss_avg_macro", "eval_chrfpp_avg_macro")])


@query("latest_eval", f"""
    WITH {_LOG}
    SELECT run, max(step) AS step, arg_max(value, step) AS error, min(value) AS best_metric
    FROM log WHERE metric = 'error' GROUP BY run""")
def latest_eval(spark, sf_dir):
    return R.latest_eval(metric_log(spark, sf_dir), "error")


@query("best_metric_history", f"""
    WITH {_LOG}
    SELECT run, metric, step, value FROM (
        SELECT *, min(cost) OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
        FROM tracked) WHERE best IS NULL OR cost < best""")
def best_metric_history(spark, sf_dir):
    return R.best_history(metric_log(spark, sf_dir), MODES).select("run", "metric", "step", "value")


@query("best_metric_final", _BEST)
def best_metric_final(spark, sf_dir):
    return R.best_final(metric_log(spark, sf_dir), MODES)


def _fresh_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


@query("stream_metric_records", """
    SELECT user_id::VARCHAR AS run, event_id AS step, event_type AS metric, value FROM events WHERE event_id % 17 <> 0
    UNION ALL SELECT user_id::VARCHAR, event_id, 'eval_k', (props->>'$.k')::DOUBLE FROM events""")
def stream_metric_records(spark, sf_dir):
    """Events as a stream of log lines, every line twice; each record once, however late it comes."""
    folder = _fresh_folder(spark)
    twice = _event_stream(spark, sf_dir).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    records = live.distinct_records(R.metrics_long(_log_lines(twice)), None)
    live.drain(records, live.write_batches(f"{folder}/out"), f"{folder}/state", "append")
    return spark.read.parquet(f"{folder}/out").select("run", "step", "metric", "value")


@query("stream_best_metric", _BEST)
def stream_best_metric(spark, sf_dir):
    """Best value per run and metric kept by a stream of events."""
    folder = _fresh_folder(spark)
    records = _event_stream(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"),
        F.col("event_type").alias("metric"), "value",
    )
    live.drain(live.best_so_far(records, MODES), live.write_batches(f"{folder}/out"), f"{folder}/state", "update")
    return live.newest_per_key(spark, f"{folder}/out", ["run", "metric", "mode"])


# Seconds after which a record is late, and the share of events that come first.
_LATE_SECONDS = 86_400
_TIMED = f"""
    {_LOG},
    lines AS (SELECT user_id::VARCHAR AS run, event_id AS step, event_type AS metric, value, ts FROM events WHERE event_id % 17 <> 0
              UNION ALL SELECT user_id::VARCHAR, event_id, 'eval_k', (props->>'$.k')::DOUBLE, ts FROM events),
    kinds AS (SELECT *, CASE WHEN step % 10 >= 7 AND ts < (
                  SELECT max(ts) FROM lines WHERE step % 10 < 7) - INTERVAL {_LATE_SECONDS} SECOND THEN 'late' ELSE 'record' END AS kind FROM lines)"""


def _followed_events(spark, sf_dir):
    """Events as lines of a log, each twice: seven tenths of them first, the rest after a restart."""
    folder = _fresh_folder(spark)
    lines = _log_lines(table(spark, sf_dir, "events").withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))), carried=["event_id"])
    for early in (True, False):
        part = lines.where((F.col("event_id") % 10 < 7) == early).select("value")
        part.write.mode("append").text(f"{folder}/log")
        tracked = track_metrics(live.read_log_stream(spark, f"{folder}/log"), MODES, lateness_seconds=_LATE_SECONDS, keep_seconds=7 * _LATE_SECONDS)
        follow_metrics(tracked, f"{folder}/out", f"{folder}/state")
    return f"{folder}/out"


@query("stream_metric_state", f"""
    WITH {_TIMED} SELECT kind, run, step, metric, value FROM kinds UNION ALL
    SELECT 'improved', run, step, metric, value FROM (
        SELECT *, min(cost) OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
        FROM (SELECT *, CASE WHEN metric = 'view' THEN value ELSE -value END AS cost FROM kinds
              WHERE kind = 'record' AND metric IN ('view', 'click', 'purchase'))) WHERE best IS NULL OR cost < best""")
def stream_metric_state(spark, sf_dir):
    """What the state of a growing log gives: records once, late ones held apart, strict improvements."""
    out = _followed_events(spark, sf_dir)
    found = {
        "record": metric_records(spark, out), "late": late_records(spark, out).dropDuplicates(live.RECORD_KEYS),
        "improved": improvements(spark, out, MODES),
    }
    parts = [rows.select(F.lit(kind).alias("kind"), "run", "step", "metric", "value") for kind, rows in found.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("stream_word_repetition", f"""
    WITH {T.repetition('documents', 'doc_id', 'text', 'reps')}
    SELECT doc_id, {T.r6('greatest(w4, c8, run)')} AS word_rep_penalty, {T.r6('greatest(rep, loop)')} AS sent_rep_penalty
    FROM reps""")
def stream_word_repetition(spark, sf_dir):
    """Documents scored as a stream of arriving texts."""
    folder = _fresh_folder(spark)
    schema = table(spark, sf_dir, "documents").schema
    texts = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet").select("doc_id", "text")

    def sink(batch, batch_id):
        # A file of few row groups is read by few tasks.
        scored = with_repetition(spread(batch, "doc_id").withColumn("completion", line_text(F.col("text"))))
        live.write_batches(f"{folder}/out")(scored.drop("text", "completion"), batch_id)

    live.drain(texts, sink, f"{folder}/state", "append")
    return spark.read.parquet(f"{folder}/out").select(
        "doc_id", r6("word_rep_penalty").alias("word_rep_penalty"), r6("sent_rep_penalty").alias("sent_rep_penalty")
    )
