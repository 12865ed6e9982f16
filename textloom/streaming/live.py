"""Streams: a live metric log and scoring of output files as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.repetition import with_repetition
from textloom.operators.fidelity import fidelity_rows
from textloom.operators.runlog import best_final, metrics_long
from textloom.sources.readers import line_text
from textloom.streaming.byte_lines import LEAST_BYTES, MOST_BYTES, line_counts, number_arrived, read_line_stream

RECORD_KEYS = ["run", "metric", "step"]


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Long-form records of a growing folder of JSON-line logs."""
    return metrics_long(spark.readStream.text(path))


def distinct_records(records: DataFrame, lateness: str | None = "1 hour") -> DataFrame:
    """Each (run, metric, step) once; a resumed run logs steps again.

    State is dropped once the watermark has passed a record.  In later batches Spark
    drops every record that is older than the newest one by more than ``lateness``;
    ``drain`` returns how many.  With None no record is dropped, in whatever order
    files arrive, and the state holds the key of every record for good.
    """
    if lateness is None:
        return records.dropDuplicates(RECORD_KEYS)
    return records.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(RECORD_KEYS)


def best_so_far(records: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Best value and its earliest step per run and metric, as ``best_final`` gives it.

    Repeats do not change it, so it needs no dedupe; its state is one row per
    run and metric.
    """
    return best_final(records, modes)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> int:
    """Process all that is there now through ``foreachBatch`` and stop.

    Returns how many rows the watermark dropped as late, by the progress metrics.
    """
    dropped: dict[int, int] = {}
    started = Event()

    def note() -> None:
        for p in query.recentProgress:
            n = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
            dropped[p["batchId"]] = max(dropped.get(p["batchId"], 0), n)

    def noting(batch: DataFrame, batch_id: int) -> None:
        # Spark keeps the progress of a hundred batches only, so they are read at each one.
        started.wait()
        note()
        sink(batch, batch_id)

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(noting).start()
    )
    started.set()
    query.awaitTermination()
    note()
    return sum(dropped.values())


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that writes batch n to ``path/batch=n``; a repeated batch replaces itself."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def newest_per_key(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Latest version of each key among the batches of an update stream."""
    updates = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(
        F.max(F.struct(F.col("batch"), *[F.col(c) for c in rest])).alias("_last")
    ).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def score_arriving_files(
    spark: SparkSession, path: str, out: str, checkpoint: str, add_classes: Callable[[DataFrame], DataFrame] | None = None, *,
    suffix: str = "", growing: bool = False, require_target_lang: bool = True, allow_msa: bool = False, allowed: dict | None = None,
    least_bytes: int = LEAST_BYTES, most_bytes: int = MOST_BYTES,
) -> None:
    """Score every line of the output files below a folder once; the checkpoint remembers the bytes that were read.

    ``<out>/lines`` gets ``source, line_idx, completion, blank`` and both repetition
    penalties, a row for blank lines too, so the rows join to prompts by ``line_idx``.
    With ``add_classes``, which adds ``code, target_lang, dialect, logits, dialectness`` of
    the models to ``source, line_idx, text``, also the four fidelity numbers.  A batch
    that is run again after a failure replaces what it wrote.
    """
    lines = read_line_stream(spark, path, suffix, growing=growing, least_bytes=least_bytes, most_bytes=most_bytes)

    def sink(batch: DataFrame, batch_id: int) -> None:
        line_counts(batch).write.mode("overwrite").parquet(f"{out}/blocks/batch={batch_id}")
        counts = spark.read.option("basePath", f"{out}/blocks").parquet(f"{out}/blocks").where(F.col("batch") <= batch_id)
        texts = number_arrived(batch, counts).select("source", "line_idx", line_text(F.col("line")).alias("completion"))
        scored = with_repetition(texts).withColumn("blank", F.col("completion") == "")
        if add_classes is not None:
            classed = add_classes(scored.withColumn("text", F.col("completion")))
            scored = fidelity_rows(classed, require_target_lang, allow_msa, allowed).drop("text")
        scored.write.mode("overwrite").parquet(f"{out}/lines/batch={batch_id}")

    drain(lines, sink, checkpoint, "append")
