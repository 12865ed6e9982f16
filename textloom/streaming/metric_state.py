"""The live metric log with bounded state: records once, late ones held, improvements found on the way.

Runs and metrics are dealt to buckets, and each (bucket, stretch of steps) is a key with a
state: the steps seen of its runs and metrics and their values.  A key costs some
milliseconds a batch whatever it holds, so many short runs share one.  A timer on the log's
time ends what a run and metric has there when it got no record for long.
What the watermark calls late is not dropped but goes out as its own kind of row.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.runlog import best_final, best_history

# A key's state holds so many steps of a run and metric at most, so a run of any length has many keys.
STRETCH_STEPS = 1 << 16
# Runs and metrics are dealt to so many keys a stretch.
BUCKETS = 1 << 8
RECORD, LATE, LOW = "record", "late", "low"
_NONE = -(1 << 63)
_SPREAD = 1 << 10
_KEYS = ["bucket", "stretch"]
_STATE = "groups binary, steps binary, costs binary, timer bigint"
# Of each run and metric of a key: its steps, the newest time in ms, and when its state is looked at again.
_GROUPS = pa.schema([("run", pa.string()), ("metric", pa.string()), ("n", pa.int64()), ("last", pa.int64()), ("due", pa.int64())])
_OUT = "kind string, run string, metric string, step bigint, at bigint, value double"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Equal rows have equal numbers, given in the order of first appearance; null is a value."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        part, values = pd.factorize(column, use_na_sentinel=False)
        code = pd.factorize(code * (len(values) + 1) + part)[0].astype(np.int64)
    return code


def _beats(group: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which costs, sorted by group and step, are below all earlier ones of their group; a group's first always is."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    out = np.ones(len(cost), dtype=bool)
    for start, stop in zip(starts, [*starts[1:], len(cost)]):
        out[start + 1:stop] = cost[start + 1:stop] < np.minimum.accumulate(cost[start:stop])[:-1]
    return out


class MetricState(StatefulProcessor):
    """Rows of one key: new records, those of them that beat all earlier steps of their run and metric in it, and late ones."""

    def __init__(self, modes: dict[str, str], keep_seconds: int):
        self.modes, self.keep = dict(modes), keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _load(self) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, int]:
        """Runs and metrics of the key; steps and costs, sorted by those and step; the timer that is set."""
        state = self.seen.get()
        if state is None:
            return _GROUPS.empty_table().to_pandas(), np.empty(0, dtype=np.int64), np.empty(0), _NONE
        groups = pa.ipc.open_stream(bytes(state[0])).read_all().to_pandas()
        return groups, np.frombuffer(bytes(state[1]), dtype=np.int64), np.frombuffer(bytes(state[2])), int(state[3])

    def _store(self, groups: pd.DataFrame, steps: np.ndarray, costs: np.ndarray, timer: int) -> None:
        due = int(groups["due"].min())
        if due != timer:
            if timer != _NONE:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _GROUPS) as writer:
            writer.write_table(pa.Table.from_pandas(groups, _GROUPS, preserve_index=False))
        self.seen.update((sink.getvalue().to_pybytes(), steps.tobytes(), costs.tobytes(), due))

    def _due(self, last: np.ndarray, watermark: int) -> np.ndarray:
        return np.maximum(np.maximum(last, 0) + self.keep, watermark + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        run, metric, step, at, value = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("run", "metric", "step", "at", "value"))
        watermark = timerValues.getCurrentWatermarkInMs()
        late = (at < watermark * 1000) & (at != _NONE) if watermark > 0 else np.zeros(len(at), dtype=bool)
        # A record without a step cannot be told from another one, so each goes out.
        alone = ~late & (step == _NONE)
        groups, steps, costs, timer = self._load()
        known = len(groups)
        group = _codes(np.concatenate([groups["run"].to_numpy(), run]), np.concatenate([groups["metric"].to_numpy(), metric]))[known:]
        order = np.lexsort((value, at, step, group))
        order = order[~late[order] & ~alone[order]]
        order = order[(np.diff(group[order], prepend=-1) != 0) | (np.diff(step[order], prepend=_NONE) != 0)]
        different, place = np.unique(np.concatenate([steps, step[order]]), return_inverse=True)
        owner = np.concatenate([np.repeat(np.arange(known), groups["n"].to_numpy(dtype=np.int64)), group[order]])
        code = owner * len(different) + place
        fresh = ~np.isin(code[len(steps):], code[:len(steps)])
        order, code = order[fresh], np.concatenate([code[:len(steps)], code[len(steps):][fresh]])
        low = order[:0]
        if len(order):
            signs = np.array([{"min": 1.0, "max": -1.0}.get(self.modes.get(m), np.nan) for m in metric[order]])
            by_step = np.argsort(code, kind="stable")
            owner = np.concatenate([owner[:len(steps)], group[order]])[by_step]
            all_costs = np.concatenate([costs, value[order] * signs])[by_step]
            beats = np.empty(len(code), dtype=bool)
            # A first step beats nothing and counts, whatever its value.
            beats[by_step] = _beats(owner, all_costs)
            low = order[beats[len(steps):] & ~np.isnan(signs)]
            every = int(group.max()) + 1 if len(group) else 0
            every = max(every, known)
            first = np.full(every, -1)
            first[group[::-1]] = np.arange(len(group))[::-1]
            last = np.concatenate([groups["last"].to_numpy(dtype=np.int64), np.full(every - known, _NONE)])
            timed = order[at[order] != _NONE]
            np.maximum.at(last, group[timed], at[timed] // 1000)
            due = np.concatenate([groups["due"].to_numpy(dtype=np.int64), self._due(last[known:], watermark)])
            grown = pd.DataFrame({
                "run": np.concatenate([groups["run"].to_numpy(), run[first[known:]]]), "metric": np.concatenate([groups["metric"].to_numpy(), metric[first[known:]]]),
                "n": np.bincount(owner, minlength=every), "last": last, "due": due,
            })
            self._store(grown[grown["n"] > 0], np.concatenate([steps, step[order]])[by_step], all_costs, timer)
        parts = [(LATE, np.flatnonzero(late)), (RECORD, np.flatnonzero(alone)), (RECORD, order), (LOW, low)]
        rows_out = np.concatenate([index for _, index in parts])
        yield pd.DataFrame({
            "kind": np.repeat([kind for kind, _ in parts], [len(index) for _, index in parts]).astype(object), "run": run[rows_out], "metric": metric[rows_out],
            "step": step[rows_out], "at": at[rows_out], "value": value[rows_out],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        groups, steps, costs, _ = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        last, due, n = (groups[c].to_numpy(dtype=np.int64) for c in ("last", "due", "n"))
        asked = due <= now
        ends = asked & (last != _NONE) & (last + self.keep <= now)
        # Records without a time count from the first time that is known.
        last = np.where(asked & (last == _NONE), now, last)
        due = np.where(asked, self._due(last, now), due)
        if ends.all():
            self.seen.clear()
        else:
            keep = ~np.repeat(ends, n)
            # The timer that fired is gone.
            self._store(groups.assign(last=last, due=due)[~ends], steps[keep], costs[keep], _NONE)
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype="object" if "string" in c else "int64" if "bigint" in c else "float64") for c in _OUT.split(", ")})

    def close(self) -> None:
        pass


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (run, metric, step) of an Arrow batch once, the earliest: a record repeated a million times sends few rows."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        at = pa.array(range(rows.num_rows), pa.int64())
        ranked = rows.append_column("_i", at).sort_by([("at", "ascending"), ("value", "ascending"), ("_i", "ascending")])
        ranked = ranked.append_column("_r", at)
        # Those without a step stay apart.
        alone = pa.compute.if_else(pa.compute.equal(ranked.column("step"), _NONE), ranked.column("_i"), -1)
        first = ranked.append_column("_a", alone).group_by(["run", "metric", "step", "_a"]).aggregate([("_r", "min")])
        yield from ranked.take(first.column("_r_min")).select(batch.schema.names).to_batches()


def track_metrics(
    records: DataFrame, modes: dict[str, str], *, lateness_seconds: int = 3600, keep_seconds: int = 86_400, stretch_steps: int = STRETCH_STEPS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``kind, run, metric, step, ts, value`` of a stream of long-form records.

    ``record``: each (run, metric, step) once, the earliest of a batch; a resumed run logs
    steps again.  ``late``: records older than the newest one by more than
    ``lateness_seconds`` when they come, unchecked for repeats.  ``low``: records of tracked metrics
    that beat every earlier step of their stretch known so far; ``improvements`` finds the
    running best among them.  A record without a time is never late, one without a
    step never a repeat.  State goes ``keep_seconds`` of the log's time after the last record of a
    stretch; a step logged again later than that comes out again (``metric_records`` still gives it once).
    A key's state holds the share of one in ``buckets`` of the runs and metrics, at 16 bytes a step; a log
    of very many long runs takes more buckets.  A checkpoint keeps to the number it began with.
    """
    bad = set(modes.values()) - {"min", "max"}
    if bad:
        raise ValueError(f"unknown mode: {sorted(bad)}")
    step = F.coalesce("step", F.lit(_NONE))
    spread = -F.pmod(F.xxhash64("ts", "value"), F.lit(_SPREAD)) - 1
    # The time goes on as a plain number: a timestamp would make Spark drop the late rows itself.
    rows = records.withWatermark("ts", f"{lateness_seconds} seconds").select(
        "run", "metric", F.pmod(F.xxhash64("run", "metric"), F.lit(buckets)).alias("bucket"), F.when(F.col("step").isNull(), spread).otherwise(F.floor(F.col("step") / stretch_steps)).alias("stretch"),
        step.alias("step"), F.coalesce(F.unix_micros("ts"), F.lit(_NONE)).alias("at"), "value",
    )
    rows = rows.mapInArrow(_without_repeats, rows.schema)
    out = rows.groupBy(*_KEYS).transformWithStateInPandas(MetricState(modes, keep_seconds), _OUT, "append", "eventTime")
    return out.select(
        "kind", "run", "metric", F.nullif("step", F.lit(_NONE)).alias("step"), F.timestamp_micros(F.nullif("at", F.lit(_NONE))).alias("ts"), "value"
    )


@contextmanager
def rocks_state(spark: SparkSession):
    """Queries started inside keep their state where processors with timers need it."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def follow_metrics(tracked: DataFrame, out: str, checkpoint: str) -> list[int]:
    """Write what is there now to ``<out>/batch=n/kind=...``; a batch run again replaces itself.

    Returns the keys that have a state after each batch of this run, oldest first, as far as
    Spark remembers them.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={batch_id}")

    with rocks_state(tracked.sparkSession):
        query = (
            tracked.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(sink).start()
        )
    query.awaitTermination()
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]


def _kind(spark: SparkSession, out: str, kind: str) -> DataFrame:
    schema = "run string, metric string, step bigint, ts timestamp, value double, batch int, kind string"
    rows = spark.read.schema(schema).option("basePath", out).parquet(out)
    return rows.where(F.col("kind") == kind).drop("kind")


def metric_records(spark: SparkSession, out: str) -> DataFrame:
    """Every record once, by its first batch."""
    rows = _kind(spark, out, RECORD)
    keyed = rows.where(F.col("step").isNotNull()).groupBy("run", "metric", "step").agg(F.min(F.struct("batch", "ts", "value")).alias("f"))
    return keyed.select("run", "metric", "step", "f.ts", "f.value").unionByName(rows.where(F.col("step").isNull()).drop("batch"))


def late_records(spark: SparkSession, out: str) -> DataFrame:
    """The records that came late, with the batch that brought them."""
    return _kind(spark, out, LATE)


def _lows(spark: SparkSession, out: str) -> DataFrame:
    rows = _kind(spark, out, LOW)
    first = rows.groupBy("run", "metric", "step").agg(F.min(F.struct("batch", "ts", "value")).alias("f"))
    return first.select("run", "metric", "step", "f.ts", "f.value")


def improvements(spark: SparkSession, out: str, modes: dict[str, str]) -> DataFrame:
    """Every record that strictly improved on all earlier steps of its run and metric.

    Such a record is the lowest so far in its stretch too, so only those are compared.
    """
    return best_history(_lows(spark, out), modes)


def best_values(spark: SparkSession, out: str, modes: dict[str, str]) -> DataFrame:
    """Best value per run and metric with its earliest step, as ``best_final`` gives it."""
    return best_final(_lows(spark, out), modes)
