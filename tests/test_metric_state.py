"""The metric log with timed state: nothing lost, late records held, state that ends."""

import datetime as dt
import json
import random

import pytest

from textloom.operators import runlog as R
from textloom.streaming import live
from textloom.streaming import metric_state as M

MODES = {"loss": "min", "chrf": "max"}
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


class Log:
    def __init__(self, spark, folder, **options):
        self.spark, self.source, self.out, self.state = spark, folder / "log", folder / "out", folder / "state"
        self.source.mkdir()
        self.options, self.n = options, 0

    def arrive(self, *records):
        """Records (run, step, second, metric, value) as a file and a batch of their own; returns keys with state."""
        lines = []
        for run, step, second, metric, value in records:
            ts = None if second is None else (START + dt.timedelta(seconds=second)).isoformat()
            lines.append(json.dumps({"run": run, "step": step, "ts": ts, metric: value}))
        (self.source / f"{self.n}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        self.n += 1
        tracked = M.track_metrics(live.read_log_stream(self.spark, str(self.source)), MODES, **self.options)
        return M.follow_metrics(tracked, str(self.out), str(self.state))

    def got(self, read, *args):
        return sorted((r.run, r.metric, r.step, r.value) for r in read(self.spark, str(self.out), *args).collect())


def plain_history(records):
    best, out = {}, []
    for run, step, metric, value in sorted(records, key=lambda r: r[1]):
        cost = value if MODES[metric] == "min" else -value
        if cost < best.get((run, metric), float("inf")):
            best[run, metric] = cost
            out.append((run, metric, step, value))
    return sorted(out), {k: v for k, v in best.items()}


def test_improvements_and_best_over_batches_and_stretches(spark, tmp_path):
    draw = random.Random(12)
    log = Log(spark, tmp_path, stretch_steps=5, lateness_seconds=10 ** 6)
    steps = {m: draw.sample(range(40), 30) for m in MODES}
    rows = [("a", s, s, m, float(draw.randint(0, 12))) for m in MODES for s in steps[m]]
    draw.shuffle(rows)
    # Every step again, in its own batch and in a later one.
    for i in range(2):
        part = rows[30 * i:30 * i + 30]
        log.arrive(*part, *part, *rows[:30 * i])
    plain, best = plain_history([(run, s, m, v) for run, s, _, m, v in rows])
    assert log.got(M.improvements, MODES) == plain
    assert log.got(M.metric_records) == sorted((run, m, s, v) for run, s, _, m, v in rows)
    found = {(r.run, r.metric): (r.best_value, r.best_step) for r in M.best_values(spark, str(log.out), MODES).collect()}
    assert {k: v if MODES[k[1]] == "min" else -v for k, (v, _) in found.items()} == best
    lines = R.metrics_long(spark.read.text(str(log.source)))
    batch = {(r.run, r.metric): (r.best_value, r.best_step) for r in R.best_final(lines, MODES).collect()}
    assert found == batch
    assert M.late_records(spark, str(log.out)).count() == 0


def test_late_records_are_held_and_state_ends(spark, tmp_path):
    log = Log(spark, tmp_path, lateness_seconds=60, keep_seconds=600)
    size = log.arrive(("a", 1, 0, "loss", 3.0), ("b", 1, 0, "loss", 9.0), ("c", 1, None, "loss", 1.0), ("d", None, 0, "loss", 2.0), ("d", None, 0, "loss", 2.0))[-1]
    # Three keys; records without a step have no state.
    assert size == 3
    assert log.arrive(("a", 2, 300, "loss", 2.0), ("b", 1, 290, "loss", 9.0))[-1] == 3
    # Older than the newest by more than a minute: held, not dropped, and it changes no best value.
    log.arrive(("a", 0, 100, "loss", 0.5), ("b", 2, 299, "loss", 8.0), ("b", 2, 299, "loss", 8.0))
    assert log.got(M.late_records) == [("a", "loss", 0, 0.5)]
    assert log.got(M.improvements, {"loss": "min"}) == [
        ("a", "loss", 1, 3.0), ("a", "loss", 2, 2.0), ("b", "loss", 1, 9.0), ("b", "loss", 2, 8.0), ("c", "loss", 1, 1.0)]
    # Long after, the timers of a, b and c have fired; only the new key has a state.
    sizes = log.arrive(("e", 1, 5000, "loss", 1.0)) + log.arrive(("e", 2, 5001, "loss", 0.5))
    assert sizes[-1] == 1
    # A step logged again after its state has gone comes out again, and is still read once.
    log.arrive(("a", 2, 5002, "loss", 2.0))
    assert [r for r in log.got(M.metric_records) if r[0] == "a"] == [("a", "loss", 1, 3.0), ("a", "loss", 2, 2.0)]
    assert [r for r in log.got(M.improvements, {"loss": "min"}) if r[0] == "a"] == [("a", "loss", 1, 3.0), ("a", "loss", 2, 2.0)]
    assert len([r for r in M.metric_records(spark, str(log.out)).collect() if r.run == "d"]) == 2


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        M.track_metrics(spark.createDataFrame([], "run string, metric string, step long, ts timestamp, value double"), {"loss": "least"})


def test_runs_share_keys_but_nothing_else(spark, tmp_path):
    draw = random.Random(13)
    log = Log(spark, tmp_path, lateness_seconds=60, keep_seconds=600, buckets=3)
    rows = [(f"r{i}", s, s, m, float(draw.randint(0, 9))) for i in range(40) for m in MODES for s in range(4)]
    draw.shuffle(rows)
    # Eighty runs and metrics have three keys.
    assert log.arrive(*rows, *rows[:50])[-1] == 3
    plain, _ = plain_history([(run, s, m, v) for run, s, _, m, v in rows])
    assert log.got(M.improvements, MODES) == plain
    assert log.got(M.metric_records) == sorted((run, m, s, v) for run, s, _, m, v in rows)
    # Only r0 and r1 go on; the states of the others end within their keys.
    log.arrive(("r0", 9, 500, "loss", -1.0), ("r1", 9, 500, "chrf", 50.0))
    log.arrive(("r2", 9, 700, "loss", -1.0))
    log.arrive(("r2", 10, 701, "loss", -2.0))
    log.arrive(("r0", 9, 702, "loss", -5.0), ("r0", 3, 702, "loss", -5.0), ("r3", 3, 702, "loss", -5.0))
    again = M._kind(spark, str(log.out), M.RECORD).groupBy("run", "metric", "step").count().where("count > 1").collect()
    assert [(r.run, r.metric, r.step) for r in again] == [("r3", "loss", 3)]
