"""The log of runs: steps, endings, and what a killed or repeated write leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.sources import run_log as L

AT = dt.datetime(2026, 1, 1)
RUN = "run_id int, started_at timestamp, finished_at timestamp, status string, decision string, total_cost_usd double, total_latency_ms long"
STEP = "run_id int, step_index long, component string, decision_type string, cost_usd double, latency_s double, error string, created_at timestamp"


def test_steps_go_on_behind_those_stored(spark):
    steps = spark.createDataFrame([(1, 20, "b"), (1, 10, "a"), (2, 5, "c")], "run_id int, place int, decision_type string")
    stored = spark.createDataFrame([(1, 1), (1, 4)], "run_id int, step_index int")
    got = lambda *a: sorted((r.run_id, r.step_index, r.decision_type) for r in L.numbered(*a).collect())
    assert got(steps) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    assert got(steps, stored) == [(1, 5, "a"), (1, 6, "b"), (2, 1, "c")]


def test_runs_close_once_with_totals_and_their_error(spark):
    runs = spark.createDataFrame([(1, AT, None, "running", None, None, None), (2, AT, AT, "completed", "old", 9.0, 9), (3, AT, None, "running", None, None, None), (4, AT, None, "running", None, None, None), (5, AT, None, "running", None, None, None)], RUN)
    steps = spark.createDataFrame([(1, 1, "probe", "x", 0.5, 0.0125, None, AT), (1, 2, "model", "x", None, 1.0, None, AT), (3, 1, "probe", "x", 1.0, None, None, AT)], STEP)
    ends = spark.createDataFrame([(1, "completed", "wait", None), (1, "completed", "wait", None), (2, "failed", None, "late"), (3, "failed", None, "boom"), (4, "stopped", "skip", None)], "run_id int, status string, decision string, error string")
    out, log = L.closed(runs, steps, ends)
    got = {r.run_id: (r.finished_at, r.status, r.decision, r.total_cost_usd, r.total_latency_ms) for r in out.collect()}
    assert got == {1: (AT, "completed", "wait", 0.5, 1012), 2: (AT, "completed", "old", 9.0, 9), 3: (AT, "failed", None, 1.0, 0), 4: (AT, "stopped", "skip", 0.0, 0), 5: (None, "running", None, None, None)}
    assert [(r.run_id, r.step_index, r.component, r.error) for r in log.filter(F.col("decision_type") == "run_failed").collect()] == [(3, 2, "controller", "boom")]
    assert log.count() == 4
    again, log = L.closed(out, log, ends.filter("run_id <> 1"))
    assert sorted(again.collect(), key=str) == sorted(out.collect(), key=str) and log.count() == 4


def test_killed_and_repeated_writes_leave_one_copy(spark, tmp_path):
    root = str(tmp_path / "log")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "run_id int")
    seen = lambda name="run": sorted((r.batch, r.run_id) for r in L.published(spark, root, name, "run_id int").collect())
    assert seen() == []
    L.publish({"run": rows(1, 2), "step": rows(1, 1, 2)}, root, "a", "first")
    L.publish({"run": rows(7)}, root, "b")
    rows(1, 2, 3).write.parquet(f"{root}/run/batch=a/attempt=killed")  # it wrote one table and was killed
    assert seen() == [("a", 1), ("a", 2), ("b", 7)] and seen("step") == [("a", 1), ("a", 1), ("a", 2)]
    L.publish({"run": rows(1, 4), "step": rows(4)}, root, "a")
    assert seen() == [("a", 1), ("a", 4), ("b", 7)] and seen("step") == [("a", 4)]
    with pytest.raises(Exception):  # noqa: B017, PT011
        L.publish({"run": rows(9), "step": rows(1).withColumn("x", F.raise_error(F.lit("executor lost")))}, root, "b")
    assert seen() == [("a", 1), ("a", 4), ("b", 7)]
    L.publish({"run": rows(1, 4)}, root, "a", "first")  # an attempt written anew under its name
    assert seen() == [("a", 1), ("a", 4), ("b", 7)]
