"""Timers and state over many micro-batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import flows, stateful

ROWS = "fingerprint string, id long, ts timestamp, severity string"
BASE = dt.datetime(2024, 1, 1)
RULE = stateful.alert_lifecycle({"critical": 30, "warning": 120}, quiet=60)


def findings(spark, minutes):
    """(fingerprint, minute, severity) as rows."""
    return spark.createDataFrame([(f, i, BASE + dt.timedelta(minutes=m), s) for i, (f, m, s) in enumerate(minutes)], ROWS)


def lines(df):
    return sorted((r["fingerprint"], r["change"], *((r[c] - BASE).total_seconds() / 60 for c in ("ts", "raised"))) for r in df.collect())


def as_batch(df, until_minute):
    return lines(stateful.on_batch(df, RULE, until_minute and int((BASE + dt.timedelta(minutes=until_minute)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)))


def test_alerts_are_resolved_after_silence(spark):
    rows = [("a", 0, "critical"), ("a", 20, "critical"), ("a", 40, "critical"), ("a", 300, "critical"), ("b", 10, "warning"), ("b", 69, "warning"), ("b", 500, "warning")]
    df = findings(spark, rows)
    raised = [("a", "raised", 0, 0), ("a", "raised", 40, 40), ("a", "raised", 300, 300), ("b", "raised", 10, 10), ("b", "raised", 500, 500)]
    known = [("a", "resolved", 100, 0), ("a", "resolved", 100, 40), ("b", "resolved", 129, 10)]
    assert as_batch(df, None) == sorted(raised + known)
    assert as_batch(df, 490) == sorted([*raised, *known, ("a", "resolved", 360, 300)])
    assert as_batch(df, 361) == as_batch(df, 490) and as_batch(df, 360) == as_batch(df, None)


def test_silence_of_exactly_the_quiet_time_resolves_and_suppression_outlives_it(spark):
    df = findings(spark, [("a", 0, "warning"), ("a", 60, "warning"), ("a", 130, "warning")])
    # The second finding comes after the alert was resolved, but within its severity's two hours: no new alert.
    assert as_batch(df, None) == [("a", "raised", 0, 0), ("a", "raised", 130, 130), ("a", "resolved", 60, 0)]


def test_alerts_older_than_a_week_stay_open(spark):
    df = findings(spark, [("a", m, "warning") for m in range(0, 8 * 1440, 50)])
    out = as_batch(df, 20_000)
    last = max(range(0, 8 * 1440, 50)) + 60
    gone = [x for x in out if x[1] == "resolved"]
    assert {x[2] for x in gone} == {last} and all(last - x[3] < 7 * 1440 for x in gone)
    assert {x[3] for x in out if x[1] == "raised"} - {x[3] for x in gone} == {x[3] for x in out if x[1] == "raised" and last - x[3] >= 7 * 1440}


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_of_many_files_equals_its_batch_twin(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randrange(6)}", rng.randrange(5000), rng.choice(["critical", "warning"])) for _ in range(300)]
    df = findings(spark, rows)
    folder = flows.in_time_slices(df, "ts", 10)
    assert len(spark.read.parquet(folder).inputFiles()) == 10 and spark.read.parquet(folder).count() == 300
    stream = flows.from_files(spark, df, folder).withWatermark("ts", "5 minutes")
    got = lines(flows.run_to_end(stateful.on_stream(stream, RULE), "lifecycle"))
    assert got == as_batch(df, max(m for _, m, _ in rows) - 5)
    assert sum(x[1] == "resolved" for x in got) > 50


def test_slices_follow_time_and_keep_rows_without_one(spark):
    df = findings(spark, [("a", m, "x") for m in (5, 5, 5, 1, 9)]).union(spark.createDataFrame([("n", 9, None, "x")], ROWS))
    folder = flows.in_time_slices(df, "ts", 3)
    times = [r["n"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(times) == 6
    assert spark.read.schema(ROWS).parquet(flows.in_time_slices(df.limit(0), "ts", 3)).count() == 0


def test_a_silent_rule_needs_no_timer(spark):
    rule = stateful.debounce(900, 4, "fingerprint")
    assert rule.deadline is None
    df = findings(spark, [("a", 0, "x"), ("a", 10, "x"), ("a", 20, "x")]).withColumn("priority", F.lit(1))
    assert stateful.on_batch(df, rule, until=10**15).count() == 2
