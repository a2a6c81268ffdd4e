"""Findings about queues, the mood index, rejected pairs, hints and names: rules at their bounds."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import knowledge, monitor

NOW = dt.datetime(2024, 1, 20, 12)
JOBS = "job_type string, status string, updated_at timestamp, claimed_at timestamp, completed_at timestamp, last_error string"


def ago(minutes):
    return NOW - dt.timedelta(minutes=minutes)


def jobs(spark, rows):
    return spark.createDataFrame([(t, s, ago(m), ago(m), ago(m), e) for t, s, m, e in rows], JOBS)


def found(df):
    return {r["fingerprint"]: (r["severity"], round(r["value"], 4), r["note"]) for r in df.collect()}


@pytest.mark.parametrize(("failed", "done", "want"), [(1, 1, "warning"), (2, 1, "critical"), (1, 4, "warning"), (1, 5, None), (0, 0, None)])
def test_failure_rates(spark, failed, done, want):
    rows = [(f"t{i}", "failed", 5, None) for i in range(failed)] + [("t", "completed", 5, None)] * done + [("t", "failed", 61, None)] * 9 + [("t", "pending", 1, None)]
    out = found(monitor.job_failures(jobs(spark, rows), F.lit(NOW)))
    assert {k.rsplit("-", 1)[1] for k in out if k.startswith("job-failure-rate")} == ({want} if want else set())


def test_types_that_fail_often(spark):
    rows = [("a", "failed", 5 + i, f"e{i}") for i in range(10)] + [("b", "failed", 60, None), ("b", "failed", 59, None), ("b", "failed", 3, "x" * 300)] + [("c", "failed", 5, "e")] * 2 + [("d", "failed", 5, None)] * 3
    out = {k: v for k, v in found(monitor.job_failures(jobs(spark, rows), F.lit(NOW))).items() if "type" in k}
    assert out == {"job-type-failing-a": ("critical", 10.0, "e0"), "job-type-failing-b": ("warning", 3.0, "x" * 200), "job-type-failing-d": ("warning", 3.0, "unknown")}
    assert len(monitor.job_failures(jobs(spark, rows), F.lit(NOW), most=1).filter("fingerprint like '%type%'").collect()) == 1


@pytest.mark.parametrize(("pending", "stuck", "want"), [(200, 0, {}), (201, 0, {"queue-depth-warning": "warning"}), (501, 0, {"queue-depth-critical": "critical"}), (0, 1, {"stuck-jobs": "warning"}), (0, 5, {"stuck-jobs": "critical"})])
def test_depth_and_stuck_jobs(spark, pending, stuck, want):
    rows = [("p", "pending", 99, None)] * pending + [(f"s{i % 2}", "processing", 21, None) for i in range(stuck)] + [("ok", "processing", 20, None)]
    out = found(monitor.queue_depth(jobs(spark, rows), F.lit(NOW)))
    assert {k: v[0] for k, v in out.items()} == want and (stuck < 5 or out["stuck-jobs"][2] == "s0, s1")


def test_recency(spark):
    checks = spark.createDataFrame([("a", "A", 1.0, 2.0), ("b", "B", 1.0, 2.0), ("c", "C", 1.0, 2.0), ("d", "D", 1.0, 2.0)], "job_type string, label string, warn_hours double, critical_hours double")
    rows = [("a", "completed", 60, None), ("a", "completed", 600, None), ("b", "completed", 61, None), ("c", "completed", 121, None), ("d", "failed", 600, None), ("e", "completed", 600, None)]
    assert found(monitor.subsystem_recency(jobs(spark, rows), checks, F.lit(NOW))) == {"subsystem-stale-b": ("warning", 1.0167, "B"), "subsystem-stale-c": ("critical", 2.0167, "C")}


@pytest.mark.parametrize(("falls", "errors", "want"), [(2, 5, {}), (3, 6, {"model-fallback-warning": "warning", "model-errors-warning": "warning"}), (11, 0, {"model-fallback-critical": "critical"})])
def test_model_health(spark, falls, errors, want):
    rows = [(ago(5), True, None)] * falls + [(ago(5), False, "e")] * errors + [(ago(61), True, "e")] * 20
    out = found(monitor.model_health(spark.createDataFrame(rows, "at timestamp, fallback boolean, error string"), F.lit(NOW)))
    assert {k: v[0] for k, v in out.items()} == want


def test_an_empty_queue_finds_nothing(spark):
    none = spark.createDataFrame([], JOBS)
    usage = spark.createDataFrame([], "at timestamp, fallback boolean, error string")
    checks = spark.createDataFrame([], "job_type string, label string, warn_hours double, critical_hours double")
    assert monitor.findings(none, usage, checks, F.lit(NOW)).count() == 0


def test_mood_has_a_hat_for_the_calendar(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base, 4.0, None, 10.0)] + [(base + dt.timedelta(days=i), x, f, c) for i, (x, f, c) in enumerate([(4.0, None, 10.0), (2.0, None, None), (None, 0.25, None), (None, None, 20.0), (None, None, 2.0), (None, None, 40.0), (None, None, None)], 1)]
    out = [r["mood"] for r in monitor.mood_index(spark.createDataFrame(rows, "date date, x double, feel double, cal double"), ["x"], ["feel"], ["cal"]).orderBy("date").collect()]
    # The calendar's means: 10, 10, 10, 10, then 40/3 with 20 in it, then 42/4.
    assert out == [0.5, 1.0, 0.5, 0.25, 0.5, 0.3, 0.0, 0.5]


def test_rejected_pairs(spark):
    p = spark.createDataFrame([(1, "pending", 1, 2, ago(60 * 24 * 31)), (2, "pending", 0, 2, ago(60 * 24 * 31)), (3, "pending", 1, 2, ago(60 * 24 * 30)), (4, "accepted", 1, 2, ago(60 * 24 * 31)), (5, "pending", 2, 2, ago(60 * 24 * 31))], "id long, status string, confirmed long, exceptions long, discovered_at timestamp")
    assert {r["id"] for r in monitor.invalidated(p, F.lit(NOW)).filter("status = 'rejected'").collect()} == {1}


@pytest.mark.parametrize(
    ("key", "person", "place"),
    [
        ("jane_smith_career", "Jane Smith", "Jane Smith Career"), ("JANE", "Jane", "Jane"), ("bob_12", "Bob", "Bob 12"), ("a_smith_age", None, "A Smith Age"), ("new_york_trips", "New York Trips", "New York"), ("one_two_three_four_five", None, None), ("_", None, None), (None, None, None),
        ("bob_age_age", "Bob Age", "Bob Age Age"), ("x2_y_home", None, "X2 Y"),
    ],
)
def test_names_in_keys(spark, key, person, place):
    df = spark.createDataFrame([(key,)], "key string").select(knowledge.person_of_key(F.col("key")).alias("person"), knowledge.place_of_key(F.col("key")).alias("place"))
    assert tuple(df.first()) == (person, place)


def test_hints(spark):
    facts = [(1, "people", "ann_age", "Ann  Lee met bob ross"), (2, "communication", "zoe_role", "nobody"), (3, "places", "new_york_trips", "Bob Ross"), (4, "health", "x", None), (5, "people", "ann_lee", None), (6, "misc", "ann_age", "Bob Ross"), (7, "people", "x1", "ANN LEE and Bob Ross"), (8, "events", "party_home", "y")]
    contacts = [(20, "Ann Lee"), (21, "Ann"), (22, "Bob Ross"), (10, "Anna Lee")]
    out = sorted((r["fact_id"], r["name"], r["type"], r["role"], r["contact_id"]) for r in knowledge.hints(spark.createDataFrame(facts, "fact_id long, domain string, key string, value string"), spark.createDataFrame(contacts, "contact_id long, name string")).collect())
    assert out == sorted([
        (1, "Ann Lee", "person", "subject", 20), (1, "Bob Ross", "person", "object", 22), (2, "Zoe", "person", "subject", None), (3, "New York", "place", "location", None), (4, "Health & Fitness", "topic", "topic", None),
        (5, "Ann Lee", "person", "subject", 20), (7, "Ann Lee", "person", "object", 20), (7, "Ann", "person", "object", 21), (7, "Bob Ross", "person", "object", 22), (8, "Party", "place", "location", None), (8, "Life Events", "topic", "topic", None),
    ])


def test_names_become_complete_in_order(spark):
    e = spark.createDataFrame([(1, "Jane"), (2, "Jane Smith"), (3, "Al"), (4, None)], "entity_id long, name string")
    s = [(1, 1, 1, "jane  SMITH"), (1, 2, 2, "Jane Smith Lee"), (1, 3, 3, "Jane X Smith Lee"), (2, 1, 1, "Jane"), (2, 2, 2, "Smith Jane Lee"), (9, 1, 1, "Other One"), (1, 0, 0, "Mary Jane"), (4, 1, 1, "New Name"), (3, 1, 1, None)]
    out = {r["entity_id"]: r["name"] for r in knowledge.complete_names(e, spark.createDataFrame(s, "entity_id long, at long, id long, name string")).collect()}
    assert out == {1: "Mary Jane", 2: "Jane Smith", 3: "Al", 4: "New Name"}
