"""Feedback on thresholds, branches that fail, relationship profiles and chapters of people: rules at their bounds."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators import fanin, feedback, markers, relationship

AT = dt.datetime(2024, 1, 20)


def ago(days, hours=0):
    return AT - dt.timedelta(days=days, hours=hours)


def ratings(spark, **keys):
    return spark.createDataFrame([(k, ago(1), r) for k, rs in keys.items() for r in rs], "key string, at timestamp, rating int")


@pytest.mark.parametrize(
    ("before", "said", "after"),
    [
        (0.7, [1, 1, -1, -1, -1], 0.75), (0.93, [-1] * 5, 0.95), (0.95, [-1] * 5, 0.95), (0.7, [1, 1, 1, 1, 1], 0.67), (0.41, [1] * 9, 0.4), (0.4, [1] * 9, 0.4), (0.3, [1] * 9, 0.3), (0.7, [1, 1, 1, 1, -1], 0.7), (0.7, [1, -1, 1, -1], 0.7),
        (0.7, [1, 1, -1, -1, 0], 0.7), (0.7, [0] * 6, 0.7), (0.7, [-1, None, None, None, None], 0.7), (None, [-1] * 5, 0.75), (0.5, [], 0.5),
    ],
)
def test_thresholds_move_within_bounds(spark, before, said, after):
    t = spark.createDataFrame([("k", before)] if before is not None else [], "key string, value double")
    out = feedback.adjust(t, ratings(spark, k=said), F.lit(AT)).collect()
    assert [round(r["value"], 9) for r in out] == [after]
    assert [r["direction"] for r in out] == ["raised" if after > (before or 0.7) else "lowered" if after < (before or 0.7) else None]


def test_old_ratings_and_those_to_come_do_not_count(spark):
    rows = [("k", ago(7), -1)] * 3 + [("k", ago(-1), -1)] * 3 + [("k", ago(6, 23), -1)] * 4
    f = spark.createDataFrame(rows, "key string, at timestamp, rating int")
    assert feedback.adjust(spark.createDataFrame([("k", 0.7)], "key string, value double"), f, F.lit(AT)).first()["value"] == 0.7


def test_runs_read_what_the_run_before_wrote(spark, tmp_path):
    path = f"{tmp_path}/thresholds"
    spark.createDataFrame([("k", 0.7), ("other", 0.5)], "key string, value double").write.parquet(path)
    seen = []
    for _ in range(7):
        out = {r["key"]: round(r["value"], 6) for r in feedback.run(spark, path, ratings(spark, k=[-1] * 5), F.lit(AT)).collect()}
        seen.append(out["k"])
        assert out["other"] == 0.5
    assert seen == [0.75, 0.8, 0.85, 0.9, 0.95, 0.95, 0.95]


def test_rejected_kinds_decay_faster(spark):
    p = spark.createDataFrame([(1, "a", True, 0.2), (2, "a", False, 0.2), (3, "b", True, 0.2), (4, "a", True, 0.95), (5, None, True, 0.2)], "id long, kind string, active boolean, decay double")
    i = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, "b")], "insight_id long, kind string")
    f = spark.createDataFrame([(10, ago(1), -1), (11, ago(30), -1), (12, ago(1), -1), (13, ago(31), -1), (13, ago(1), 1)], "insight_id long, at timestamp, rating int")
    out = {r["id"]: round(r["decay"], 9) for r in feedback.faster_decay(p, i, f, F.lit(AT)).collect()}
    assert out == {1: 0.3, 2: 0.2, 3: 0.2, 4: 1.0, 5: 0.2}


def test_escalations_look_at_the_latest_day(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 1), "d", "m", 4.0), (dt.date(2024, 1, 2), "d", "m", -2.5), (dt.date(2024, 1, 2), "d", "n", 2.4), (dt.date(2024, 1, 1), "d", "gone", 5.0), (dt.date(2024, 1, 3), "d", "m", None)], "date date, dimension string, metric string, z double")
    e = spark.createDataFrame([("d/m",), ("d/n",), ("d/gone",), ("x/y",)], "metric string")
    assert {r["metric"]: (r["current_z"], r["still"]) for r in feedback.recheck(e, s).collect()} == {"d/m": (-2.5, True), "d/n": (2.4, False), "d/gone": (0.0, False), "x/y": (0.0, False)}


# --- branches


def test_branches_fail_by_themselves(spark, tmp_path):
    spark.createDataFrame([(1, [1.0]), (2, None)], "id int, v array<float>").write.parquet(f"{tmp_path}/good")
    spark.createDataFrame([(3, "x")], "id int, v string").write.parquet(f"{tmp_path}/text")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken/part.parquet").write_bytes(b"PAR1 this is no table PAR1")
    read = lambda name: lambda: spark.read.parquet(f"{tmp_path}/{name}")
    cols = {"id": "id", "v": "v"}
    typed = lambda: spark.read.schema("id int, v array<float>").parquet(f"{tmp_path}/broken")
    branches = [fanin.Branch("a", read("good"), cols), fanin.Branch("b", read("none"), cols), fanin.Branch("c", read("text"), cols), fanin.Branch("d", read("good"), {"id": "id", "v": "w"}), fanin.Branch("e", read("good"), {"id": "id"}, "id = 2"), fanin.Branch("f", typed, cols), fanin.Branch("g", read("broken"), cols), fanin.Branch("h", read("good"), cols, "size(id) > 0")]
    g = fanin.gather(spark, branches, StructType.fromDDL("id bigint, v array<double>"), probe=True)
    assert {r["source"]: r["status"] for r in g.status.collect()} == {"a": "ok", "b": "missing", "c": "ill_typed", "d": "no_column", "e": "ok", "f": "unreadable", "g": "missing", "h": "ill_typed"}
    assert sorted((r["source"], r["id"], r["v"]) for r in g.rows.collect()) == [("a", 1, [1.0]), ("a", 2, None), ("e", 2, None)]
    assert g.rows.schema["id"].dataType.simpleString() == "bigint" and g.rows.schema["v"].dataType.simpleString() == "array<double>"


def test_no_branch_is_left(spark):
    g = fanin.gather(spark, [fanin.Branch("a", lambda: spark.read.parquet("/tmp/no/such/table"), {})], StructType.fromDDL("id bigint"))
    assert g.rows.columns == ["source", "id"] and g.rows.count() == 0 and g.status.first()["status"] == "missing"


def test_narrowing_is_no_silent_cast(spark):
    f = lambda ddl, want: fanin.gather(spark, [fanin.Branch("a", lambda: spark.createDataFrame([], f"x {ddl}"), {"x": "x"})], StructType.fromDDL(f"x {want}")).status.first()["status"]
    assert [f("int", "bigint"), f("bigint", "int"), f("date", "timestamp"), f("string", "date"), f("array<int>", "array<double>"), f("array<string>", "array<double>")] == ["ok", "ill_typed", "ok", "ill_typed", "ok", "ill_typed"]


def test_waiting_leaves_out_what_is_done(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "source string, source_id string")
    done = spark.createDataFrame([("a", "1"), ("a", "1"), ("c", "2")], "source string, source_id string")
    assert sorted(map(tuple, fanin.waiting(rows, done, ["source", "source_id"]).collect())) == [("a", "2"), ("b", "1")]


# --- relationships


def profile(spark, messages=(), calls=(), video=()):
    m = spark.createDataFrame(list(messages), "person long, ts timestamp, channel string, direction string, length int, thread string")
    c = spark.createDataFrame(list(calls), "person long, ts timestamp, channel string")
    v = spark.createDataFrame(list(video), "person long, ts timestamp")
    return {r["person"]: r for r in relationship.profiles(m, c, v, F.lit(AT.date())).collect()}


def said(person, n, channel, direction, days, length=100, thread="t"):
    return [(person, ago(days) + dt.timedelta(minutes=i), channel, direction, length, thread) for i in range(n)]


def test_tiers(spark):
    m = said(1, 50, "gmail", "sent", 1) + said(1, 50, "sms", "received", 2) + said(1, 30, "imessage", "received", 2)  # 10 a week on three channels
    m += said(2, 65, "sms", "sent", 1) + said(3, 13, "sms", "sent", 1) + said(3, 13, "gmail", "sent", 1) + said(4, 13, "sms", "sent", 1) + said(5, 3, "sms", "sent", 1) + said(6, 2, "sms", "sent", 1) + said(7, 130, "sms", "sent", 40) + said(8, 9, "sms", "sent", 91)
    out = profile(spark, m)
    assert {p: r["tier"] for p, r in out.items()} == {1: "inner_circle", 2: "close", 3: "close", 4: "regular", 5: "acquaintance", 6: "dormant", 7: "dormant"}
    assert (out[1]["type"], out[3]["type"], out[4]["type"], out[1]["reciprocity"], out[1]["primary_channel"]) == ("friend", "colleague", "unknown", 0.63, "gmail")
    assert out[1]["tier_confidence"] == pytest.approx(0.9) and out[6]["tier_confidence"] == pytest.approx(0.51) and out[7]["days_since"] == 40


def test_spoken_contact_alone(spark):
    out = profile(spark, calls=[(1, ago(3), "phone"), (1, ago(5), "plaud"), (2, ago(95), "phone")], video=[(1, ago(2))])
    r = out[1]
    assert set(out) == {1} and (r["interactions"], r["channels"], r["in_person"], r["trend"], r["type"], r["reciprocity"], r["contact_hours"], r["response_seconds"]) == (3, ["facetime", "plaud", "voice"], 1.0, "silent", "friend", 0.0, None, None)
    # 3/13 a week: .25 x .023; nobody writes; seen within a week .15; three channels .06; unknown answers .025; no bonus.
    assert r["health"] == 0.24 and r["depth"] == 0.0


def test_trends_compare_daily_rates(spark):
    m = said(1, 13, "sms", "sent", 5) + said(1, 20, "sms", "sent", 50) + said(2, 14, "sms", "sent", 5) + said(2, 20, "sms", "sent", 50) + said(3, 7, "sms", "sent", 5) + said(3, 21, "sms", "sent", 50) + said(4, 1, "sms", "sent", 5) + said(5, 4, "sms", "sent", 30)
    assert {p: r["trend"] for p, r in profile(spark, m).items()} == {1: "stable", 2: "increasing", 3: "decreasing", 4: "increasing", 5: "increasing"}


def test_answers_within_a_thread(spark):
    t = lambda s: ago(1) + dt.timedelta(seconds=s)
    m = [(1, t(0), "sms", "sent", 300, None), (1, t(3), "sms", "received", 300, None), (1, t(13), "sms", "sent", 300, None), (1, t(20), "gmail", "received", 500, None), (1, t(100), "gmail", "received", None, None), (1, t(131), "gmail", "sent", None, None)]
    r = profile(spark, m)[1]
    assert r["response_seconds"] == 21 and r["depth"] == 1.0  # 10 s and 31 s; 3 s is no answer


# --- chapters


def test_titles_hold_names_of_any_length(spark):
    t = spark.createDataFrame([("Ann and the SEA",), ("a b",), (None,), ("joannes",)], "title string")
    w = spark.createDataFrame([("ann",), ("A",), ("se",), ("",), (None,), ("sea ",), ("zzz",)], "word string")
    got = {(r["title"], r["word"]) for r in markers.held_in(t, "title", w, "word").collect()}
    titles, words = ["ann and the sea", "a b", "joannes"], ["ann", "a", "se", "sea ", "zzz"]
    assert got == {(x, y) for x in titles for y in words if y in x}


def test_chapters_by_member_or_title(spark):
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo"), (3, ""), (4, "Cy")], "person long, name string")
    rows = [(10, "Years with ANN", [2, 2], 5), (11, "Bob's shop", [1], 4), (12, None, [1, 9], 3), (13, "Quiet", None, 2), (14, "Annex", [1], 1)]
    out = markers.chapters_of(people, spark.createDataFrame(rows, "chapter_id long, title string, key_people array<long>, begins long"), ["begins"], 3)
    got = sorted((r["person"], r["place"], r["chapter_id"]) for r in out.collect())
    assert got == [(1, 1, 14), (1, 2, 12), (1, 3, 11), (2, 1, 11), (2, 2, 10)]
