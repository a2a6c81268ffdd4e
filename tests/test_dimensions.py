"""Dimensions of a day: small cases of what the tables don't show."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.operators import dimensions

AT = lambda d, h=0, m=0: dt.datetime(2024, 1, d, h, m)


def metrics(df, keep=None):
    out = {}
    for r in df.collect():
        out.setdefault(r["date"].day, {})[r["metric"]] = r["value"]
    return {d: {k: v for k, v in m.items() if keep is None or k in keep} for d, m in out.items()}


def test_registry_names_sixteen_dimensions():
    assert len(dimensions.REGISTRY) == 16 and all(d.needs for d in dimensions.REGISTRY.values())


def test_health_folds_by_kind_and_leaves_zeros_out(spark):
    rows = [(AT(1), "steps", 10.0), (AT(1, 5), "steps", 5.0), (AT(1), "weight", 80.0), (AT(1, 9), "weight", 82.0), (AT(1), "sleep", 0.0), (AT(1), "heart_rate", 60.0), (AT(2), "heart_rate", 60.0), (AT(2), "heart_rate_avg", 70.0), (AT(2), "workout_run", 30.4), (AT(2), "workout_swim", 10.1), (AT(3), "unknown", 3.0), (None, "steps", 9.0)]
    out = metrics(dimensions.one("health", {"health": spark.createDataFrame(rows, "ts timestamp, kind string, value double")}))
    assert out == {1: {"steps": 15.0, "weight": 81.0, "avg_heart_rate": 60.0}, 2: {"avg_heart_rate": 70.0, "workout_count": 2.0, "workout_duration_minutes": 41.0}}


def test_communication_counts_days_of_any_source(spark):
    m = [(AT(1, 1), "received", "a", "sms", 4, None), (AT(1, 1, 1), "sent", "a", "sms", 6, 7), (AT(1, 2), "received", "b", "mail", None, None), (AT(1, 23, 59), "received", "a", "sms", 2, None), (AT(2, 0, 1), "sent", "a", "sms", 2, None), (AT(2, 3), "received", None, "sms", 2, None)]
    c = [(AT(3), "phone", "inbound", 5.0, "x"), (AT(3), "voicemail", None, None, None)]
    s = {"messages": spark.createDataFrame(m, "ts timestamp, direction string, contact string, channel string, length int, thread int"), "calls": spark.createDataFrame(c, "ts timestamp, channel string, direction string, seconds double, contact string")}
    out = metrics(dimensions.one("communication", s, channels={"mails": "mail"}))
    # An answer on the next day isn't one of this day, nor is one without a contact.
    assert out[1]["avg_response_seconds"] == 60 and out[2]["avg_response_seconds"] == 0 and out[1]["mails"] == 1 and out[1]["threaded_messages"] == 1
    assert out[3] | {"total_messages": 0.0} == out[3] and (out[3]["total_calls"], out[3]["calls_inbound"], out[3]["call_contacts"], out[3]["voicemails"]) == (2, 1, 1, 1)
    assert "video_calls" not in out[1] and out[1]["avg_message_length"] == 4.0


def test_location_leaves_jumps_out(spark):
    rows = [(1, AT(1, 1), "home", "gps", 0.0, 0.0), (2, AT(1, 2), None, "gps", 0.0, 1.0), (3, AT(1, 3), None, "wifi", 5.0, 1.0), (4, AT(1, 4), None, "gps", None, None), (5, AT(2), "home", "gps", 5.0, 2.0)]
    out = metrics(dimensions.one("location", {"locations": spark.createDataFrame(rows, "id long, ts timestamp, place string, source string, lat double, lon double")}))
    assert out == {1: {"location_points": 4, "unique_places": 1, "sources": 2, "total_distance_km": 111.2}, 2: {"location_points": 1, "unique_places": 1, "sources": 1, "total_distance_km": 0}}


def test_schedule(spark):
    c = [(1, AT(1, 9), AT(1, 10), False, "work", 2), (2, AT(1, 10, 15), AT(1, 11), False, "work", None), (3, AT(1, 11, 16), None, False, "home", 4), (4, AT(1), AT(2), True, "home", 0)]
    r = [(AT(1), AT(1, 5), True), (AT(1), AT(2), True), (AT(3), None, False), (None, None, False)]
    s = {"calendar": spark.createDataFrame(c, "id long, begins timestamp, ends timestamp, all_day boolean, calendar string, attendees int"), "reminders": spark.createDataFrame(r, "due timestamp, completed_at timestamp, completed boolean")}
    out = metrics(dimensions.one("schedule", s))
    assert out[1] == {"events": 4, "work_hours_events": 3, "all_day_events": 1, "calendars_used": 2, "total_meeting_hours": 1.8, "avg_attendees": 1.5, "free_hours": 7.3, "back_to_back_count": 1, "reminder_count": 2, "reminders_completed": 2}
    assert out[3]["free_hours"] == 9 and out[3]["reminder_count"] == 1 and out[2]["reminders_completed"] == 1 and set(out) == {1, 2, 3}


def test_days_that_tell_nothing_have_no_row(spark):
    social = spark.createDataFrame([(AT(1), "instagram", "follower"), (AT(2), "facebook", "post")], "ts timestamp, network string, kind string")
    assert set(metrics(dimensions.one("social_media", {"social": social}))) == {2}
    followers = {"posts": ("facebook", "post"), "followers": ("instagram", "follower")}
    assert set(metrics(dimensions.one("social_media", {"social": social}, kinds=followers))) == {1, 2}
    assert set(metrics(dimensions.one("social_media", {"social": social}, kinds=followers, tells=["followers"]))) == {1}
    records = spark.createDataFrame([(AT(1), "message", None), (AT(2), "model_call", 2.5)], "ts timestamp, kind string, cost double")
    assert metrics(dimensions.one("meta", {"records": records}), ["model_cost_cents"]) == {2: {"model_cost_cents": 2.5}}


def test_fitness_joins_rings_of_a_day(spark):
    s = {"workouts": spark.createDataFrame([(AT(1),)], "ts timestamp"), "rings": spark.createDataFrame([(dt.date(2024, 1, 1), 5.0), (dt.date(2024, 1, 2), None), (dt.date(2024, 1, 2), None)], "date date, energy double")}
    assert metrics(dimensions.one("fitness", s)) == {1: {"health_workouts": 1, "ring_energy": 5.0}, 2: {"health_workouts": 0}}


def test_signature_takes_the_sources_that_are_there(spark):
    s = {"motion": spark.createDataFrame([(AT(1), True, None, None, None, False), (AT(1), False, True, False, False, False)], "ts timestamp, stationary boolean, walking boolean, running boolean, automotive boolean, cycling boolean"), "moments": spark.createDataFrame([(AT(1),)], "ts timestamp")}
    out = dimensions.signature(s).collect()
    assert {r["dimension"] for r in out} == {"motion"} and {r["metric"]: r["value"] for r in out}["stationary_pct"] == 50.0


def test_several_people(spark):
    rows = [("x", AT(1, 7), "A", 1, "g", 1000.0), ("x", AT(1, 8), "A", 2, "g", 400.0), ("y", AT(1, 23), "B", 1, None, None)]
    plays = spark.createDataFrame(rows, "person string, ts timestamp, artist string, album int, genre string, ms double")
    out = {(r["person"], r["metric"]): r["value"] for r in dimensions.one("music", {"plays": plays}, by=["person"]).collect()}
    assert (out["x", "tracks_played"], out["x", "unique_artists"], out["x", "total_duration_seconds"], out["y", "listen_night"], out["y", "unique_genres"]) == (2, 1, 1, 1, 0)
    contacts = dimensions.ranked_context(plays, "ts", "artist", F.sum("ms"), 1, ["person"])
    assert {r["person"]: r["items"] for r in contacts.collect()} == {"x": ["A:1400"], "y": ["B"]}


@pytest.mark.parametrize("name", ["music", "voice", "digital_activity", "photos", "weather"])
def test_empty_sources(spark, name):
    ddl = {"plays": "ts timestamp, artist string, album string, genre string, ms double", "recordings": "ts timestamp, words long, seconds double, speakers array<string>", "apps": "ts timestamp, app string, seconds double, stream string", "photos": "photo_id long, ts timestamp, lat double, description string, album string", "weather": "date date, high double, low double, rain double, humidity double"}
    s = {n: spark.createDataFrame([], d) for n, d in ddl.items()}
    assert dimensions.one(name, s).count() == 0
