"""Hand-made cases of the rules that the tables don't show."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import classify, identifiers, similarity, stats
from tidewater.operators import baselines, chapters, joins, network, resolve, statistics, vectors, windows
from tidewater.session import ensure_checkpoint_dir
from tidewater.sql import read_only
from tidewater.sources import files, normalise, sinks
from tidewater.streaming import flows, stateful


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "last10", "national", "e164", "key"),
    [
        ("+15551234567", "5551234567", "5551234567", "+15551234567", "+15551234567"), ("(555) 123-4567", "5551234567", "5551234567", "+15551234567", "+15551234567"),
        ("1-555-123-4567", "5551234567", "5551234567", "+15551234567", "+15551234567"), ("chat123", None, "123", "chat123", "chat123"), ("12345", None, "12345", "12345", "12345"),
        ("a@B.c", None, "", "a@b.c", "a@b.c"), ("N <A@b.c>", None, "", "n <a@b.c>", "a@b.c"),
    ],
)
def test_the_four_phone_rules_differ(spark, raw, last10, national, e164, key):
    c = F.col("c")
    assert [one(spark, f(c), c=raw) for f in (identifiers.phone_last10, identifiers.phone_national, identifiers.phone_e164, identifiers.identifier)] == [last10, national, e164, key]


@pytest.mark.parametrize(("a", "b", "sim"), [("Ann Lee", "ann  lee", 1.0), ("Ann M Lee", "Ann Lee", 0.95), ("Bob Lee", "Ann Lee", 0.45), ("Ann", "Ann Lee", 0.7), ("nn Lee", "Ann Leeds x", 0.65)])
def test_name_rules(spark, a, b, sim):
    x, y = F.col("a"), F.col("b")
    assert one(spark, similarity.name_similarity(x, y), a=a, b=b) == pytest.approx(sim)
    assert one(spark, similarity.name_similarity(y, x), a=a, b=b) == pytest.approx(sim)


def test_similarities_are_symmetric_and_bounded(spark):
    names = ["ann lee", "anne lee", "bob", "", "x", "lee ann", "ann-marie o'neill"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for f in (similarity.name_similarity, similarity.edit_similarity, similarity.trigram_similarity, similarity.dice):
        out = df.select("a", "b", f(F.col("a"), F.col("b")).alias("s"), f(F.col("b"), F.col("a")).alias("t")).collect()
        assert all(0 <= r["s"] <= 1 and r["s"] == pytest.approx(r["t"]) for r in out)


def test_identifiers_are_idempotent(spark):
    raw = ["+1 555 123 4567", "Name <A@B.co>", "(555) 123-4567", "X y", "+44 20 7946 0958"]
    df = spark.createDataFrame([(r,) for r in raw], "c string")
    k = identifiers.identifier(F.col("c"))
    once = df.select(k.alias("c"))
    assert [r[0] for r in once.collect()] == [r[0] for r in once.select(identifiers.identifier(F.col("c"))).collect()]


def test_recipients_and_partial_dates(spark):
    c = F.col("c")
    assert one(spark, identifiers.recipient(c), c='"Lee, Ann"') == "Ann Lee" and one(spark, identifiers.recipient(c), c="A@B.c") == "a@b.c"
    assert one(spark, identifiers.partial_date(c), c="1999") == dt.date(1999, 1, 1) and one(spark, identifiers.partial_date(c), c="1999-05") == dt.date(1999, 5, 1) and one(spark, identifiers.partial_date(c), c="soon") is None


@pytest.mark.parametrize(("z", "level"), [(1.99, None), (2.0, "low"), (-2.5, "medium"), (3.0, "high"), (-4.0, "critical")])
def test_severity_bounds_are_inclusive_and_ignore_the_sign(spark, z, level):
    assert one(spark, baselines.severity(F.col("z")), z=z) == level


def test_roundings(spark):
    v = F.col("v")
    assert one(spark, stats.js_round(v), v=-2.5) == -2 and one(spark, stats.js_round(v), v=2.5) == 3 and one(spark, F.round(v), v=-2.5) == -3


def test_normal_distribution(spark):
    assert one(spark, stats.normal_cdf(F.col("z")), z=1.959964) == pytest.approx(0.975, abs=1e-6) and one(spark, stats.normal_cdf(F.col("z")), z=-1.0) == pytest.approx(0.158655, abs=1e-6)


def test_iso_weeks(spark):
    d = spark.createDataFrame([(dt.date(2015, 1, 4) + dt.timedelta(days=i),) for i in range(0, 4000, 13)], "d date")
    out = d.select("d", stats.iso_week(F.col("d")).alias("k")).withColumn("m", stats.iso_week_monday(F.col("k"))).collect()
    assert all(r["k"] == "{}-W{:02d}".format(*r["d"].isocalendar()[:2]) and r["m"] == r["d"] - dt.timedelta(days=r["d"].weekday()) for r in out)


def test_constant_series_have_no_correlation_and_no_trend(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), m, v) for i in range(20) for m, v in (("a", 1.0), ("b", float(i)))]
    s = spark.createDataFrame(days, "date date, metric string, value double")
    r = statistics.pearson_pairs(s).first()
    assert r["r"] == 0 and r["n"] == 20
    t = {x["metric"]: x for x in statistics.trends(s, F.lit("2024-01-20").cast("date"), 30, 14, 0.0).collect()}
    assert t["a"]["slope"] == 0 and t["a"]["r2"] == 0 and t["b"]["slope"] == pytest.approx(1) and t["b"]["r2"] == pytest.approx(1)


def test_session_gap_boundary(spark):
    base = dt.datetime(2024, 1, 1)
    for gap, n in ((1799, 1), (1800, 1), (1801, 0)):
        df = spark.createDataFrame([(1, base, 1), (1, base + dt.timedelta(seconds=gap), 2)], "u long, ts timestamp, id long")
        assert windows.session_rows(df, "u", ["ts", "id"]).count() == n


def test_streaks(spark):
    days = spark.createDataFrame([("u", dt.date(2024, 1, d)) for d in (1, 2, 3, 3, 5)], "u string, d date")
    assert [tuple(r) for r in windows.streaks(days, ["u"], "d").collect()] == [("u", dt.date(2024, 1, 1), dt.date(2024, 1, 3), 3)]


@pytest.mark.parametrize(("n", "chunks"), [(10, 1), (50, 1), (51, 2), (90, 2), (130, 3)])
def test_chunks_stop_at_the_end(spark, n, chunks):
    out = windows.chunks(spark.range(n).selectExpr("1 as c", "id as i"), "c", "i").groupBy("chunk").agg(F.count("*").alias("n"), F.max("i").alias("hi")).collect()
    assert len(out) == chunks and max(r["n"] for r in out) <= 50 and max(r["hi"] for r in out) == n - 1


def test_anchored_groups_do_not_chain(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=d)) for d in (0, 10, 14, 15, 29, 30)], "k string, d date")
    assert sorted((r["d"].day, r["group"]) for r in windows.anchored_groups(df, "k", "d", 14).collect() if r["d"].month == 1) == [(1, 1), (11, 1), (15, 1), (16, 2), (30, 2), (31, 3)]


def test_two_triangles_and_a_bridge(spark):
    ensure_checkpoint_dir(spark)
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (1, 3, 5), (11, 12, 5), (12, 13, 5), (11, 13, 5), (3, 11, 1)], "a long, b long, w long")
    c = network.label_propagation(edges)
    by = {r["node"]: r["community"] for r in c.collect()}
    assert len({by[i] for i in (1, 2, 3)}) == 1 and len({by[i] for i in (11, 12, 13)}) == 1 and by[1] != by[11]
    assert sorted(r["node"] for r in network.bridges(edges, c).collect()) == [3, 11]


def test_fact_fold(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", 0.5, "s1"), ("a", 0.4, "s2"), ("b", 0.4, "s3"), ("b", 0.5, "s1"), ("b", 0.9, "s4"), ("c", 0.1, "s5")]
    df = spark.createDataFrame([(1, "k", v, c, at + dt.timedelta(minutes=i), i, s) for i, (v, c, s) in enumerate(rows)], "entity long, key string, value string, confidence double, at timestamp, id long, source string")
    assert tuple(resolve.fold_facts(df).first()) == (1, "k", "b", 0.9, 3, "s1,s4", 1)


def test_proximity_join_equals_all_pairs(spark):
    import random

    rng, base = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), base + dt.timedelta(seconds=rng.randrange(4000))) for _ in range(120)]
    got = sorted((r["a"], r["b"]) for r in joins.near_in_time(spark.createDataFrame(rows, "p long, ts timestamp"), "p", "ts", 300).collect())
    want = sorted((min(a, b), max(a, b)) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if a != b and abs((s - t).total_seconds()) <= 300)
    assert got == want


def test_similar_names_lose_no_pair(spark):
    names = ["annabel lee", "annabel leigh", "anabel lee", "robert smith", "roberta smith", "bob", "rob smith", "lee annabel"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r["name"], r["other"]) for r in joins.similar_names(df, "name", 0.5).collect()}
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string")
    want = {(r["a"], r["b"]) for r in pairs.filter(similarity.trigram_similarity(F.col("a"), F.col("b")) > 0.5).collect()}
    assert got == want and want


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], round(r["similarity"], 4)) for r in vectors.search(v, [2.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.7071)]
    s = vectors.min_max(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in s] == [(0.0, 0.0), (1.0, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": {"k": 1}, "items": [{"id": 1, "t": "x"}, {"id": 2}]}')
    (tmp_path / "b.json").write_text('[{"id": 3, "t": "y"}]')
    (tmp_path / "c.tsv").write_text('id\tname\n1\t"A b"\n2\t\n')
    (tmp_path / "m.mbox").write_text("From a@b Mon\nFrom: A <a@b.c>\nTo: x@y.z\nSubject: =?utf-8?q?H=C3=A9?=\nMessage-ID: <1>\n\nbody one\n\nFrom c@d Tue\nFrom: c@d.e\nSubject: spam\nX-Gmail-Labels: Spam\nMessage-ID: <2>\n\nbuy\n")
    got = [tuple(r) for p in ("a", "b") for r in files.json_documents(spark, f"{tmp_path}/{p}.json", "id long, t string").collect()]
    assert got == [(1, "x"), (2, None), (3, "y")]
    assert [tuple(r) for r in files.delimited(spark, f"{tmp_path}/c.tsv", "id string, name string", "\t").collect()] == [("1", "A b"), ("2", "")]
    mail = {r["message_id"]: r for r in files.mail_box(spark, f"{tmp_path}/m.mbox").collect()}
    assert mail["<1>"]["subject"] == "Hé" and mail["<1>"]["body"] == "body one" and mail["<2>"]["skipped"] == "spam"
    import zipfile

    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.txt", "hello")
    assert [(r["member"], bytes(r["content"])) for r in files.archive_members(spark, f"{tmp_path}/z.zip").collect()] == [("in/a.txt", b"hello")]
    assert one(spark, files.file_kind(F.col("p")), p="x/Y.TGZ") == "archive" and one(spark, files.health_value(F.col("p")), p='{"unit": "m", "qty": "3.5"}') == 3.5 and one(spark, files.health_value(F.col("p")), p="72") == 72


def test_normalisers_share_the_canonical_record(spark):
    mail = spark.createDataFrame([("1", "m1", None, "a@b.c", ["x@y.z"], None, dt.datetime(2024, 1, 1), None, "snip"), ("2", "m2", "News", "newsletter@shop.com", None, None, dt.datetime(2024, 1, 1), "b", None)], "id string, message_id string, subject string, sender string, recipients array<string>, date timestamp, received_at timestamp, body string, snippet string")
    photo = spark.createDataFrame([("p", dt.datetime(2024, 1, 1), ["_UNKNOWN_1", "Ann"], "Rome", None)], "id string, taken_at timestamp, persons array<string>, place string, description string")
    event = spark.createDataFrame([("e", None, None, ("2024-01-02T10:00:00Z", None), ("2024-01-02T11:00:00Z", None), None, [("a@b.c", None), ("d@e.f", "Dee")])], "id string, summary string, description string, start struct<dateTime:string,date:string>, end struct<dateTime:string,date:string>, location string, attendees array<struct<email:string,displayName:string>>")
    out = {r["source_key"]: r for r in normalise.ingest({"email": mail, "photo": photo, "calendar": event}).collect()}
    assert len(out) == 3 and tuple(normalise.COLUMNS) == tuple(out["email"].asDict())
    assert out["email"]["summary"] == "(no subject)" and out["email"]["content"] == "snip" and [e["name"] for e in out["photo"]["entities"]] == ["Ann"] and out["photo"]["summary"] == "Photo with Ann at Rome"
    assert [e["name"] for e in out["calendar"]["entities"]] == ["a@b.c", "Dee"] and out["calendar"]["timestamp"] == dt.datetime(2024, 1, 2, 10)


def test_annotation_schema(spark):
    rows = [("k", "note", dt.datetime(2024, 1, 1), 10.0, 20.0, None, ["t"]), ("k", "", dt.datetime(2024, 1, 1), None, None, None, None), ("k", "n", None, None, None, None, None), ("k", "n", dt.datetime(2024, 1, 1), 91.0, 0.0, None, None)]
    df = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1), r) for i, r in enumerate(rows)], "id string, produced_at timestamp, payload struct<kind:string,note_text:string,recorded_at:timestamp,latitude:double,longitude:double,place_label:string,tags:array<string>>")
    assert [r[0] for r in df.select(normalise.valid_annotation(F.col("payload"))).collect()] == [True, False, False, False]
    assert normalise.ingest({"annotation": df}).count() == 4


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, version long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9)], "k long, v string, version long")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 9)]
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"], do_nothing=True).collect())) == [(1, "a", 1), (2, "b", 1), (3, "c", 9)]
    assert sorted(map(tuple, sinks.coalescing_upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 9)]
    hist = sinks.versioned_upsert(old.withColumn("superseded_by", F.lit(None).cast("long")), new, ["k"])
    assert sorted(map(tuple, hist.collect()), key=str) == sorted([(1, "a", 1, None), (2, "b", 1, 2), (2, None, 2, None), (3, "c", 1, None)], key=str)


def test_delivery_windows_and_thresholds(spark):
    t = F.col("t")
    assert one(spark, classify.delivery_window(t), t="Your package comes between 2 pm and 4 pm") == "between 2 pm and 4 pm" and one(spark, classify.delivery_window(t), t="Delivery BY 5PM") == "BY 5PM" and one(spark, classify.delivery_window(t), t="lunch 1-2 pm") is None
    assert one(spark, classify.threshold(t, {"a": 0.9}, 0.5), t="b") == 0.5


def health_rows(n=60):
    base = dt.datetime(2024, 1, 1)
    return [(f"k{i % 3}", i, base + dt.timedelta(minutes=7 * i), i % 5 != 0 and i % 7 != 0, i % 11 == 0, "error" if i % 2 else "warn", i % 5) for i in range(n)]


@pytest.mark.parametrize(
    "rule", [stateful.suppression({"error": 30, "warn": 120}, "service"), stateful.debounce(900, 4, "service"), stateful.promotion(key="service"), stateful.health_states(2, 20)], ids=["suppression", "debounce", "promotion", "health"]
)
def test_streams_equal_their_batch_twins(spark, tmp_path, rule):
    df = spark.createDataFrame(health_rows(), "service string, id long, ts timestamp, ok boolean, muted boolean, severity string, priority long")
    for k in range(4):  # four files, so four batches with state between them
        df.filter((F.col("id") >= 15 * k) & (F.col("id") < 15 * k + 15)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = flows.run_to_end(stateful.on_stream(flows.from_files(spark, df, f"{tmp_path}/in"), rule), "twin")
    want = stateful.on_batch(df, rule)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_health_rule():
    rule = stateful.health_states(2, 60)
    base, state, seen = pd.Timestamp("2024-01-01"), rule.start, []
    row = __import__("collections").namedtuple("row", "service ts ok muted")
    for minute, ok in ((0, True), (5, False), (10, False), (75, False), (80, True), (85, False), (90, True)):
        state, out = rule.step(state, row("s", base + pd.Timedelta(minutes=minute), ok, False))
        seen += [(minute, o[2], o[3]) for o in out]
    assert seen == [(10, "down", 0), (75, "still_down", 4200), (80, "recovered", 4500)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4000), min_size=1, max_size=12))
def test_suppression_spaces_what_passes(minutes):
    rule = stateful.suppression({"error": 30}, "service")
    row = __import__("collections").namedtuple("row", "service ts severity")
    base, state, passed = pd.Timestamp("2024-01-01"), rule.start, []
    for m in sorted(minutes):
        state, out = rule.step(state, row("s", base + pd.Timedelta(minutes=m), "error"))
        passed += [m] * len(out)
    assert passed[0] == min(minutes) and all(b - a >= 30 for a, b in zip(passed, passed[1:])) and all(any(0 <= m - p < 30 for p in passed) for m in minutes)


def test_chapter_types_and_bounds(spark):
    d = dt.date
    points = [("health/steps", d(2024, 1, 1), 3.0), ("photos/n", d(2024, 1, 15), -2.0), ("health/sleep", d(2024, 1, 16), -2.0), ("communication/n", d(2024, 2, 12), 2.5), ("motion/a", d(2024, 4, 1), -2.0), ("motion/b", d(2024, 4, 8), -2.0)]
    df = spark.createDataFrame([(m, w, 1.0, 2.0, z) for m, w, z in points], "metric string, week date, old double, new double, z double")
    out = chapters.chapters(df).orderBy("begins").collect()
    assert [(r["begins"], r["type"], r["shifts"]) for r in out] == [(d(2024, 1, 1), "health_focus", 2), (d(2024, 1, 16), "low_activity", 1), (d(2024, 2, 12), "social_expansion", 1), (d(2024, 4, 1), "transition", 2)]
    assert [r["ends"] for r in out] == [d(2024, 1, 16), d(2024, 2, 12), d(2024, 4, 1), None] and out[0]["confidence"] == 0.85


def test_read_only_sql(spark):
    spark.range(30).createOrReplaceTempView("numbers")
    assert read_only(spark, "select * from numbers;").count() == 20 and read_only(spark, " WITH x AS (SELECT 1 AS a) SELECT * FROM x").count() == 1
    for bad in ("drop table numbers", "select 1; select 2", "select * from secrets"):
        with pytest.raises(ValueError):
            read_only(spark, bad, ("secrets",))


def test_human_names(spark):
    names = {"Ann Lee": True, "Ann.Lee": True, "ann.lee": True, "Ann_lee": True, "Ann B. Lee": True, "ACME": False, "shop@x": False, "x": False}
    out = spark.createDataFrame([(n,) for n in names], "c string").select("c", classify.human_name(F.col("c")).alias("h")).collect()
    assert {r["c"]: r["h"] for r in out} == names
