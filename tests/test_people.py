"""Hand-made cases of identities, resolution, merges, folds, searches and life transitions, and brute force of what SQL leaves out."""

from __future__ import annotations

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import folds, joins, resolve, statistics, vectors
from tidewater.plans import graphs, statistical
from tidewater.sources import normalise, sinks

SF = "/root/testdata/sf0.001"


def test_identity_keys(spark):
    raw = [("(415) 555-0100", "+14155550100"), ("1 415.555.0100", "+14155550100"), ("A@B.co", "a@bco"), ("x", None), (None, None), ("han dle", "handle"), ("0155550100", "0155550100")]
    out = spark.createDataFrame(raw, "c string, want string").select("want", resolve.identity_key(F.col("c")).alias("k")).collect()
    assert all(r["k"] == r["want"] for r in out)


def test_identities(spark):
    links = spark.createDataFrame([(1, "chat", "a@bco"), (2, "mail", "a@bco"), (3, "mail", "c@dorg")], "identity_id long, platform string, key string")
    rows = [(10, "mail", "A@b.co", "Ann"), (11, "sms", "a@B.co", None), (12, "sms", "new@x.org", "New"), (13, "chat", "NEW@x.org", "Newer"), (14, "chat", "none@x.org", " "), (15, "mail", None, "Ann")]
    out = {r["record_id"]: (r["identity_id"], r["via"]) for r in resolve.identify(spark.createDataFrame(rows, "record_id long, platform string, identifier string, name string"), links).collect()}
    assert out == {10: (2, "platform"), 11: (1, "other"), 12: (-12, "new"), 13: (-12, "new"), 14: (None, None), 15: (None, None)}


def test_cascade_takes_the_first_stage(spark):
    e = spark.createDataFrame([(1, "Ann Lee", ["+1 555 123 4567", "Annie"], "k1", 9), (2, "Bob Stone", [], "k2", 5), (3, "Carl Moss", None, None, 1)], "entity_id long, name string, aliases array<string>, contact string, fact_count long")
    h = [(10, "Bob Stone", ["555-123-4567"], "k2"), (11, "Someone", [], "k2"), (12, "BOB STONE ", [], None), (13, "Someone", ["ANNIE"], None), (14, "Ann M Lee", None, None), (15, "Carl", [], None), (16, "Zyx Wvu", [], None), (17, None, None, None)]
    out = {r["record_id"]: (r["entity_id"], r["stage"], r["review_id"]) for r in resolve.cascade(spark.createDataFrame(h, "record_id long, name string, aliases array<string>, contact string"), e).collect()}
    assert out == {10: (1, "phone", None), 11: (2, "contact", None), 12: (2, "name", None), 13: (1, "alias", None), 14: (1, "fuzzy", None), 15: (None, "new", 3), 16: (None, "new", None), 17: (None, "new", None)}


def test_best_match_equals_all_pairs(spark):
    rng = random.Random(5)
    left, right = ([" ".join("".join(rng.choice("abcd") for _ in range(4)) for _ in range(2)) for _ in range(60)] for _ in range(2))
    a, b = spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "match string")
    got = {r["name"]: round(r["sim"], 9) for r in joins.best_match(a, b, 0.3).collect()}

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    sims = {x: max(len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for y in right) for x in left}
    assert got == {x: round(s, 9) for x, s in sims.items() if s > 0.3}


def test_folds_of_large_keys_equal_one_pass(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), i, rng.random()) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        out = folds.fold(df, ["k"], ["i"], lambda: (0, 0.0), lambda s, r: ((s[0] + 1, s[1] * 0.5 + r.x), []), "k string, n long, x double", lambda key, s: [(*key, *s)]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, _, x in sorted(rows, key=lambda r: r[1]):
        n, s = want.get(k, (0, 0.0))
        want[k] = (n + 1, s * 0.5 + x)
    assert {r["k"]: r["n"] for r in out} == {k: n for k, (n, _) in want.items()}
    assert all(r["x"] == pytest.approx(want[r["k"]][1]) for r in out)


def test_life_transitions(spark):
    day = dt.date(2024, 6, 1)
    at = lambda d: day - dt.timedelta(days=d)
    contacts = [(at(i), f"new{i}") for i in range(1, 20)] + [(at(60 + i), "old") for i in range(9)] + [(at(200), "old")]
    places = [(at(i), i) for i in range(1, 9)] + [(at(50), 1), (at(51), 2)]
    moods, meetings, mails = [(at(1), 0.2), (at(50), 0.6)], [(at(1),), (at(50),)], [(at(1), f"d{i}") for i in range(6)] + [(at(2), None)]
    frames = [spark.createDataFrame(r, s) for r, s in ((contacts, "at date, who string"), (places, "at date, cell long"), (moods, "at date, score double"), (meetings, "at date"), (mails, "at date, domain string"))]
    out = {r["test"]: (r["type"], r["strength"], r["together"]) for r in statistics.life_transitions(*frames, F.lit(day)).collect()}
    assert out["contacts"] == ("social_shift", 1.0, True) and out["places"] == ("relocation", 1.0, True) and out["mails"][0] == "career_change" and out["moods"] == ("stress_period", 1.0, True)
    assert out["volume"][0] == "social_shift" and out["meetings"] == ("routine_break", 1.0, True)
    none = [f.limit(0) for f in frames]
    assert statistics.life_transitions(*none, F.lit(day)).count() == 0


def test_records_without_an_id_stay(spark):
    rows = [(None, dt.datetime(2024, 1, 1), "a", "c", "one"), (None, dt.datetime(2024, 1, 1), "a", "c", "two"), ("5", dt.datetime(2024, 1, 2), "a", "c", "late"), ("5", dt.datetime(2024, 1, 1), "a", "c", "early")]
    out = normalise.ingest({"message": spark.createDataFrame(rows, "id string, ts timestamp, sender string, chat string, text string")}).collect()
    assert sorted(r["content"] for r in out) == ["early", "one", "two"]


def test_rewrite_replaces_a_table_that_it_reads(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(5).write.parquet(path)
    sinks.rewrite(spark.read.parquet(path).filter("id > 1"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [2, 3, 4] and os.listdir(tmp_path) == ["t"]


# --- clusters and chapters against numpy and plain Python


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def embeddings(spark):
    return {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def test_topics_are_those_of_the_nearest_centre(spark):
    e = embeddings(spark)
    rows = vectors.kmeans(spark.read.parquet(f"{SF}/embeddings.parquet"), 5).collect()
    unit = {i: v / np.linalg.norm(v) for i, v in e.items()}
    topics = {}
    for r in rows:
        topics.setdefault(r["topic"], []).append(r["vec_id"])
    centre = {t: np.mean([unit[i] for i in ids], axis=0) for t, ids in topics.items()}
    for r in rows:  # the last step of the fit may leave a few on a border
        far = {t: np.linalg.norm(unit[r["vec_id"]] - c) for t, c in centre.items()}
        assert far[r["topic"]] <= min(far.values()) + 0.05 and len(rows) == len(e)
    near = graphs.nearest_to_centroid(spark, SF).collect()
    distance = {r["vec_id"]: r["distance"] for r in rows}
    for t, ids in topics.items():
        best = sorted(ids, key=lambda i: (distance[i], i))[:15]
        assert [r["vec_id"] for r in sorted((x for x in near if x["topic"] == t), key=lambda x: x["place"])] == best


def test_chapters_equal_plain_rules(spark):
    from tidewater.operators import chapters

    points = [tuple(r) for r in chapters.change_points(statistical._areas(spark, SF)).select("metric", "week", "z").collect()]
    groups, first = [], None
    for week in sorted({w for _, w, _ in points}):
        if first is None or (week - first).days > 14:
            groups.append([])
            first = week
        groups[-1] += [p for p in points if p[1] == week]
    want = []
    for g in groups:
        z = [p[2] for p in g]
        want.append((min(p[1] for p in g), len(g), round(min(0.95, 0.3 + 0.15 * len(g) + 0.05 * sum(map(abs, z))), 2)))
    got = sorted((r["begins"], r["shifts"], r["confidence"]) for r in statistical.life_chapters(spark, SF).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 0.011 for g, w in zip(got, want, strict=True))
    found = statistical.life_chapters(spark, SF).collect()
    kind, conf = {r["begins"]: r["type"] for r in found}, {r["begins"]: r["confidence"] for r in found}
    similar = {}
    for r in statistical.similar_chapters(spark, SF).collect():
        similar.setdefault(r["begins"], []).append((r["gap"], r["other"]))
    for b in kind:
        best = sorted((round(abs(conf[b] - conf[o]), 9), o) for o in kind if o != b and kind[o] == kind[b])[:3]
        assert sorted(o for _, o in similar.get(b, [])) == sorted(o for _, o in best)
