"""Cluster trees, splits of all topics at once, greedy matching and figures of intervals against brute force."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import intervals, matching, topics


def vectors_of(spark, rng, n, d=4):
    rows = [(i, [rng.gauss(0, 1) for _ in range(d)]) for i in range(n)] + [(n, None)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_walks_end_in_the_most_specific_node(spark):
    rng = random.Random(4)
    rows, v = vectors_of(spark, rng, 80)
    nodes = [(i, None, [rng.gauss(0, 1) for _ in range(4)]) for i in range(4)]
    nodes += [(10 + i, i % 2, [rng.gauss(0, 1) for _ in range(4)]) for i in range(6)] + [(20 + i, 10, [rng.gauss(0, 1) for _ in range(4)]) for i in range(2)]
    got = {r["vec_id"]: r for r in topics.walk_down(v, spark.createDataFrame(nodes, "node long, parent long, embedding array<double>")).collect()}
    for i, x in rows[:-1]:
        at, path = None, []
        while kids := [(float(np.linalg.norm(np.subtract(x, c))), n) for n, p, c in nodes if p == at]:
            d, at = min(kids)
            path.append((at, len(path) + 1, pytest.approx(d)))
        assert [tuple(p) for p in got[i]["path"]] == path and (got[i]["node"], got[i]["level"]) == (at, len(path))
    assert got[80]["node"] is None and got[80]["path"] == []


def test_figures_count_each_level(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, [9.0, 0.0])], "vec_id long, embedding array<double>")
    nodes = spark.createDataFrame([(1, None, [0.0, 0.0]), (2, None, [9.0, 0.0]), (3, 1, [0.0, 1.0])], "node long, parent long, embedding array<double>")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (9, "z")], "vec_id long, kind string")
    out = {r["node"]: (r["level"], r["members"], r["mean_distance"], r["sources"]) for r in topics.node_figures(topics.walk_down(v, nodes), source, "kind").collect()}
    assert out == {1: (1, 2, 0.5, {"a": 1, "b": 1}), 2: (1, 1, 0.0, {"unknown": 1}), 3: (2, 2, 0.5, {"a": 1, "b": 1})}


def test_no_items_and_no_nodes(spark):
    v = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "node long, parent long, embedding array<double>")
    assert topics.walk_down(v, none).first()["node"] is None and topics.walk_down(v.limit(0), none).count() == 0


def test_all_topics_split_at_once(spark):
    """Planted groups on the sphere: every topic's groups are found, and no centre's move would help."""
    rng = np.random.default_rng(3)
    rows, truth = [], {}
    for topic, groups in ((0, 3), (1, 4), (2, 1)):
        for g in range(groups):
            centre = rng.normal(size=8) * 4
            for _ in range(30):
                rows.append((len(rows), topic, (centre + rng.normal(size=8) * 0.2).tolist()))
                truth[rows[-1][0]] = (topic, g)
    df = spark.createDataFrame(rows, "vec_id long, topic long, embedding array<double>")
    parts = spark.createDataFrame([(0, 3), (1, 4)], "topic long, k int")
    got = {r["vec_id"]: (r["topic"], r["subtopic"]) for r in topics.split_all(df, parts).collect()}
    assert set(got) == {i for i, t in truth.items() if t[0] < 2}
    pairs = {(truth[i], got[i]) for i in got}
    assert len(pairs) == 7 and len({b for _, b in pairs}) == 7
    assert got == {r["vec_id"]: (r["topic"], r["subtopic"]) for r in topics.split_all(df.repartition(5), parts).collect()}


def test_splitting_is_a_fixed_point_of_lloyd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, topic long, embedding array<double>")
    got = topics.split_all(df, spark.createDataFrame([(0, 4)], "topic long, k int"), iterations=60).collect()
    label = np.array([r["subtopic"] for r in sorted(got, key=lambda r: r["vec_id"])])
    centres = np.array([x[label == c].mean(axis=0) for c in range(4)])
    assert (((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1) == label).all()


def test_points_that_coincide_need_fewer_centres(spark):
    df = spark.createDataFrame([(i, 0, [1.0, 0.0]) for i in range(9)], "vec_id long, topic long, embedding array<double>")
    assert {r["subtopic"] for r in topics.split_all(df, spark.createDataFrame([(0, 3)], "topic long, k int")).collect()} == {0}
    assert topics.split_all(df, spark.createDataFrame([], "topic long, k int")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_rounds_of_mutual_best_are_greedy_choice(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, chr(97 + j), rng.choice([0.5, rng.random()])) for i in range(12) for j in range(9) if rng.random() < 0.7] + [(1, "a", None), (None, "a", 2.0), (3, "b", float("nan"))]
    got = sorted(map(tuple, matching.greedy_match(spark.createDataFrame(pairs, "l long, r string, s double"), "l", "r", "s").collect()))
    want, used = [], set()
    for s, i, j in sorted((-s, i, j) for i, j, s in pairs if i is not None and s is not None and s == s):
        if i not in used and j not in used:
            want.append((i, j, -s))
            used |= {i, j}
    assert got == sorted(want)


def test_a_chain_of_scores_and_no_pairs(spark):
    """Each pair blocks the next better one: as many rounds as pairs that are taken."""
    chain = [(i, i, float(2 * i)) for i in range(6)] + [(i + 1, i, float(2 * i + 1)) for i in range(5)]
    df = spark.createDataFrame(chain, "l long, r long, s double")
    assert sorted(map(tuple, matching.greedy_match(df, "l", "r", "s").collect())) == [(i, i, 2.0 * i) for i in range(6)]
    assert matching.greedy_match(df.limit(0), "l", "r", "s").count() == 0


def test_labels_go_once(spark):
    c = spark.createDataFrame([(0, 1.0, 0.0), (1, 0.9, 0.5), (2, 0.0, 0.1)], "cluster long, x double, y double")
    out = {r["cluster"]: r["label"] for r in matching.unique_labels(c, "cluster", {"fast": F.col("x"), "calm": F.col("y")}).collect()}
    assert out == {0: "fast", 1: "calm", 2: "uncategorized"}


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_soundtracks(spark):
    plays = [(day(0), "A", "x", "web", 2.0), (day(0), "A", "x", "app", None), (day(1), "B", "y", "app", None), (day(1), "C", "x", "web", 1.5), (day(5), "D", "z", "web", 1.0), (None, "E", "z", "web", 1.0), (day(1), None, "q", "app", None)]
    spans = [(1, day(0), day(1)), (2, day(0), day(1)), (3, day(1), day(4)), (4, day(2), day(4)), (5, day(1), day(0)), (6, None, day(3)), (7, day(5), day(5))]
    out = {r["id"]: r for r in intervals.soundtracks(spark.createDataFrame(spans, "id long, b date, e date"), spark.createDataFrame(plays, "date date, artist string, track string, source string, minutes double"), "b", "e", ["web", "app", "tape"], 2).collect()}
    assert set(out) == {1, 2, 3, 7} and out[1].asDict(True) == out[2].asDict(True) | {"id": 1}
    one = out[1]
    assert (one["total_plays"], one["total_minutes"], one["unique_artists"], one["source_breakdown"]) == (5, 3.5, 3, {"web": 2, "app": 3, "tape": 0})
    assert one["top_artists"] == ["A", "B"] and one["top_tracks"] == ["A - x", "B - y"]
    assert out[7]["top_artists"] == ["D"] and out[3]["total_plays"] == 3


def test_many_intervals_meet_the_days_once(spark):
    spans = spark.range(1000).select("id", F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").alias("b")).withColumn("e", F.expr("date_add(b, 9)"))
    assert intervals.dictionary(spans, "b", "e").count() == 30
