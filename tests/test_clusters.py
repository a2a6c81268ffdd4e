"""Clusters against brute force: days of photos, and styles of persons."""

from __future__ import annotations

import datetime as dt
import random
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pandas as pd

from tidewater.operators import windows
from tidewater.plans import graphs

SF = "/root/testdata/sf0.001"


def far(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 12742 * asin(sqrt(min(1.0, h)))


def plain(points, km):
    seeds, out = [], []
    for at in points:
        hit = next((i for i, s in enumerate(seeds) if at is None or s is None or far(s, at) <= km), None)
        if hit is None:
            hit = len(seeds)
            seeds.append(at)
        out.append(hit + 1)
    return out


def test_day_clusters_equal_a_look_at_all_seeds(spark):
    rng, rows, want = random.Random(3), [], {}
    for d in range(8):
        day = dt.date(2024, 1, 1 + d)
        around = ((0.0, 0.0), (89.6, 10.0), (-89.9, 0.0), (10.0, 179.9), (48.0, 11.0))[d % 5]
        points = [(max(-90.0, min(90.0, around[0] + rng.uniform(-2, 2))), around[1] + rng.uniform(-3, 3)) for _ in range(150)]
        points = [(a, b - 360 if b > 180 and rng.random() < 0.5 else b) for a, b in points]
        points = [None if rng.random() < 0.02 * (d > 3) and i else p for i, p in enumerate(points)]
        if d == 7:
            points[0] = None  # a first member without a place is near to all
        want |= {1000 * d + i: c for i, c in enumerate(plain(points, 50.0))}
        rows += [(day, 1000 * d + i, p[0] if p else None, p[1] if p else float("nan") if i % 2 else None) for i, p in enumerate(points)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "day date, id long, lat double, lon double")
    out = windows.day_radius_clusters(df, "day", "lat", "lon", "id").collect()
    assert {r["id"]: r["cluster"] for r in out} == want and len(out) == len(rows)
    assert max(c for i, c in want.items() if i < 1000) > 10 and {c for i, c in want.items() if i >= 7000} == {1}
    assert windows.day_radius_clusters(df.limit(0), "day", "lat", "lon", "id").count() == 0


def lloyd(x, k, rng):
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(20):
        near = ((x[:, None] - centres) ** 2).sum(-1).argmin(1)
        centres = np.array([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(k)])
    return near


def inertia(x, near):
    return sum(((x[near == i] - x[near == i].mean(0)) ** 2).sum() for i in set(near))


def test_style_clusters_hold_as_close_as_plain_ones(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    e["n"], e["q"], e["h"] = e.props.str.len(), e.props.str.contains("7"), e.ts.dt.hour
    e["emoji"], e["weekend"], e["sent"] = e.event_id % 3 == 0, e.ts.dt.dayofweek >= 5, e.event_type == "click"
    g = e.groupby("user_id")
    f = pd.DataFrame({"l": g.n.mean(), "ls": g.n.std(ddof=0), "e": g.emoji.mean(), "q": g.q.mean(), "h": g.h.mean(), "hs": g.h.std(ddof=0), "w": g.weekend.mean(), "s": g.sent.mean(), "m": g.value.mean()})
    f = f[g.size() >= 10].fillna(0.0)
    x = ((f - f.min()) / (f.max() - f.min()).replace(0, np.inf)).to_numpy()
    out = {r["vec_id"]: r["topic"] for r in graphs.style_clusters(spark, SF).collect()}
    assert sorted(out) == sorted(f.index) and len(set(out.values())) == 5
    ours = inertia(x, np.array([out[i] for i in f.index]))
    assert ours <= max(inertia(x, lloyd(x, 5, np.random.default_rng(s))) for s in range(10)) * 1.02
