"""Periodic runs against brute force, in plain Python and through Spark."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_small import docs, empty, odd_docs, words
from tidewater.llm import periodic_runs, queries


def brute_runs(w, exponent, length):
    """Every period's islands of equal words at that distance; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(length, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(0, 60), st.integers(1, 9), st.sampled_from([(4, 6), (2, 2), (3, 1), (5, 1)]))
def test_runs_equal_brute_force(w, a, p, least):
    w = [w[i if i < a else a + (i - a) % p] if i < a or a + (i - a) % p < len(w) else 9 for i in range(len(w))]
    assert periodic_runs.find_runs(w, *least) == brute_runs(w, *least)


def test_long_repeats_stay_cheap():
    """Quadratic work would take hours: one period of 40,000 words five times, and one word 200,000 times."""
    rng = random.Random(1)
    root = [rng.randrange(30_000) for _ in range(40_000)]
    assert periodic_runs.find_runs(root * 5) == [(0, 200_000, 40_000)]
    assert periodic_runs.find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.find_runs(["a"] * 5) == [] and periodic_runs.find_runs(["a", "b"] * 4) == [(0, 8, 2)]


def test_collapse_keeps_each_first_period():
    w = list("xabababababyccccccz")
    runs = periodic_runs.find_runs(w)
    assert "".join(periodic_runs.collapse(w, runs)) == "xabycz" and periodic_runs.strongest(runs) == (12, 6, 1)
    assert periodic_runs.strongest([]) is None


def brute_row(i, text):
    w = (text or "").encode().split()
    n, h = len(w), None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
    runs = brute_runs(w, 4, 6)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, words(40 + i % 90, i), "en", "a") for i in range(160)] + [(i, " ".join(["la"] * 7) + "\t" + words(i % 30, i) + " do re" * 4, "en", "a") for i in range(160, 260)]
    frame = docs(spark, rows).unionByName(odd_docs(spark))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [(r["doc_id"], *brute_row(r["doc_id"], r["text"])) for r in frame.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r["n_runs"] for r in got) > 100


def test_empty_table_and_clashing_columns(spark):
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0
    more = spark.createDataFrame([(1, "a a a a a a a b", 1, "x", 2)], "doc_id long, text string, n_words int, runs string, collapsed int")
    out = periodic_runs.periodic_runs(more).first()
    assert out["n_words"] == 8 and out["collapsed"] == "a b" and [tuple(r) for r in out["runs"]] == [(0, 7, 1)]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(more, least_exponent=1)
