"""What the findings of round 4 name: copies of rows whose number grows with the square of the input."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import similarity
from tidewater.operators import joins, merges, pairs, resolve
from tidewater.plans import merging


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("pairs", "persons", "span"), [(7, 9, 4_000), (40, 9, 1), (1_000_000, 60, 40_000)])
def test_parts_of_people_meet_without_copies_on_disk(spark, monkeypatch, pairs, persons, span):
    """Rows are stored once, not once for each part; counts are the same where a person's pairs come in many batches and where few of the cells occur."""
    monkeypatch.setattr(joins, "_PAIRS", pairs)
    rng = random.Random(pairs)
    rows = [(rng.randrange(persons), rng.randrange(span)) for _ in range(150)] + [(1, 10), (1, 10), (2, 310)]
    df = spark.createDataFrame(rows, "p long, t long").select("p", F.timestamp_seconds("t").alias("ts"))
    want = Counter((min(p, q), max(p, q)) for (p, t), (q, u) in combinations(rows, 2) if p != q and abs(t - u) <= 300)
    out = joins.often_near(df, "p", "ts", 300, 2)
    assert "Exchange" not in _plan(out) and "CartesianProduct" in _plan(out)
    assert {(r["a"], r["b"]): r["times"] for r in out.collect()} == {k: n for k, n in want.items() if n >= 2}


def _alike(x, y):
    if x == y or "" in (x, y):
        return float(x == y)
    if x in y or y in x:
        return 0.8
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return 1 - row[-1] / max(len(x), len(y))


def test_distances_of_many_names_are_those_of_each_two():
    rng = random.Random(2)
    for _ in range(200):
        head, letters = rng.choice(["", "ann "]), "abé😀"[: rng.randint(1, 4)]
        x, y = (sorted((head + "".join(rng.choices(letters, k=rng.randint(0, 8))) for _ in range(rng.randint(1, 7))), key=len) for _ in range(2))
        longest = max(map(len, [*x, *y, "a"]))
        values = similarity.edit_values(longest)
        assert [[values[c] for c in r] for r in similarity.edit_codes(x, y, longest)] == [[_alike(a, b) for b in y] for a in x]


@pytest.mark.parametrize(("block", "twice"), [(2, False), (2, True), (2_000, False), (2_000, True)])
def test_contacts_are_scored_in_the_groups_where_they_meet(spark, monkeypatch, block, twice):
    """Without a distance for each pair as an expression; ties at the limit, mails and names that are missing, and contacts with two phones count as before."""
    monkeypatch.setattr(pairs.meetings, "__defaults__", (block,))
    monkeypatch.setattr(resolve, "_CELLS", 100)
    rng = random.Random(block)
    names = ["Ann  Lee", "ann", "Bob", "bo lee", "", None, "abcd", "abxy", "Zoë 😀"]
    rows = [(i, rng.choice(names), rng.choice(["p", "q", "", None]), rng.choice(["m", "n", "", None])) for i in range(60)]
    rows += [(i, n, "r", m) for i, n, _, m in rows[:20]] if twice else []
    out = resolve.contact_pairs(spark.createDataFrame(rows, "id long, name string, phone string, email string"), digits=6)
    assert "levenshtein" not in _plan(out)
    want = {}
    for (a, x, p, m), (b, y, q, n) in combinations(sorted(rows, key=lambda r: r[0]), 2):
        if a != b and p and p == q and None not in (x, y):
            s = 0.5 + 0.3 * float(bool(m) and m == n) + 0.2 * _alike(" ".join(x.lower().split()), " ".join(y.lower().split()))
            want[a, b] = max(s, want.get((a, b), 0))
    assert sorted(map(tuple, out.collect())) == sorted((a, b, round(s, 6), "auto" if s >= 0.95 else "review") for (a, b), s in want.items() if s >= 0.6)


def test_ids_are_put_into_arrays_by_place(spark):
    """Places outside an array and, with _was, elements that are others by now change nothing, nor do rows without ids, null arrays and null elements."""
    child = merges.Child("c", "ids", ("k",), array=True)
    c = spark.createDataFrame([(1, [5, 6, 7, 6]), (2, None), (3, [8]), (4, []), (5, [None, 9])], "k int, ids array<long>")
    ids = spark.createDataFrame([(1, 1, 60, 6), (1, 2, 70, 5), (1, 9, 90, 6), (2, 0, 1, 1), (4, 0, 1, 1), (5, 0, 1, 1), (5, 1, 2, 9)], "k int, _at int, _id long, _was long")
    got = {r["k"]: r["ids"] for r in merges._put(c, child, ids).collect()}
    assert got == {1: [5, 60, 7, 6], 2: None, 3: [8], 4: [], 5: [None, 2]}
    got = {r["k"]: r["ids"] for r in merges._put(c, child, ids.drop("_was")).collect()}
    assert got == {1: [5, 60, 70, 6], 2: None, 3: [8], 4: [], 5: [1, 2]}


def test_undoing_moves_the_rows_of_a_run_once(spark, tmp_path, monkeypatch):
    """Arrays are taken apart only where what they refer to is looked up, and no images are moved to find out which rows several merges of a run touched."""
    shared, places = merges._shared, []
    monkeypatch.setattr(merges, "_shared", lambda log, p: places.append(set(p)) or shared(log, p))
    spark.range(40).select(F.col("id").alias("p_partkey"), F.concat(F.lit("n"), F.col("id") % 3).alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), (F.col("id") % 7).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(120).select((F.col("id") % 30).alias("l_orderkey"), (F.col("id") % 40).alias("l_partkey"), (F.col("id") / 30).cast("int").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = merging.merge_undo_tables(spark, str(tmp_path))
    plan = re.sub(r"#\d+L?", "", _plan(out))
    assert places == [{"entities"}] and plan.count("Generate posexplode") == 2 and "hashpartitioning(basket, _at" not in plan
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in out.collect()) == sorted(con.sql(merging.ORACLE["merge_undo_tables"]).fetchall())
