"""Pairs within keys of any size: the plain join's pairs, spread over tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import pairs


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_within_gives_each_pair_once(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(25)]), i) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, item int, n int")
    got = sorted((r["key"], r["a"], r["b"], r["n_a"], r["n_b"]) for r in pairs.within(df, ["key"], "item", ["n"], block).collect())
    want = sorted((k, x, y, n, m) for k, x, n in rows for q, y, m in rows if k is not None and k == q and x is not None and y is not None and x < y)
    assert got == want and want


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_between_is_the_join(spark, block):
    rng = random.Random(block + 50)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), i, "x") for i in range(40)]
    right = [(rng.choice([1, 1, 2, 4, None]), -i) for i in range(30)] + [(5, 7)]
    a, b = spark.createDataFrame(left, "key int, l int, t string"), spark.createDataFrame(right, "key int, r int")
    got = sorted((r["key"], r["l"], r["r"]) for r in pairs.between(a, b, ["key"], block).collect())
    assert got == sorted((k, x, y) for k, x, _ in left for q, y in right if k is not None and k == q)
    assert pairs.between(a, b, ["key"], block).columns == a.join(b, "key").columns


def test_a_hot_key_spreads_over_tasks(spark):
    """A third of 3,000 rows has one key: no task's share of its half a million pairs is more than a few meetings of two parts."""
    df = spark.range(3000).select(F.when(F.col("id") < 1000, F.lit(0)).otherwise(F.col("id")).alias("key"), F.col("id").alias("item"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as if both sides were large
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        out = pairs.within(df, ["key"], "item", block=100)
        per = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert sum(per) == 999 * 1000 // 2 and len(per) >= 6 and max(per) < 0.4 * sum(per)


def test_no_rows_and_two_keys(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "y", 3), (1, "x", 2)], "k int, j string, item int")
    assert sorted((r["j"], r["a"], r["b"]) for r in pairs.within(df, ["k", "j"], "item").collect()) == [("x", 1, 2), ("x", 1, 2)]
    assert pairs.within(df.limit(0), ["k"], "item", block=1).count() == 0
