"""Queries take whole tables: rows that a filter on ids would miss."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from tidewater.plans import graphs, windowed
from tidewater.streaming import stateful


def test_graphs_and_anchored_groups_take_whole_tables(spark, tmp_path):
    spark.createDataFrame([(o, s) for o in (1, 2, 3) for s in (11, 12)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (10, dt.datetime(2024, 1, 1))], "o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(map(tuple, graphs.label_propagation(spark, str(tmp_path)).collect())) == [(11, 11), (12, 11)]
    assert sorted(r["o_custkey"] for r in windowed.anchored_groups(spark, str(tmp_path)).collect()) == [1, 10]


def test_promotion_counts_a_hot_source_in_full():
    rule = stateful.promotion()
    row = __import__("collections").namedtuple("row", "source ts")
    state, out = rule.start, []
    for minute in range(400):
        state, some = rule.step(state, row("s", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)))
        out += some
    assert [o[2] for o in out] == [3, 3, *range(3, 401)] and len({o[1] for o in out}) == 400 and len(state[1]) == 5
    state, out = rule.step(state, row("s", pd.Timestamp("2024-01-08 00:10")))
    assert out[0][2] == 391
