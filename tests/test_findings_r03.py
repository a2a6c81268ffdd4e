"""What the findings of round 3 name: rows that all share a key, words that all titles hold, and exact results of text blocks."""

from __future__ import annotations

import email.header
import random
import re
from collections import Counter
from functools import reduce
from itertools import combinations
from operator import add

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import joins, markers, merges, pairs, resolve
from tidewater.plans import graphs, persons, statistical
from tidewater.sources import files


def test_text_blocks_keep_digits_at_their_ends(spark):
    df = spark.createDataFrame([("00 first block 0\n\n  11 second block 1 \n\n\n22 third block 22",)], "t string")
    assert df.select(files.text_blocks(F.col("t"))).first()[0] == ["00 first block 0", "11 second block 1", "22 third block 22"]


def test_undoing_many_merges_of_a_keeper_keeps_no_pairs(spark, monkeypatch):
    """Rows that are cut grow with the merges, not with their square."""
    rows, cut = [], merges._cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(merges, "_cut", counted)
    n = 200
    e = spark.range(n + 3).select("id", F.concat(F.lit("n"), F.col("id")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"))
    keeper = F.when(F.col("id") > n, F.lit(n + 1)).otherwise(F.lit(0)).cast("long")
    requests = e.filter(f"id not in (0, {n + 1})").select(F.col("id").alias("candidate_id"), keeper.alias("keeper_id"), F.col("id").alias("merged_id"), F.lit(None).cast("map<string,string>").alias("choices"), F.lit("x").alias("merged_by"), F.lit("2024-01-01").cast("timestamp").alias("merged_at"))
    entity = merges.Entity("e", "id", "name", "aliases", (), "active")
    _, log, _ = merges.execute({"e": e}, requests, entity, [], 1)
    wanted = requests.filter("candidate_id != 7").select(F.col("candidate_id").alias("audit_id"))
    status = dict(map(tuple, merges.undo_status(log, wanted, entity, [], F.lit("2024-01-02").cast("timestamp")).collect()))
    assert status.pop(n + 2) == "undone" and len(status) == n - 1 and set(status.values()) == {"blocked"}
    assert max(rows) <= 2 * n


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_keys_are_counted_where_a_pair_meets_first(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice([*"abcdefg", None])) for _ in range(60)]
    got = sorted(tuple(r) for r in pairs.shared(spark.createDataFrame(rows, "id int, key string"), "key", "id", 3).collect())
    keys = {i: {k for j, k in rows if j == i and k} for i in range(12)}
    assert got == [(a, b, len(keys[a] & keys[b])) for a in range(12) for b in range(a + 1, 12) if keys[a] & keys[b]]
    assert "keys=[a#" not in _plan(pairs.shared(spark.createDataFrame(rows, "id int, key string"), "key", "id"))


def test_pairs_come_dealt_over_as_many_partitions_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_PAIRS", 100)
    out = pairs.within(spark.range(100).select(F.lit(1).alias("k"), "id"), ["k"], "id", by_pair=True)
    assert out.rdd.getNumPartitions() == 50 and _plan(out.groupBy("a", "b").count()).count("REPARTITION_BY_NUM") == 3


def test_contacts_with_one_phone_each_are_not_grouped_by_pair(spark):
    one = spark.createDataFrame([(i, f"Ann {i % 3}", "p", f"m{i % 2}") for i in range(12)], "id long, name string, phone string, email string")
    out = resolve.contact_pairs(one)
    assert "keys=[a#" not in _plan(out) and out.count() == 66
    twice = one.union(one.withColumn("phone", F.lit("q")).filter("id < 4"))
    assert sorted(map(tuple, resolve.contact_pairs(twice).collect())) == sorted(map(tuple, out.collect()))


def test_people_of_one_first_name_meet_its_first_chapters_only(spark):
    """A hundred people of a name and a hundred chapters with it in the title: k chapters a name go on, not all."""
    people = spark.range(100).select(F.col("id").alias("person"), F.concat(F.lit("Ann "), F.col("id")).alias("name"))
    chapters = spark.range(100).select(F.col("id").alias("chapter_id"), F.lit("with Ann").alias("title"), (99 - F.col("id")).alias("begins"), F.array(F.col("id")).alias("key_people"))
    out = markers.chapters_of(people, chapters, ["begins"], 2)
    got = {(r["person"], r["place"]): r["chapter_id"] for r in out.collect()}
    assert got == {(p, i): 100 - i for p in range(100) for i in (1, 2)}
    assert "first_name" in _plan(out).partition("windowspecdefinition(first_name")[1]


@pytest.mark.parametrize("persons", [2, 5000])
def test_people_near_in_time_are_counted_without_pairs(spark, persons):
    rng = random.Random(persons)
    rows = [(rng.randrange(9), rng.randrange(4000)) for _ in range(120)] + [(None, 5), (1, None), (1, 10), (1, 10), (2, 310)]
    df = spark.createDataFrame(rows, "p long, t long").select("p", F.timestamp_seconds("t").alias("ts"))
    want = Counter((min(p, q), max(p, q)) for (p, t), (q, u) in combinations([r for r in rows if None not in r], 2) if p != q and abs(t - u) <= 300)
    got = {(r["a"], r["b"]): r["times"] for r in joins.often_near(df, "p", "ts", 300, 3, persons).collect()}
    assert got == {k: n for k, n in want.items() if n >= 3} and got


def test_plain_headers_are_not_decoded(monkeypatch):
    values = ["", "a b", "  x  y ", "a\n b", "<1@x.org>", "=?utf-8?q?C=C3=A9line?= <c1@x.org>", "é", "a =?utf-8?b?w6k=?= 7"]
    assert [files.header_text(v) for v in values] == [str(email.header.make_header(email.header.decode_header(v))).replace("\n", " ") for v in values]
    monkeypatch.setattr(email.header, "decode_header", None)
    assert files.header_text("Inbox,Spam") == "Inbox,Spam"


def _most_records(df, *sizes):
    """Rows of the largest partition for each of these numbers of copies of df, by the function that deals them."""
    out = []
    for n in sizes:
        got = df(n)
        out.append(max(got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()))
    return out


def test_rows_are_dealt_over_as_many_partitions_as_their_number_needs(spark, monkeypatch):
    """Ten times the rows give ten times the partitions, which adaptive execution neither unites nor bounds."""
    monkeypatch.setattr(pairs, "_ROWS", 100)
    few, many = _most_records(lambda n: pairs.dealt(spark.range(n).withColumn("m", F.col("id") % 3), "id").distinct(), 1_000, 10_000)
    assert many <= 1.5 * few


def test_members_of_a_graph_are_dealt_by_order_and_made_distinct_there(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "_ROWS", 100)
    spark.range(1_000).select((F.col("id") % 250).alias("l_orderkey"), (F.col("id") % 7).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = _plan(graphs._edges(spark, str(tmp_path)))
    assert "hashpartitioning(l_orderkey, 11), REPARTITION_BY_NUM" in re.sub(r"#\d+L?", "", plan)
    assert "hashpartitioning(l_orderkey, l_suppkey" not in re.sub(r"#\d+L?", "", plan)


def test_bridges_read_their_edges_once(spark, tmp_path):
    """Edges are kept for the propagation and for the bridges, in both directions."""
    rows = [(o, p) for o, ps in enumerate([(1, 2, 3)] * 2 + [(4, 5, 6)] * 2 + [(3, 4)] * 2) for p in ps]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = graphs.bridges(spark, str(tmp_path))
    assert "FileScan" not in _plan(out) and sorted(map(tuple, out.collect())) == [(3, 2), (4, 2)]


def test_voices_are_dealt_by_recording_once(spark, tmp_path, monkeypatch):
    """Join, sums and totals of a recording share one shuffle, over as many partitions as the segments need."""
    monkeypatch.setattr(pairs, "_ROWS", 100)
    spark.range(1_000).select((F.col("id") % 250).alias("l_orderkey"), (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 5).cast("double").alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(250).select(F.col("id").alias("o_orderkey"), F.lit("2024-03-01").cast("date").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    out = persons.voice_metrics(spark, str(tmp_path))
    plan = re.sub(r"#\d+L?", "", _plan(out))
    assert "hashpartitioning(media, 11), REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\([^)]*media[^)]*\), ENSURE", plan)
    recorded = [(i % 250, i % 7, i % 5) for i in range(1_000)]
    total = Counter()
    for m, _, s in recorded:
        total[m] += s
    share = Counter()
    for m, p, s in recorded:
        share[p, m] += s
    for r in out.collect():
        mine = [(m, s) for (p, m), s in share.items() if p == r["person"]]
        shares = [s / total[m] for m, s in mine if total[m] > 0]
        assert (r["conversations"], r["speaking"]) == (len(mine), sum(s for _, s in mine)) and r["dominance"] == pytest.approx(sum(shares) / len(shares), abs=1e-6)


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    """Decimal digits are summed; what these can't hold is summed as it is."""
    inf, nan = float("inf"), float("nan")
    groups = {1: [0.1] * 10, 2: [1e-20, 2e-20], 3: [1.5, inf], 4: [nan, 1.0], 5: [None, 0.25], 6: [None], 7: [1e30, 1.0], 8: [9e22] * 20}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double").coalesce(1)
    got = {r["g"]: (r["s"], r["m"]) for r in df.groupBy("g").agg(stats.exact_sum(F.col("v")).alias("s"), stats.exact_avg(F.col("v")).alias("m")).collect()}
    assert reduce(add, groups[1]) != 1.0 and got[1] == (1.0, 0.1) and got[2] == pytest.approx((3e-20, 1.5e-20), rel=1e-12)
    assert got[3] == (inf, inf) and got[4][0] != got[4][0] and got[5] == (0.25, 0.25) and got[6] == (None, None)
    assert got[7][0] == 1e30 and got[8][0] == pytest.approx(1.8e24)


def test_days_of_a_mean_at_the_limit_are_not_low(spark, tmp_path):
    """Three days of values whose mean is 45, of which a sum of doubles makes less."""
    values = next(v for v in ([round(135 - a / 100 - b / 100, 2), a / 100, b / 100] for a in range(1, 4000) for b in range(a, 4000, 7)) if reduce(add, v) < 135)
    rows = [(1, f"2024-01-0{d} 10:00:00", v) for d in (1, 2, 3) for v in values] + [(2, f"2024-01-0{d} 10:00:00", 44.99) for d in (1, 2, 3)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["user_id"], r["length"]) for r in statistical.low_streaks(spark, str(tmp_path)).collect()] == [(2, 3)]


def test_days_of_twice_their_mean_are_decided_as_by_the_sql(spark, tmp_path):
    """Each user's last day is twice the mean by its digits, so the rounding of doubles decides; up to 15 days DuckDB adds them in order, as one task does."""
    rng, rows = random.Random(7), []
    for user in range(400):
        days = [[rng.randint(1, 20_000) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 15))]
        while 2 * sum(map(sum, days)) % len(days):
            days[0][0] += 1
        last = 2 * sum(map(sum, days)) // len(days)
        first = rng.randint(1, last - 1)
        rows += [(user, f"2024-01-{d:02d} 10:00:00", "click", v / 100) for d, vs in enumerate([*days, [first, last - first]], 1) for v in vs]
    spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(persons.ORACLE["behaviour_rules"]).fetchall()
    got = [tuple(r) for r in persons.behaviour_rules(spark, str(tmp_path)).collect()]
    ends = {u: max(t for v, t, *_ in rows if v == u)[:10] for u in range(400)}
    assert sorted(got, key=str) == sorted(want, key=str) and 0 < sum(str(r[1]) == ends[r[0]] for r in got) < 400
