"""Windows, sorts, pages, set operations and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import windows
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_LEAD = "SELECT *, lead(event_type) OVER w AS nt, epoch(date_trunc('second', lead(ts) OVER w)) - epoch(date_trunc('second', ts)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@_r.add("response_time", f"SELECT user_id, count(*) AS responses, round(avg(gap), 4) AS mean_seconds, CAST(min(gap) AS BIGINT) AS fastest FROM ({_LEAD}) WHERE event_type = 'view' AND nt = 'click' AND gap BETWEEN 1 AND 86400 GROUP BY user_id")
def response_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = windows.response_times(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "view", "click")
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("responses"), F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.min("seconds").alias("fastest"))


@_r.add(
    "direction_change_gaps",
    "WITH r AS (SELECT user_id, event_type, lag(event_type) OVER w AS before, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS changes, round(avg(gap), 4) AS mean_gap FROM r WHERE event_type <> before AND gap > 5 AND gap < 86400 GROUP BY 1",
)
def direction_change_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = windows.seconds_of("ts") - windows.seconds_of(F.lag("ts").over(w))
    r = table(spark, sf_dir, "events").select("user_id", "event_type", F.lag("event_type").over(w).alias("before"), gap.alias("gap"))
    return r.filter("event_type <> before and gap > 5 and gap < 86400").groupBy("user_id").agg(F.count(F.lit(1)).alias("changes"), F.round(F.avg("gap"), 4).alias("mean_gap"))


@_r.add(
    "path_length",
    """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS date, ts, event_id, 40 + value / 200 AS lat, -74 + (event_id % 100) / 200.0 AS lon FROM events), q AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM p WINDOW w AS (PARTITION BY user_id, date ORDER BY ts, event_id))
    SELECT user_id, date, round(sum(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * power(sin(radians(lon - lo) / 2), 2))))), 4) AS km FROM q WHERE la IS NOT NULL AND abs(lat - la) < 1 GROUP BY 1, 2""",
)
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date"), "ts", "event_id", (40 + F.col("value") / 200).alias("lat"), (-74 + (F.col("event_id") % 100) / 200.0).alias("lon"))
    w = Window.partitionBy("user_id", "date").orderBy("ts", "event_id")
    q = p.withColumns({"la": F.lag("lat").over(w), "lo": F.lag("lon").over(w)}).filter("la is not null and abs(lat - la) < 1")
    return q.groupBy("user_id", "date").agg(F.round(F.sum(stats.haversine_km(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"))), 4).alias("km"))


@_r.add("back_to_back", f"SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS pairs FROM ({_LEAD}) WHERE gap BETWEEN 0 AND 900 GROUP BY 1, 2")
def back_to_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = windows.seconds_of(F.lead("ts").over(w)) - windows.seconds_of("ts")
    return table(spark, sf_dir, "events").withColumn("gap", gap).filter(F.col("gap").between(0, 900)).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("pairs"))


@_r.add(
    "streak_islands",
    "WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events), i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INT) AS k FROM d) SELECT user_id, min(date) AS first_day, max(date) AS last_day, count(*) AS length FROM i GROUP BY user_id, k HAVING count(*) >= 3",
)
def streak_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.streaks(table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("date")), ["user_id"], "date")


_SESSIONS = """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER w)) > 1800 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)"""


@_r.add("sessions_gap30", f"{_SESSIONS} SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 2")
def sessions_gap30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.session_rows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@_r.add("sessions_native", f"{_SESSIONS} SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session HAVING count(*) >= 2")
def sessions_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by Spark's own session window, which also runs on streams."""
    e = table(spark, sf_dir, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return e.groupBy("user_id", F.session_window("t", "30 minutes")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("session_window")


@_r.add("topn_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@_r.add(
    "ranked_strings",
    "WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM n) SELECT p_brand, string_agg(p_size::VARCHAR || ':' || n, ' ' ORDER BY k) FILTER (WHERE k <= 5) AS summary FROM r GROUP BY 1",
)
def ranked_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_size"))).filter("k <= 5")
    item = F.struct("k", F.concat_ws(":", F.col("p_size").cast("string"), F.col("n").cast("string")).alias("s"))
    return r.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " ").alias("summary"))


@_r.add("distinct_on", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_partkey, l_quantity FROM lineitem ORDER BY l_orderkey, l_quantity DESC, l_linenumber, l_partkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("l_partkey", "l_quantity"), F.struct("l_quantity", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("b")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best).select("l_orderkey", "b.l_partkey", "b.l_quantity")


_WEEKS = "WITH w AS (SELECT date_trunc('week', o_orderdate)::DATE AS week, avg(o_totalprice) AS v FROM orders GROUP BY 1), z AS (SELECT week, v, avg(v) OVER x AS m, stddev_pop(v) OVER x AS sd, count(*) OVER x AS n FROM w WINDOW x AS (ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), c AS (SELECT week, (v - m) / sd AS z FROM z WHERE n = 8 AND sd > 0)"


def _weekly_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    w = table(spark, sf_dir, "orders").groupBy(week.alias("week")).agg(F.avg("o_totalprice").alias("v"))
    x = Window.partitionBy(F.lit(0)).orderBy("week").rowsBetween(-8, -1)  # one row for each week
    z = w.select("week", "v", F.avg("v").over(x).alias("m"), F.stddev_pop("v").over(x).alias("sd"), F.count("v").over(x).alias("n"))
    return z.filter("n = 8 and sd > 0").select("week", ((F.col("v") - F.col("m")) / F.col("sd")).alias("z"))


@_r.add("change_points", f"{_WEEKS} SELECT week, round(z, 4) AS z FROM c WHERE abs(z) >= 2")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly_z(spark, sf_dir).filter("abs(z) >= 2").withColumn("z", F.round("z", 4))


@_r.add(
    "gap_clusters",
    f"{_WEEKS}, p AS (SELECT * FROM c WHERE abs(z) >= 1.5), g AS (SELECT *, CASE WHEN week - lag(week) OVER (ORDER BY week) <= 14 THEN 0 ELSE 1 END AS new FROM p), k AS (SELECT *, sum(new) OVER (ORDER BY week) AS c FROM g) SELECT min(week) AS first_day, max(week) AS last_day, count(*) AS n, arg_max(week, abs(z)) AS best_day, round(arg_max(z, abs(z)), 4) AS best FROM k GROUP BY c",
)
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _weekly_z(spark, sf_dir).filter("abs(z) >= 1.5").withColumn("one", F.lit(0))
    return windows.gap_clusters(p, ["one"], "week", "z", 14).drop("one").withColumn("best", F.round("best", 4))


@_r.add(
    "anchored_groups",
    """WITH RECURSIVE d AS (SELECT o_custkey, day, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS k FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders)),
    r AS (SELECT o_custkey, k, day, day AS first, CAST(1 AS BIGINT) AS g FROM d WHERE k = 1 UNION ALL SELECT d.o_custkey, d.k, d.day, CASE WHEN d.day - r.first > 14 THEN d.day ELSE r.first END, g + CASE WHEN d.day - r.first > 14 THEN 1 ELSE 0 END FROM r JOIN d ON d.o_custkey = r.o_custkey AND d.k = r.k + 1)
    SELECT o_custkey, g AS "group", min(day) AS first_day, max(day) AS last_day FROM r GROUP BY 1, 2""",
)
def anchored_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return windows.anchored_groups(days, "o_custkey", "day", 14).groupBy("o_custkey", "group").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@_r.add("boundary_intervals", "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS begins, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS ends FROM orders")
def boundary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("begins"), F.to_date(F.lead("o_orderdate").over(w)).alias("ends"))


@_r.add(
    "conversation_quality_signals",
    """WITH c AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user' AND before = 'user') AS repeats,
    count(*) FILTER (WHERE regexp_matches(lower(text), '(sorry|error|failed|cannot)')) AS errors, round(avg(length(text)), 4) AS mean_chars FROM c GROUP BY conv_id""",
)
def conversation_quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    errors = c.groupBy("conv_id").agg(F.count_if(F.lower("text").rlike("(sorry|error|failed|cannot)")).alias("errors"), F.round(F.avg(F.char_length("text")), 4).alias("mean_chars"))
    return windows.turn_signals(c, "conv_id", "turn", "role").join(errors, "conv_id")


@_r.add("rapid_fire", "WITH u AS (SELECT user_id, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events WHERE event_type IN ('click', 'view')) SELECT user_id, count(*) FILTER (WHERE gap < 600) AS rapid FROM u GROUP BY 1")
def rapid_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rapid_fire(table(spark, sf_dir, "events").filter("event_type in ('click', 'view')"), "user_id", ["ts", "event_id"], 600)


@_r.add(
    "conversation_chunks",
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    k AS (SELECT *, CASE WHEN n <= 50 THEN 0 ELSE ceil((n - 50) / 40.0) END AS last FROM r), c AS (SELECT user_id, event_id, unnest(range(0, 1000)) AS chunk, i, last FROM k)
    SELECT user_id, chunk, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM c WHERE chunk <= last AND i >= chunk * 40 AND i < chunk * 40 + 50 GROUP BY 1, 2""",
)
def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    return windows.chunks(rows, "user_id", "order").groupBy("user_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@_r.add("bookends", "SELECT user_id, CAST(ts AS DATE) AS date, arg_min(event_type, (ts, event_id)) AS first_kind, arg_max(event_type, (ts, event_id)) AS last_kind FROM events GROUP BY 1, 2")
def bookends(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.min_by("event_type", at).alias("first_kind"), F.max_by("event_type", at).alias("last_kind"))


@_r.add(
    "photo_day_clusters",
    """WITH RECURSIVE p AS (SELECT CAST(ts AS DATE) AS day, event_id, CASE WHEN event_type <> 'error' THEN 40 + value / 50 END AS lat, CASE WHEN event_type <> 'error' AND value IS NOT NULL THEN -74 + event_id % 7 / 5.0::DOUBLE END AS lon, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS k FROM events),
    r AS (SELECT day, k, event_id, [{'x': lat, 'y': lon}] AS seeds, CAST(1 AS BIGINT) AS cluster FROM p WHERE k = 1 UNION ALL SELECT day, k, event_id, CASE WHEN hit IS NULL THEN list_append(seeds, {'x': lat, 'y': lon}) ELSE seeds END, coalesce(hit, len(seeds) + 1) FROM
    (SELECT p.*, r.seeds, list_min(list_filter(range(1, len(r.seeds) + 1), lambda i: p.lat IS NULL OR r.seeds[i].x IS NULL OR 12742 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - r.seeds[i].x) / 2), 2) + cos(radians(r.seeds[i].x)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - r.seeds[i].y) / 2), 2)))) <= 50)) AS hit FROM r JOIN p ON p.day = r.day AND p.k = r.k + 1))
    SELECT day, event_id, cluster FROM r""",
)
def photo_day_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", F.when(F.col("event_type") != "error", 40 + F.col("value") / 50).alias("lat"), (-74 + F.col("event_id") % 7 / 5.0).alias("lon"))
    return windows.day_radius_clusters(e, "day", "lat", "lon", "event_id")


# --- sorts, limits, pages


@_r.add("topk_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@_r.add("sort_by_expression", "SELECT event_id, round(value, 4) AS value FROM events WHERE value IS NOT NULL ORDER BY abs(value - 50) DESC, event_id LIMIT 20")
def sort_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value is not null").orderBy(F.abs(F.col("value") - 50).desc(), "event_id").limit(20).select("event_id", F.round("value", 4).alias("value"))


@_r.add("explicit_nulls_order", "SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, nullif(count(*), 10) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY n DESC NULLS LAST, c_custkey LIMIT 30")
def explicit_nulls_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.nullif(F.count(F.lit(1)), F.lit(10)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").orderBy(F.desc_nulls_last("n"), "c_custkey").limit(30)


@_r.add("offset_page", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(40).limit(20)


@_r.add("keyset_page", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id > 500").select("event_id", "event_type").orderBy("event_id").limit(50)


@_r.add(
    "ends_sample",
    "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS l FROM conversations) WHERE f <= 3 OR l <= 3",
)
def ends_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w.orderBy("turn")).alias("f"), F.row_number().over(w.orderBy(F.desc("turn"))).alias("l"))
    return c.filter("f <= 3 or l <= 3").select("conv_id", "turn")


@_r.add(
    "priority_lanes",
    "WITH j AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS lane, left(o_orderpriority, 1)::INT AS p, o_orderdate FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, lane FROM j QUALIFY row_number() OVER (PARTITION BY lane ORDER BY p, o_orderdate, o_orderkey) <= CASE WHEN lane = 0 THEN 5 ELSE 15 END",
)
def priority_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1).alias("lane"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("p"), "o_orderdate")
    order = ["p", "o_orderdate", "o_orderkey"]
    return o.filter("lane = 0").orderBy(*order).limit(5).union(o.filter("lane = 1").orderBy(*order).limit(15)).select("o_orderkey", "lane")


# --- set operations


@_r.add(
    "union_view",
    """WITH u AS (SELECT 'order' AS source, o_orderkey AS id, o_orderdate AS ts, o_custkey AS person, o_totalprice AS amount FROM orders UNION ALL SELECT 'event', event_id, ts, user_id, value FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')
    SELECT DISTINCT ON (source, id) source, id, CAST(ts AS DATE) AS date, person, round(amount, 2) AS amount FROM u ORDER BY source, id""",
)
def union_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")

    def orders(df: DataFrame) -> DataFrame:
        return df.select(F.lit("order").alias("source"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").alias("person"), F.round("o_totalprice", 2).alias("amount"))

    e = table(spark, sf_dir, "events").select(F.lit("event").alias("source"), F.col("event_id").alias("id"), F.to_date("ts").alias("date"), F.col("user_id").alias("person"), F.round("value", 2).alias("amount"))
    return reduce(DataFrame.unionByName, [orders(o), e, orders(o.filter("o_orderstatus = 'P'"))]).dropDuplicates(["source", "id"])


@_r.add("union_distinct", "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events UNION SELECT s_suppkey FROM supplier")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("orders", "o_custkey"), ("events", "user_id"), ("supplier", "s_suppkey"))]
    return reduce(DataFrame.union, parts).distinct()


@_r.add("select_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def select_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@_r.add("set_difference", "SELECT c_custkey AS id, 'new' AS change FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'removed' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, c = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct(), table(spark, sf_dir, "customer")
    new = c.select(F.col("c_custkey").alias("id")).join(users, "id", "left_anti").withColumn("change", F.lit("new"))
    removed = users.join(c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id", "left_anti").withColumn("change", F.lit("removed"))
    return new.union(removed)
