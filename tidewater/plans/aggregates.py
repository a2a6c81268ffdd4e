"""Aggregations: filtered and distinct counts, folds, ordered arrays and strings, modes, duplicates, rollups of usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import aggregates as agg
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add("filtered_counts", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS large_purchases, count(*) AS n FROM events GROUP BY user_id")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("large_purchases"), F.count(F.lit(1)).alias("n"))


@_r.add("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS bulk_suppliers, count(DISTINCT (l_partkey, l_suppkey)) AS offers FROM lineitem GROUP BY l_returnflag")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_suppkey"))).alias("bulk_suppliers"), F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("offers"))


@_r.add("daily_event_mix", "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 8) AS mean_value, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def daily_event_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 8).alias("mean_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@_r.add("spread_by_kind", "SELECT o_orderpriority, round(stddev_pop(o_totalprice), 2) AS sd_pop, round(stddev_samp(o_totalprice), 2) AS sd_samp, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1")
def spread_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.round(F.stddev_pop("o_totalprice"), 2).alias("sd_pop"), F.round(F.stddev_samp("o_totalprice"), 2).alias("sd_samp"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


@_r.add(
    "top_members_array",
    """WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k FROM n)
    SELECT user_id, string_agg(event_type, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top3, count(*) AS kinds FROM r GROUP BY user_id""",
)
def top_members_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    ordered = agg.ordered_values(F.col("event_type"), [-F.col("c"), F.col("event_type")])
    return n.groupBy("user_id").agg(F.array_join(F.slice(ordered, 1, 3), ",").alias("top3"), F.count(F.lit(1)).alias("kinds"))


@_r.add("distinct_strings", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS kinds, string_agg(DISTINCT event_type, '|' ORDER BY event_type) FILTER (WHERE value > 80) AS high_kinds FROM events GROUP BY user_id")
def distinct_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(c):
        return F.nullif(F.array_join(F.array_sort(F.collect_set(c)), "|"), F.lit(""))

    return table(spark, sf_dir, "events").groupBy("user_id").agg(joined(F.col("event_type")).alias("kinds"), joined(F.when(F.col("value") > 80, F.col("event_type"))).alias("high_kinds"))


@_r.add("session_top_type", "WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) SELECT user_id, event_type AS top_type, c AS times FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) = 1")
def session_top_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mode_per_key(table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", F.col("event_type").alias("top_type"), F.col("n").alias("times"))


@_r.add(
    "json_timeline",
    "SELECT o_custkey, '[' || string_agg('{\"d\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"k\":' || o_orderkey || '}', ',' ORDER BY o_orderdate, o_orderkey) || ']' AS timeline FROM orders GROUP BY o_custkey",
)
def json_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderkey").alias("k"))
    return o.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("timeline"))


@_r.add("having_filter", "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND avg(l_discount) > 0.04")
def having_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.avg("l_discount").alias("d"))
    return g.filter("n >= 3 and d > 0.04").drop("d")


@_r.add("ratio_aggregates", "SELECT role, round(sum(CASE WHEN text LIKE '%?%' THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS question_ratio, round(avg(CASE WHEN length(text) > 400 THEN 1.0 ELSE 0.0 END), 6) AS long_ratio FROM conversations GROUP BY role")
def ratio_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.round(F.avg(F.col("text").contains("?").cast("double")), 6).alias("question_ratio"), F.round(F.avg((F.char_length("text") > 400).cast("double")), 6).alias("long_ratio"))


@_r.add(
    "two_level_dominance",
    """WITH p AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT *, q / sum(q) OVER (PARTITION BY l_orderkey) AS share FROM p)
    SELECT l_suppkey, count(*) AS orders, round(avg(share), 6) AS dominance FROM t GROUP BY l_suppkey""",
)
def two_level_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.mean_share(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity").select("l_suppkey", F.col("groups").alias("orders"), F.round("mean_share", 6).alias("dominance"))


@_r.add("duplicate_groups", "SELECT p_name, count(*) AS copies, min(p_partkey) AS first_key FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.duplicates(table(spark, sf_dir, "part"), ["p_name"], "p_partkey").select("p_name", F.col("n").alias("copies"), F.col("first").alias("first_key"))


@_r.add("independent_counts", "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS filled, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT round(sum(value), 2) FROM events) AS total")
def independent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [
        table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers")),
        table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("filled")),
        table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total")),
    ]
    return one[0].join(one[1]).join(one[2])  # one row each


@_r.add("time_shares", "SELECT user_id, round(avg(CASE WHEN extract(hour FROM ts) < 6 THEN 1.0 ELSE 0.0 END), 6) AS night, round(avg(CASE WHEN extract(dow FROM ts) IN (0, 6) THEN 1.0 ELSE 0.0 END), 6) AS weekend FROM events GROUP BY user_id")
def time_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.round(F.avg((F.hour("ts") < 6).cast("double")), 6).alias("night"), F.round(F.avg(F.dayofweek("ts").isin(1, 7).cast("double")), 6).alias("weekend"))


@_r.add("home_anchor", "WITH n AS (SELECT user_id, event_type AS place, count(*) AS nights FROM events WHERE extract(hour FROM ts) >= 22 OR extract(hour FROM ts) < 6 GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY nights DESC, place) = 1")
def home_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    night = table(spark, sf_dir, "events").filter((F.hour("ts") >= 22) | (F.hour("ts") < 6))
    return agg.mode_per_key(night, ["user_id"], "event_type").select("user_id", F.col("event_type").alias("place"), F.col("n").alias("nights"))


@_r.add(
    "frequency_tables",
    "WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS place FROM n WHERE n >= 3) SELECT p_brand, p_type, n, place FROM r WHERE place <= 5",
)
def frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.top_values(table(spark, sf_dir, "part"), ["p_brand"], "p_type", 5, 3).select("p_brand", "p_type", "n", F.col("place").cast("long").alias("place"))


@_r.add("calendar_groups", "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(dow FROM o_orderdate) AS BIGINT) AS dow, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2, 3")
def calendar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    keys = [F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), (F.dayofweek("o_orderdate") - 1).cast("long").alias("dow")]
    return o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_r.add(
    "co_membership_pairs",
    "SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS together, CAST(min(a.l_shipdate) AS DATE) AS first_seen, CAST(max(a.l_shipdate) AS DATE) AS last_seen FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2",
)
def co_membership_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.co_members(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_shipdate").filter("together >= 2")


_PRICES = [("click", 0.5), ("view", 0.1), ("purchase", 3.0), ("signup", 1.0)]


@_r.add(
    "usage_cost_rollup",
    f"""WITH prices(kind, price) AS (VALUES {", ".join(f"('{k}', {p})" for k, p in _PRICES)})
    SELECT event_type, count(*) AS calls, round(sum(value), 3) AS tokens, round(sum(value * coalesce(price, 0.2)) / 1000, 3) AS cost, count(*) FILTER (WHERE value > 90) AS slow, round(max(value), 3) AS worst,
    round(sum(value * coalesce(price, 0.2)) / 1000, 3) >= 0.8 AS over_budget FROM events LEFT JOIN prices ON kind = event_type GROUP BY event_type""",
)
def usage_cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "event_type string, price double")
    e = table(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left")
    cost = F.round(F.sum(F.col("value") * F.coalesce("price", F.lit(0.2))) / 1000, 3)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 3).alias("tokens"), cost.alias("cost"), F.count_if(F.col("value") > 90).alias("slow"), F.round(F.max("value"), 3).alias("worst"), (cost >= 0.8).alias("over_budget"))


@_r.add("value_profile", "SELECT 'p_brand' AS col, count(DISTINCT p_brand) AS n, CASE WHEN count(DISTINCT p_brand) <= 30 THEN string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) END AS vals FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type), CASE WHEN count(DISTINCT p_type) <= 30 THEN string_agg(DISTINCT p_type, ',' ORDER BY p_type) END FROM part")
def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.value_profile(table(spark, sf_dir, "part"), ["p_brand", "p_type"], 30)


@_r.add(
    "next_unenriched",
    """SELECT c_custkey, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey AND x.o_orderpriority = '1-URGENT')
    AND c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY n DESC, c_custkey LIMIT 5""",
)
def next_unenriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    open_ = c.filter("c_mktsegment <> 'BUILDING'").select("c_custkey").join(urgent, "c_custkey", "left_anti")
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return open_.join(n, "c_custkey").orderBy(F.desc("n"), "c_custkey").limit(5)


@_r.add("feedback_rates", "SELECT o_orderpriority, count(*) AS decisions, round(count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1), 4) AS approval, round(count(*) FILTER (WHERE o_orderstatus = 'P') / greatest(count(*), 1), 4) AS pending FROM orders GROUP BY 1")
def feedback_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("decisions"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 4).alias("approval"), F.round(F.avg((F.col("o_orderstatus") == "P").cast("double")), 4).alias("pending"))


@_r.add("eval_summary", "SELECT event_type AS scorer, CAST(ts AS DATE) AS period, round(avg(value / 100), 4) AS mean, round(min(value / 100), 4) AS worst, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value is not null")
    return e.groupBy(F.col("event_type").alias("scorer"), F.to_date("ts").alias("period")).agg(F.round(F.avg(F.col("value") / 100), 4).alias("mean"), F.round(F.min(F.col("value") / 100), 4).alias("worst"), F.count(F.lit(1)).alias("n"))


