"""Voices, styles and merges of persons; rules on days; zones, anniversaries, integer casts and array changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import network, pairs, resolve, statistics
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add(
    "communication_style",
    """SELECT user_id AS person, round(avg(length(props)), 4) AS mean_length, round(stddev_pop(length(props)), 4) AS length_spread, round(avg(CASE WHEN regexp_matches(event_type || CASE event_id % 3 WHEN 0 THEN '☀' ELSE '' END, '[^\\x01-\\x7F]') THEN 1.0 ELSE 0 END), 4) AS emoji, round(avg(CASE WHEN contains(props, '7') THEN 1.0 ELSE 0 END), 4) AS questions,
    round(avg(extract(hour FROM ts)), 4) AS mean_hour, round(stddev_pop(extract(hour FROM ts)), 4) AS hour_spread, round(avg(CASE WHEN extract(dow FROM ts) IN (0, 6) THEN 1.0 ELSE 0 END), 4) AS weekends, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 4) AS initiated, round(avg(value), 4) AS mood FROM events GROUP BY 1 HAVING count(*) >= 10""",
)
def communication_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine features of how a person writes."""
    e = table(spark, sf_dir, "events")
    text = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "☀").otherwise(""))
    out = network.style_features(e, "user_id", "ts", F.char_length("props"), text.rlike(r"[^\x01-\x7F]"), F.col("props").contains("7"), F.col("event_type") == "click", F.col("value"), 10)
    return out.select(F.col("user_id").alias("person"), *(F.round(c, 4).alias(c) for c in out.columns if c not in ("user_id", "messages")))


@_r.add(
    "voice_metrics",
    """WITH s AS (SELECT l_suppkey AS person, l_orderkey AS media, l_quantity AS seconds, o_orderdate AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey), p AS (SELECT person, media, sum(seconds) AS x FROM s GROUP BY 1, 2), t AS (SELECT media, sum(x) AS total FROM p GROUP BY 1), d AS (SELECT person, avg(x / total) AS dominance FROM p JOIN t ON t.media = p.media WHERE total > 0 GROUP BY 1),
    h AS (SELECT person, extract(month FROM day) AS h, count(*) AS n FROM s GROUP BY 1, 2), m AS (SELECT person, h FROM h QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, h) = 1)
    SELECT s.person, count(*) AS segments, round(sum(seconds), 2) AS speaking, round(avg(seconds), 4) AS mean_segment, count(DISTINCT media) AS conversations, round(any_value(dominance), 6) AS dominance, CAST(any_value(m.h) AS INT) AS most_active FROM s JOIN d ON d.person = s.person JOIN m ON m.person = s.person GROUP BY 1""",
)
def voice_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of recordings: times, share of each recording, and the part of the year they speak most in."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("media"), F.col("l_quantity").alias("seconds"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media"), F.month("o_orderdate").alias("part"))
    n = pairs.parts_of(li)
    out = network.voice_metrics(li.repartition(n, "media").join(o.repartition(n, "media"), "media"))
    return out.select("person", "segments", F.round("speaking", 2).alias("speaking"), F.round("mean_segment", 4).alias("mean_segment"), "conversations", F.round("dominance", 6).alias("dominance"), "most_active")


@_r.add(
    "merge_arrays",
    """WITH m AS (SELECT p_partkey AS merged, first_value(p_partkey) OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS survivor FROM part), l AS (SELECT DISTINCT l_orderkey, coalesce(survivor, l_partkey) AS member FROM lineitem LEFT JOIN m ON m.merged = l_partkey) SELECT l_orderkey, array_to_string(list(member ORDER BY member), ',') AS members FROM l GROUP BY 1""",
)
def merge_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged ids replaced within arrays of members, each member once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").alias("fact_count"), F.lit("2020-01-01").cast("date").alias("created"))
    photos = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("members"))
    out = resolve.replace_in_arrays(photos, resolve.survivors(p, ["name"]), "l_orderkey", "members")
    return out.select("l_orderkey", F.array_join(F.array_sort("members").cast("array<string>"), ",").alias("members"))


@_r.add(
    "merged_aliases",
    """WITH e AS (SELECT p_partkey AS id, p_name AS name, p_size AS f, lower(p_type) AS alias FROM part), s AS (SELECT *, first_value(id) OVER (PARTITION BY name ORDER BY f DESC, id) AS survivor FROM e)
    SELECT survivor, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases, count(*) - 1 AS merged, sum(f)::BIGINT AS facts FROM s GROUP BY 1""",
)
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surviving entities with the aliases and facts of those merged into them."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("fact_count"), F.lit("2020-01-01").cast("date").alias("created"), F.array(F.lower("p_type")).alias("aliases"))
    out = resolve.merged_entities(p, resolve.survivors(p.drop("aliases"), ["name"]))
    return out.select("survivor", F.array_join("aliases", ",").alias("aliases"), "merged", F.col("fact_count").alias("facts"))


@_r.add(
    "behaviour_rules",
    """WITH n AS (SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'view' AND extract(hour FROM ts) < 5 GROUP BY 1, 2 HAVING count(*) >= 2), d AS (SELECT CAST(ts AS DATE) AS date, user_id, sum(value) AS s FROM events GROUP BY 1, 2),
    a AS (SELECT *, avg(s) OVER (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS m FROM d) SELECT user_id, date, 'late_night' AS rule, n::DOUBLE AS actual, NULL::DOUBLE AS expected FROM n UNION ALL SELECT user_id, date, 'spike', round(s, 6), round(m, 6) FROM a WHERE m > 0 AND s > 2 * m""",
)
def behaviour_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules beyond scores: much activity at night, and days of over twice the mean of the 30 days before."""
    e = table(spark, sf_dir, "events")
    night = e.filter((F.col("event_type") == "view") & (F.hour("ts") < 5)).groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    night = night.select("user_id", "date", F.lit("late_night").alias("rule"), F.col("n").cast("double").alias("actual"), F.lit(None).cast("double").alias("expected"))
    daily = e.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))
    spikes = statistics.spikes(daily, ["user_id"]).select("user_id", "date", F.lit("spike"), F.round("value", 6), F.round("mean", 6))
    return night.union(spikes)


@_r.add(
    "resolved_anomalies",
    """WITH a AS (SELECT event_id AS id, 'm' || user_id % 60 AS metric, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error') SELECT id, metric, date FROM a WHERE date < DATE '2024-01-28' AND NOT EXISTS (SELECT 1 FROM a b WHERE b.metric = a.metric AND b.date >= DATE '2024-01-28')""",
)
def resolved_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open anomalies older than three days whose metric has had none since."""
    a = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"), F.concat(F.lit("m"), F.col("user_id") % 60).alias("metric"), F.to_date("ts").alias("date"))
    return statistics.resolved(a, F.lit("2024-01-31").cast("date"), 3)


#: From 1987 to 2006 New York was four hours behind from 2 o'clock on the first Sunday of April to 2 o'clock on the last Sunday of October, else five.
_SUMMER = "t >= make_date(y, 4, 1) + CAST((7 - dayofweek(make_date(y, 4, 1))) % 7 AS INT) + INTERVAL 7 HOUR AND t < make_date(y, 10, 31) - CAST(dayofweek(make_date(y, 10, 31)) AS INT) + INTERVAL 6 HOUR"


@_r.add(
    "zone_parts",
    f"""WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS t, extract(year FROM o_orderdate) AS y FROM orders), z AS (SELECT o_orderkey, t - INTERVAL 1 HOUR * CASE WHEN {_SUMMER} THEN 4 ELSE 5 END AS l FROM o)
    SELECT o_orderkey, CAST(l AS DATE) AS day, CAST(extract(hour FROM l) AS INT) AS hour FROM z""",
)
def zone_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and hour where a person lives, of times in UTC, over seven years of summer times."""
    at = F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), at)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(local).alias("day"), F.hour(local).alias("hour"))


@_r.add("on_this_day", "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS year, count(*) AS orders, round(max(o_totalprice), 2) AS largest FROM orders WHERE extract(month FROM o_orderdate) = 3 AND extract(day FROM o_orderdate) = 14 AND extract(year FROM o_orderdate) < 2001 GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def on_this_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five earlier years with records of a day of the year."""
    d = F.col("o_orderdate")
    o = table(spark, sf_dir, "orders").filter((F.month(d) == 3) & (F.dayofmonth(d) == 14) & (F.year(d) < 2001))
    return o.groupBy(F.year(d).alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.max("o_totalprice"), 2).alias("largest")).orderBy(F.desc("year")).limit(5)


@_r.add("integer_casts", "SELECT event_id, CAST(CASE WHEN h - floor(h) = 0.5 THEN 2 * round(h / 2) ELSE round(h) END AS BIGINT) AS even, CAST(round(CAST(h AS DECIMAL(18, 3))) AS BIGINT) AS away FROM (SELECT event_id, floor(value * 2) / 2 - 25 AS h FROM events WHERE value IS NOT NULL)")
def integer_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floating numbers to integers with halves to the even one, decimal numbers with halves away from zero."""
    h = F.floor(F.col("value") * 2) / 2 - 25
    e = table(spark, sf_dir, "events").filter("value is not null")
    return e.select("event_id", stats.half_even(h).alias("even"), stats.half_away(h.cast("decimal(18,3)")).alias("away"))


@_r.add("array_changes", "WITH t AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(a, lambda x: CASE WHEN x = 2 THEN 20 ELSE x END), ',') AS replaced, array_to_string(list_append(a, 99), ',') AS appended, array_to_string(list_concat(a, [7, 8]), ',') AS joined, array_to_string(list_filter(a, lambda x: x <> 1), ',') AS removed FROM t")
def array_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return t.select(
        "l_orderkey", text(F.transform("a", lambda x: F.when(x == 2, 20).otherwise(x))).alias("replaced"), text(F.array_append("a", 99)).alias("appended"),
        text(F.concat("a", F.array(F.lit(7), F.lit(8)))).alias("joined"), text(F.array_remove("a", 1)).alias("removed"),
    )
