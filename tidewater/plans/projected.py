"""Projections, predicates, scalar functions, import readers, de-duplication and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import classify, identifiers, similarity, stats
from tidewater.plans.base import Registry, table
from tidewater.sources import files, normalise, sinks

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add("text_assembly", "SELECT p_partkey, coalesce(p_name, '') || ': ' || coalesce(left(p_type, 6), '') || coalesce(' — ' || CASE WHEN p_size > 25 THEN p_brand END, '') AS text FROM part")
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.concat(F.lit(" — "), F.when(F.col("p_size") > 25, F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.coalesce("p_name", F.lit("")), F.lit(": "), F.coalesce(F.left("p_type", F.lit(6)), F.lit("")), F.coalesce(suffix, F.lit(""))).alias("text"))


@_r.add("prefix_classes", "SELECT CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type ILIKE '%steel' THEN 'steel' WHEN p_name ILIKE 'a%' THEN 'a-name' ELSE 'other' END AS class, count(*) AS n FROM part GROUP BY 1")
def prefix_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("p_type").startswith("PROMO"), "promo").when(F.col("p_type").ilike("%steel"), "steel").when(F.col("p_name").ilike("a%"), "a-name").otherwise("other")
    return table(spark, sf_dir, "part").groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


_H = "extract(hour FROM ts)"


@_r.add(
    "day_parts",
    f"""SELECT CASE WHEN {_H} BETWEEN 6 AND 11 THEN 'morning' WHEN {_H} BETWEEN 12 AND 17 THEN 'afternoon' WHEN {_H} BETWEEN 18 AND 22 THEN 'evening' ELSE 'night' END AS a, CASE WHEN {_H} BETWEEN 6 AND 11 THEN 'morning' WHEN {_H} BETWEEN 12 AND 17 THEN 'afternoon' WHEN {_H} BETWEEN 18 AND 23 THEN 'evening' ELSE 'night' END AS b,
    CASE WHEN {_H} < 6 THEN 'night' WHEN {_H} < 12 THEN 'morning' WHEN {_H} < 17 THEN 'afternoon' WHEN {_H} < 21 THEN 'evening' ELSE 'night' END AS c, count(*) AS n FROM events GROUP BY 1, 2, 3""",
)
def day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.hour("ts")
    return table(spark, sf_dir, "events").groupBy(classify.day_part(h).alias("a"), classify.day_part_late(h).alias("b"), classify.day_part_early(h).alias("c")).agg(F.count(F.lit(1)).alias("n"))


@_r.add("regex_filters", "SELECT doc_id, regexp_matches(text, '(?i)license') AS licensed, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS numbered FROM documents WHERE regexp_matches(text, '(?i)license|[0-9]{3}-[0-9]{4}') AND NOT regexp_matches(text, '!!')")
def regex_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("(?i)license|[0-9]{3}-[0-9]{4}") & ~F.col("text").rlike("!!"))
    return d.select("doc_id", F.col("text").rlike("(?i)license").alias("licensed"), F.col("text").rlike("[0-9]{3}-[0-9]{4}").alias("numbered"))


@_r.add("guarded_casts", "SELECT doc_id, try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS number, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN CAST(right(source, 1) AS BIGINT) END AS digit FROM documents")
def guarded_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long").alias("number"), F.when(F.col("source").rlike("^src[0-9]$"), F.right("source", F.lit(1)).cast("long")).alias("digit"))


@_r.add("json_extraction", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' IS NOT NULL AS has_missing FROM events WHERE props->>'$.k' IS NOT NULL")
def json_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").filter(k.isNotNull()).select("event_id", k.alias("k"), F.get_json_object("props", "$.missing").isNotNull().alias("has_missing"))


@_r.add("null_safe_match", "SELECT a.c_nationkey AS nation, count(*) AS n FROM (SELECT nullif(c_nationkey, 3) AS c_nationkey FROM customer) a JOIN (SELECT DISTINCT nullif(s_nationkey, 3) AS k FROM supplier) b ON a.c_nationkey IS NOT DISTINCT FROM b.k GROUP BY 1")
def null_safe_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"))
    b = table(spark, sf_dir, "supplier").select(F.nullif(F.col("s_nationkey"), F.lit(3)).alias("k")).distinct()
    return a.join(b, F.col("nation").eqNullSafe(F.col("k"))).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@_r.add("array_membership", "WITH t AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1) SELECT user_id, list_contains(kinds, 'error') AS has_error, list_has_any(kinds, ['signup', 'purchase']) AS has_goal, CAST(len(kinds) AS BIGINT) AS n FROM t")
def array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return t.select("user_id", F.array_contains("kinds", "error").alias("has_error"), F.arrays_overlap("kinds", F.array(F.lit("signup"), F.lit("purchase"))).alias("has_goal"), F.size("kinds").cast("long").alias("n"))


@_r.add("grid_cells", "SELECT round(40 + floor(value) / 100, 2) || ',' || round(-74 - floor(value) / 50, 2) AS cell, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = classify.grid_cell(40 + F.floor("value") / 100, -74 - F.floor("value") / 50)
    return table(spark, sf_dir, "events").filter("value is not null").groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")).filter("n >= 2")


@_r.add("sensor_hygiene", "SELECT event_type, count(*) FILTER (WHERE value IS NULL OR value = 0) AS empty, count(*) FILTER (WHERE value * 12 > 1000) AS inaccurate, count(*) AS n FROM events GROUP BY 1")
def sensor_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    bad = classify.bad_location(F.lit(1.0), F.lit(1.0), v * 12)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v.isNull() | (v == 0)).alias("empty"), F.count_if(bad).alias("inaccurate"), F.count(F.lit(1)).alias("n"))


@_r.add("content_router", "SELECT CASE WHEN source = 'src1' THEN CASE WHEN length(text) > 2000 THEN 'long_mail' ELSE 'mail' END WHEN doc_id % 5 > 1 THEN 'conversation' WHEN length(text) > 5000 THEN 'document' ELSE 'note' END AS class, count(*) AS n FROM documents GROUP BY 1")
def content_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    c = classify.content_class(F.when(F.col("source") == "src1", "email").otherwise("other"), F.lit("text/plain"), F.char_length("text"), F.col("doc_id") % 5)
    return d.groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@_r.add("latest_period", "SELECT o_orderkey, o_custkey FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("m", F.date_trunc("month", "o_orderdate"))
    return o.join(F.broadcast(o.agg(F.max("m").alias("m"))), "m", "left_semi").select("o_orderkey", "o_custkey")


@_r.add(
    "multi_flag_score",
    """WITH f AS (SELECT c_custkey, (c_acctbal > 0)::INT + EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)::INT + EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)::INT + EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)::INT AS score FROM customer)
    SELECT c_custkey, score FROM f WHERE score >= 2""",
)
def multi_flag_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).cast("int").alias("score"))
    flags = [("orders", "c_custkey", "o_custkey", None), ("events", "c_custkey", "user_id", None), ("supplier", "c_nationkey", "s_nationkey", "s_acctbal < 0")]
    for name, mine, theirs, condition in flags:
        t = table(spark, sf_dir, name)
        t = (t.filter(condition) if condition else t).select(F.col(theirs).alias(mine)).distinct().withColumn("f", F.lit(1))
        c = c.join(t, mine, "left").withColumn("score", F.col("score") + F.coalesce("f", F.lit(0))).drop("f")
    return c.filter("score >= 2").select("c_custkey", "score")


@_r.add("category_thresholds", "SELECT event_id, round(value, 4) AS value FROM events WHERE value >= CASE event_type WHEN 'click' THEN 95 WHEN 'error' THEN 80 ELSE 99 END")
def category_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = classify.threshold(F.col("event_type"), {"click": 95.0, "error": 80.0}, 99.0)
    return table(spark, sf_dir, "events").filter(F.col("value") >= limit).select("event_id", F.round("value", 4).alias("value"))


@_r.add("look_ahead", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-15 13:00:00' AND TIMESTAMP '2024-01-15 13:30:00'")
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").filter(F.col("ts").between(at + F.expr("interval 60 minutes"), at + F.expr("interval 90 minutes"))).select("event_id")


@_r.add(
    "keyword_alerts",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, text || CASE conv_id % 9 WHEN 0 THEN ' this is Urgent.' WHEN 1 THEN ' sos' WHEN 2 THEN ' call 911' WHEN 3 THEN ' 9112' WHEN 4 THEN ' insurgent' ELSE '' END AS text FROM conversations) WHERE regexp_matches(text, '(?i)\\b911\\b') OR regexp_matches(text, '\\bSOS\\b') OR regexp_matches(text, '(?i)\\bemergency\\b') OR regexp_matches(text, '(?i)\\burgent\\b')",
)
def keyword_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id") % 9
    said = F.when(k == 0, " this is Urgent.").when(k == 1, " sos").when(k == 2, " call 911").when(k == 3, " 9112").when(k == 4, " insurgent").otherwise("")
    return table(spark, sf_dir, "conversations").filter(classify.matches_any(F.concat("text", said), list(classify.URGENT))).select("conv_id", "turn")


_FORMS = ", ".join(f"nullif(trim(regexp_extract(text, '(?i){f}', 0)), '')" for f in classify.DELIVERY_TIMES)


@_r.add(
    "delivery_windows",
    f"""WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Package today between ' || event_id % 12 || ' and 5 PM' WHEN 1 THEN 'your order: 1pm - ' || event_id % 12 || ':30 pm' WHEN 2 THEN 'Arriving by 3:00 PM' WHEN 3 THEN 'lunch by 3 pm' WHEN 4 THEN 'delivery window: 1am to 4am' WHEN 5 THEN 'shipped' END AS text FROM events)
    SELECT event_id, CASE WHEN list_bool_or(list_transform({list(classify.DELIVERY_WORDS)}, lambda w: contains(lower(text), w))) THEN coalesce({_FORMS}) END AS delivery FROM t""",
)
def delivery_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("Package today between "), k % 12, F.lit(" and 5 PM")))
        .when(k % 7 == 1, F.concat(F.lit("your order: 1pm - "), k % 12, F.lit(":30 pm")))
        .when(k % 7 == 2, "Arriving by 3:00 PM").when(k % 7 == 3, "lunch by 3 pm").when(k % 7 == 4, "delivery window: 1am to 4am").when(k % 7 == 5, "shipped")
    )
    return e.select("event_id", classify.delivery_window(text).alias("delivery"))


# --- scalar functions


@_r.add(
    "string_functions",
    "SELECT p_partkey, left(p_name, 3) AS l, length(p_name) AS n, lower(p_type) AS lo, trim('  ' || p_brand || ' ') AS t, replace(p_name, 'a', 'A') AS r, split_part(p_type, ' ', 1) AS s, regexp_replace(p_brand, '[^0-9]', '', 'g') AS d, nullif(p_brand, 'Brand#11') AS nn FROM part",
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.left("p_name", F.lit(3)).alias("l"), F.char_length("p_name").cast("long").alias("n"), F.lower("p_type").alias("lo"), F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("t"), F.replace("p_name", F.lit("a"), F.lit("A")).alias("r"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("s"), F.regexp_replace("p_brand", "[^0-9]", "").alias("d"), F.nullif("p_brand", F.lit("Brand#11")).alias("nn"),
    )


@_r.add(
    "phone_forms",
    """WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '(555) ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-1234' WHEN 1 THEN '1-555-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-4321' WHEN 2 THEN '+44 20 ' || c_custkey ELSE 'chat' || c_custkey END AS raw FROM customer),
    d AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM p)
    SELECT c_custkey, CASE WHEN length(g) >= 7 THEN right(g, 10) END AS last10, CASE WHEN length(g) = 11 AND g LIKE '1%' THEN substr(g, 2, 10) ELSE g END AS nat, CASE WHEN raw LIKE '+%' THEN '+' || g WHEN length(g) = 10 THEN '+1' || g WHEN length(g) = 11 AND g LIKE '1%' THEN '+' || g ELSE raw END AS e164 FROM d""",
)
def phone_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, three = F.col("c_custkey"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("(555) "), three, F.lit("-1234"))).when(k % 4 == 1, F.concat(F.lit("1-555-"), three, F.lit("-4321"))).when(k % 4 == 2, F.concat(F.lit("+44 20 "), k)).otherwise(F.concat(F.lit("chat"), k))
    return table(spark, sf_dir, "customer").select("c_custkey", identifiers.phone_last10(raw).alias("last10"), identifiers.phone_national(raw).alias("nat"), identifiers.phone_e164(raw).alias("e164"))


@_r.add("calendar_functions", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso_week, CAST(extract(dow FROM o_orderdate) AS INT) AS dow, CAST(extract(hour FROM o_orderdate) AS INT) AS h, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders")
def calendar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    key = stats.iso_week(d)
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("iso_week"), (F.dayofweek(d) - 1).alias("dow"), F.hour("o_orderdate").alias("h"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("epoch"), stats.iso_week_monday(key).alias("monday"))


@_r.add(
    "math_functions",
    "SELECT event_id, CAST(floor(value + 0.5) AS DOUBLE) AS js, round(greatest(value, 50), 6) AS g, round(sqrt(abs(value - 50)) + power(value / 100, 2), 6) AS m, round(degrees(asin(least(1.0, value / 100))), 6) AS a FROM events WHERE value IS NOT NULL",
)
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").filter("value is not null").select("event_id", stats.js_round(v).alias("js"), F.round(F.greatest(v, F.lit(50.0)), 6).alias("g"), F.round(F.sqrt(F.abs(v - 50)) + F.pow(v / 100, 2), 6).alias("m"), F.round(F.degrees(F.asin(F.least(F.lit(1.0), v / 100))), 6).alias("a"))


@_r.add("daylight", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT date, radians(23.45 * sin(radians(360 / 365 * (extract(doy FROM date) + 284)))) AS decl FROM d) SELECT date, round(2 * degrees(acos(greatest(-1.0, least(1.0, -tan(radians(40.7)) * tan(decl))))) / 15, 5) AS hours FROM r")
def daylight(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return d.select("date", F.round(stats.daylight_hours(F.dayofyear("date"), F.lit(40.7)), 5).alias("hours"))


@_r.add("array_functions", "WITH t AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(len(a) AS BIGINT) AS n, CAST(a[1] AS BIGINT) AS first, array_to_string(a[1:3], ',') AS head, list_contains(a, 5) AS has5 FROM t")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return t.select("l_orderkey", F.size("a").cast("long").alias("n"), F.get("a", F.lit(0)).cast("long").alias("first"), F.array_join(F.slice(F.transform("a", lambda x: x.cast("string")), 1, 3), ",").alias("head"), F.array_contains("a", 5).alias("has5"))


@_r.add("record_hash", "SELECT p_partkey, sha256(p_name || '|' || p_brand) AS h, CAST(ceil(length(p_name) / 4.0) AS BIGINT) AS tokens FROM part")
def record_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("h"), classify.tokens_estimate(F.col("p_name")).alias("tokens"))


# --- import readers, de-duplication, normalisers, upserts


@_r.add(
    "html_records",
    """WITH b AS (SELECT page_id, string_split_regex(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)</?(?:p|div|li|tr|h[1-6]|article|section|ul|ol|table|br)\\b[^>]*>') AS parts FROM pages),
    t AS (SELECT page_id, list_filter(list_transform(parts, lambda p: left(trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 2000)), lambda t: length(t) > 20) AS texts FROM b) SELECT page_id, CAST(generate_subscripts(texts, 1) - 1 AS INT) AS place, unnest(texts) AS text FROM t""",
)
def html_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(files.html_blocks(F.col("html"))).alias("place", "text"))


@_r.add("text_records", "SELECT doc_id, count(*) AS blocks, CAST(sum(length(b)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS b FROM documents) WHERE length(b) > 10 GROUP BY 1")
def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))  # one blank line between lines
    return d.select("doc_id", F.explode(files.text_blocks(F.col("text"))).alias("b")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.char_length("b")).alias("chars"))


@_r.add("exact_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS h, count(*) AS copies FROM documents GROUP BY sha256(text)")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@_r.add(
    "ingested_records",
    """SELECT 'message' AS source_key, conv_id || ':' || turn AS source_id, 'message' AS category, left(text, 120) AS summary, length(text)::BIGINT AS chars FROM conversations
    UNION ALL SELECT 'social', event_id::VARCHAR, 'social', CASE WHEN event_type = 'click' THEN 'Comment in c' || user_id ELSE 'post ' || event_id END, 0 FROM events
    UNION ALL SELECT 'email', 'o' || o_orderkey, 'email', coalesce(CASE WHEN o_orderkey % 7 > 0 THEN 'Order ' || o_orderkey END, '(no subject)'), 5 FROM orders WHERE o_orderkey % 5 > 0
    UNION ALL SELECT 'calendar', 'p' || p_partkey, 'event', coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_name END, '(untitled)'), length(p_type)::BIGINT FROM part
    UNION ALL SELECT 'photo', 's' || s_suppkey, 'photo', 'Photo with ' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' at n' || s_nationkey ELSE '' END, 0 FROM supplier
    UNION ALL SELECT 'annotation', 'c' || c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'health' WHEN 1 THEN 'location' ELSE 'activity' END, c_name, length(c_name)::BIGINT FROM customer
    UNION ALL SELECT 'location', 'l' || c_custkey, 'location', 'At ' || CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey ELSE printf('%.4f,%.4f', (c_custkey % 120)::DOUBLE, (-c_custkey % 180)::DOUBLE) END, 0 FROM customer WHERE c_custkey % 120 <= 90 AND c_custkey % 700 <= 500
    UNION ALL SELECT 'visit', 'v' || o_orderkey, 'location', 'Stayed at c' || o_custkey || CASE WHEN o_orderkey % 3 > 0 THEN ' for ' || (o_orderkey % 100) || ' min' ELSE '' END, 0 FROM orders
    UNION ALL SELECT 'health', 'h' || p_partkey, 'health', 'steps ' || CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || ' n', 0 FROM part""",
)
def ingested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, p, s, k = (table(spark, sf_dir, t) for t in ("conversations", "orders", "part", "supplier", "customer"))
    none = F.lit(None).cast("string")
    day = F.lit("2024-01-01").cast("timestamp")
    messages = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), day.alias("ts"), F.col("role").alias("sender"), F.col("conv_id").cast("string").alias("chat"), "text")
    e = table(spark, sf_dir, "events")
    posts = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "comment").otherwise("post").alias("tag"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_utc"), F.concat(F.lit("post "), "event_id").alias("title"), none.alias("body"), F.col("user_id").cast("string").alias("author"), F.concat(F.lit("c"), "user_id").alias("community"))
    key = F.col("o_orderkey")
    mails = o.select(none.alias("id"), F.concat(F.lit("o"), key).alias("message_id"), F.when(key % 7 > 0, F.concat(F.lit("Order "), key)).alias("subject"), F.when(key % 5 == 0, "news@no-reply.org").otherwise("a@b.org").alias("sender"), F.array(F.lit("c@d.org")).alias("recipients"), F.col("o_orderdate").cast("timestamp").alias("date"), day.alias("received_at"), none.alias("body"), F.lit("short").alias("snippet"))
    at = F.struct(F.lit("2024-01-01T10:00:00").alias("dateTime"), none.alias("date"))
    meetings = p.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_name")).alias("summary"), F.col("p_type").alias("description"), at.alias("start"), at.alias("end"), none.alias("location"), F.array(F.struct(F.lit("x@y.org").alias("email"), none.alias("displayName"))).alias("attendees"))
    photos = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), day.alias("taken_at"), F.array(F.col("s_name"), F.lit("_UNKNOWN_1")).alias("persons"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), "s_nationkey")).alias("place"), none.alias("description"))
    number = F.col("c_custkey")
    note = F.struct(F.when(number % 3 == 0, "health_note").when(number % 3 == 1, "location_note").otherwise("memo").alias("kind"), F.col("c_name").alias("note_text"), day.alias("recorded_at"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), none.alias("place_label"), F.array(F.lit("t")).alias("tags"))
    notes = k.select(F.concat(F.lit("c"), number).alias("id"), day.alias("produced_at"), note.alias("payload"))
    places = k.select(F.concat(F.lit("l"), number).alias("id"), day.alias("recorded_at"), (number % 120).alias("latitude"), (-number % 180).alias("longitude"), (number % 700).alias("accuracy"), F.when(number % 2 == 0, F.concat(F.lit("n"), "c_nationkey")).alias("place"))
    stays = o.select(F.concat(F.lit("v"), key).alias("id"), day.alias("arrived"), F.when(key % 3 > 0, F.timestamp_seconds(F.unix_timestamp(day) + 60 * (key % 100) + 30)).alias("departed"), F.concat(F.lit("c"), "o_custkey").alias("place"))
    steps = p.select(F.concat(F.lit("h"), "p_partkey").alias("id"), F.lit("steps").alias("type"), F.lit("n").alias("unit"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('{"count": '), "p_size", F.lit(', "max": 99}'))).alias("value"), day.alias("start_date"))
    twice = messages.union(messages.limit(20))  # twenty come twice
    r = normalise.ingest({"message": twice, "social": posts, "email": mails, "calendar": meetings, "photo": photos, "annotation": notes, "location": places, "visit": stays, "health": steps})
    return r.select("source_key", "source_id", "category", "summary", F.char_length("content").cast("long").alias("chars"))


def _daily_counts(spark: SparkSession, sf_dir: str, low: str, high: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.to_date("ts").between(low, high))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))


@_r.add("additive_upsert", "SELECT event_type, count(*) AS n, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last FROM events GROUP BY 1")
def additive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _daily_counts(spark, sf_dir, "2024-01-01", "2024-01-14"), _daily_counts(spark, sf_dir, "2024-01-15", "2024-12-31")
    return sinks.additive_upsert(old, new, ["event_type"], ["n"], [], ["first"], ["last"])


@_r.add("coalescing_upsert", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'new' END, c_mktsegment) AS segment FROM customer")
def coalescing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    new = c.filter("c_custkey % 2 = 1 or c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "new").alias("segment"))
    return sinks.coalescing_upsert(c.select("c_custkey", F.col("c_mktsegment").alias("segment")), new, ["c_custkey"])


@_r.add("replacing_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN round(p_retailprice * 2, 2) ELSE round(p_retailprice, 2) END AS price FROM part")
def replacing_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.round("p_retailprice", 2).alias("price"), "p_retailprice")
    new = p.filter("p_partkey % 5 = 0").select("p_partkey", F.round(F.col("p_retailprice") * 2, 2).alias("price"))
    return sinks.upsert(p.drop("p_retailprice"), new, ["p_partkey"])


@_r.add("retention", "SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY GROUP BY 1")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.retain(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 7).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@_r.add("bulk_update_join", "SELECT c_custkey, coalesce(v.s, c_mktsegment) AS segment FROM customer LEFT JOIN (VALUES (1, 'A'), (2, 'B')) v(k, s) ON k = c_custkey")
def bulk_update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(1, "A"), (2, "B")], "c_custkey long, s string")
    return table(spark, sf_dir, "customer").join(F.broadcast(v), "c_custkey", "left").select("c_custkey", F.coalesce("s", "c_mktsegment").alias("segment"))


@_r.add("group_batches", "SELECT CASE WHEN l_linenumber > 3 THEN 'group:' || l_suppkey ELSE 'dm:' || l_partkey % 100 END AS batch, count(*) AS n, max(l_orderkey) AS watermark FROM lineitem WHERE l_orderkey > 1000 GROUP BY 1")
def group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey > 1000")
    batch = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("group:"), "l_suppkey")).otherwise(F.concat(F.lit("dm:"), F.col("l_partkey") % 100))
    return li.groupBy(batch.alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("watermark"))


@_r.add("edit_similarity", "WITH p AS (SELECT a.s_suppkey AS a, b.n_nationkey AS b, lower(a.s_name) AS x, lower(b.n_name) AS y FROM supplier a JOIN nation b ON a.s_nationkey = b.n_nationkey) SELECT a, b, round(CASE WHEN x = y THEN 1.0 WHEN contains(x, y) OR contains(y, x) THEN 0.8 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS sim FROM p")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    return j.select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"), F.round(similarity.edit_similarity(F.col("s_name"), F.col("n_name")), 6).alias("sim"))
