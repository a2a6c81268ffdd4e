"""Joins: outer, semi and anti in all their forms, ordered pairs, proximity, lags, intervals, laterals, fuzzy and staged lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import similarity
from tidewater.operators import intervals, joins, pairs
from tidewater.plans.base import Registry, grams_sql, jaccard_sql, name_similarity_sql, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


@_r.add("inner_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("t"))  # shrinks before it meets the dimensions
    return per.join(c, per.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@_r.add("left_outer", "SELECT c_custkey, count(o_orderkey) AS orders, coalesce(round(max(o_totalprice), 2), 0) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"), F.max("o_totalprice").alias("m"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("orders"), F.coalesce(F.round("m", 2), F.lit(0.0)).alias("largest"))


@_r.add(
    "date_spine_fill",
    """WITH d AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY)),
    e AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 3) AS total FROM events GROUP BY 1)
    SELECT d.date, coalesce(clicks, 0) AS clicks, coalesce(errors, 0) AS errors, total FROM d LEFT JOIN e ON d.date = e.date""",
)
def date_spine_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))).alias("date"))
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 3).alias("total"))
    return spine.join(e, "date", "left").select("date", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("errors", F.lit(0)).alias("errors"), "total")


@_r.add("anti_left_null", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01' WHERE o_orderkey IS NULL")
def anti_left_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(recent, "c_custkey", "left_anti")


@_r.add("anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_quantity > 45)")
def anti_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45 and l_partkey is not null").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


@_r.add("anti_not_exists", "SELECT s_suppkey, s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_returnflag = 'R' AND l.l_discount > 0.09 AND l.l_quantity > 48)")
def anti_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_discount > 0.09 and l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").join(bad, "s_suppkey", "left_anti")


@_r.add("anti_processed", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND (l.quality = 1) = (d.lang = 'en'))")
def anti_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("k"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("k"))
    return d.join(done, ["doc_id", "k"], "left_anti").drop("k")


@_r.add("semi_exists", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(toxic, "doc_id", "left_semi")


@_r.add("ordered_pairs", "SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 5")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("c"))
    met = pairs.within(li, ["l_orderkey"], "l_suppkey", ["c"], by_pair=True)
    return met.groupBy("a", "b").agg(F.sum(F.col("c_a") * F.col("c_b")).alias("n")).filter("n >= 5")


@_r.add(
    "temporal_proximity_edges",
    "SELECT least(a.user_id, b.user_id) AS a, greatest(a.user_id, b.user_id) AS b, count(*) AS times FROM events a JOIN events b ON a.event_id < b.event_id AND a.user_id <> b.user_id AND abs(epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts))) <= 300 GROUP BY 1, 2 HAVING count(*) >= 3",
)
def temporal_proximity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.often_near(table(spark, sf_dir, "events"), "user_id", "ts", 300, 3)


@_r.add(
    "near_dup_trigram",
    f"""WITH n AS (SELECT DISTINCT p_name AS name, {grams_sql("p_name")} AS g FROM part), s AS (SELECT a.name, b.name AS other, {jaccard_sql("a.g", "b.g")} AS sim FROM n a JOIN n b ON a.name < b.name) SELECT name, other, round(sim, 6) AS sim FROM s WHERE sim > 0.6""",
)
def near_dup_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.similar_names(table(spark, sf_dir, "part"), "p_name", 0.6).withColumn("sim", F.round("sim", 6))


@_r.add(
    "top1_fuzzy_match",
    f"""WITH a AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), b AS (SELECT DISTINCT p_name AS match FROM part), x AS (SELECT name, {grams_sql("name")} AS g FROM a), y AS (SELECT match, {grams_sql("match")} AS g FROM b),
    s AS (SELECT name, match, {jaccard_sql("x.g", "y.g")} AS sim FROM x, y) SELECT name, match, round(sim, 6) AS sim FROM s WHERE sim > 0.4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(sim, 9) DESC, match) = 1""",
)
def top1_fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return joins.best_match(p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name")), p.select(F.col("p_name").alias("match")), 0.4).withColumn("sim", F.round("sim", 6))


@_r.add(
    "shared_identifier_pairs",
    """WITH ids AS (SELECT c_custkey AS id, right(regexp_replace(c_name, '[^0-9]', '', 'g'), 3) AS key FROM customer UNION ALL SELECT c_custkey, c_mktsegment || c_nationkey FROM customer WHERE c_acctbal > 9500)
    SELECT a.id AS a, b.id AS b, count(*) AS shared FROM (SELECT DISTINCT * FROM ids) a JOIN (SELECT DISTINCT * FROM ids) b ON a.key = b.key AND a.id < b.id GROUP BY 1, 2""",
)
def shared_identifier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ids = c.select(F.col("c_custkey").alias("id"), F.right(F.regexp_replace("c_name", "[^0-9]", ""), F.lit(3)).alias("key")).union(c.filter("c_acctbal > 9500").select("c_custkey", F.concat("c_mktsegment", "c_nationkey"))).distinct()
    return pairs.shared(ids, "key", "id")


@_r.add(
    "interval_top5",
    """WITH i AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) - INTERVAL 0 DAY AS b FROM orders), s AS (SELECT o_orderkey, CAST(DATE '2024-01-01' + CAST(o_orderkey % 25 AS INT) AS DATE) AS b0 FROM i),
    n AS (SELECT o_orderkey, event_type, count(*) AS n FROM s JOIN events ON CAST(ts AS DATE) BETWEEN b0 AND b0 + 3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY n DESC, event_type) AS k FROM n)
    SELECT s.o_orderkey, coalesce(sum(n), 0)::BIGINT AS total, string_agg(event_type, ',' ORDER BY k) FILTER (WHERE k <= 5) AS top5 FROM s LEFT JOIN r ON r.o_orderkey = s.o_orderkey GROUP BY 1""",
)
def interval_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 25).cast("int")).alias("b"))
    span = span.withColumn("e", F.date_add("b", 3))
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    n = intervals.sums_within(daily, span, "b", "e", ["event_type"], ["n"])
    bounds = ["begins", "ends"]
    figures = n.groupBy(*bounds).agg(F.sum("n").alias("total")).join(intervals.top(n, bounds, "event_type", "n", 5, "top5"), bounds)
    return intervals.read_back(span, "b", "e", figures).select("o_orderkey", F.coalesce("total", F.lit(0)).alias("total"), F.array_join("top5", ",").alias("top5"))


@_r.add(
    "all_metric_pairs",
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type AS m, count(*) AS v FROM events GROUP BY 1, 2) SELECT a.m AS metric_a, b.m AS metric_b, count(*) AS days, sum(a.v * b.v)::BIGINT AS products FROM d a JOIN d b ON a.date = b.date AND a.m < b.m GROUP BY 1, 2""",
)
def all_metric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("m")).agg(F.count(F.lit(1)).alias("v"))
    a, b = (d.select("date", F.col("m").alias(f"metric_{x}"), F.col("v").alias(x)) for x in "ab")
    return a.join(b, "date").filter("metric_a < metric_b").groupBy("metric_a", "metric_b").agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("a") * F.col("b")).alias("products"))


@_r.add(
    "first_and_last_turns",
    """WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS f, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS l FROM conversations)
    SELECT conv_id, turn, role FROM r WHERE (role = 'user' AND f <= 3) OR (role = 'assistant' AND l = 1)""",
)
def first_and_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    first = c.filter("role = 'user'").withColumn("k", F.row_number().over(w)).filter("k <= 3").drop("k")
    return first.union(joins.latest_per_key(c.filter("role = 'assistant'"), ["conv_id"], [F.col("turn")], ["turn", "role"]))


@_r.add("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])


@_r.add("unnest_tokens", "SELECT word, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS word FROM conversations) WHERE word <> '' GROUP BY 1 HAVING count(*) >= 20")
def unnest_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("word <> ''")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conv_id").alias("conversations")).filter("n >= 20")


@_r.add(
    "spike_days",
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1), s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd FROM d) SELECT date, n, round((n - m) / sd, 4) AS z FROM d, s WHERE n > m + 1.5 * sd""",
)
def spike_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    s = d.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("sd"))  # one row
    return d.join(F.broadcast(s)).filter("n > m + 1.5 * sd").select("date", "n", F.round((F.col("n") - F.col("m")) / F.col("sd"), 4).alias("z"))


@_r.add("either_key_join", "WITH p AS (SELECT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem), q AS (SELECT s_suppkey AS x, (s_suppkey * 7) % 100 AS y FROM supplier) SELECT x, y, count(*) AS n FROM p JOIN q ON (a = x AND b = y) OR (a = y AND b = x) GROUP BY 1, 2")
def either_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.least("l_suppkey", F.col("l_partkey") % 100).alias("lo"), F.greatest("l_suppkey", F.col("l_partkey") % 100).alias("hi"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("x"), (F.col("s_suppkey") * 7 % 100).alias("y"))
    q = q.withColumns({"lo": F.least("x", "y"), "hi": F.greatest("x", "y")})
    return p.join(q, ["lo", "hi"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@_r.add("containment_join", "SELECT bit, count(*) AS parts FROM part JOIN (SELECT DISTINCT right(split_part(p_name, ' ', 2), 3) AS bit FROM part) ON contains(p_name, bit) GROUP BY 1")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold the last three letters of a second word: they meet by their three-letter parts, not in a nested loop."""
    p = table(spark, sf_dir, "part")
    bits = p.select(F.right(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(3)).alias("bit")).distinct()
    names = p.groupBy("p_name").agg(F.count(F.lit(1)).alias("c"))
    return names.select("c", F.explode(similarity.grams(F.col("p_name"), 3)).alias("bit")).join(bits, "bit").groupBy("bit").agg(F.sum("c").alias("parts"))


@_r.add("local_keys_join", "SELECT k, tag, count(*) AS n FROM (VALUES (1, 'a'), (2, 'b'), (3, 'a')) v(k, tag) JOIN orders ON o_custkey = k GROUP BY 1, 2")
def local_keys_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k int, tag string")
    return table(spark, sf_dir, "orders").join(F.broadcast(v), F.col("o_custkey") == F.col("k")).groupBy("k", "tag").agg(F.count(F.lit(1)).alias("n"))


@_r.add("update_from_join", "SELECT p_partkey, round(CASE WHEN q.n IS NULL THEN p_retailprice WHEN q.n > 30 THEN p_retailprice * 1.1 ELSE p_retailprice * 0.9 END, 4) AS price FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) q ON q.l_partkey = p_partkey")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    price = F.when(F.col("n").isNull(), F.col("p_retailprice")).when(F.col("n") > 30, F.col("p_retailprice") * 1.1).otherwise(F.col("p_retailprice") * 0.9)
    return table(spark, sf_dir, "part").join(q, "p_partkey", "left").select("p_partkey", F.round(price, 4).alias("price"))


@_r.add("name_lookup", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON lower(n_name) = lower(CASE WHEN s_nationkey < 12 THEN 'nation_' || s_nationkey ELSE (SELECT n_name FROM nation x WHERE x.n_nationkey = s_nationkey) END)")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("own"))), "s_nationkey")
    s = s.withColumn("key", F.lower(F.when(F.col("s_nationkey") < 12, F.concat(F.lit("nation_"), "s_nationkey")).otherwise(F.col("own"))))
    return s.join(F.broadcast(n.select(F.lower("n_name").alias("key"), "n_name")), "key").select("s_suppkey", "n_name")


@_r.add(
    "staged_lookup",
    "SELECT u.user_id, coalesce(a.c_custkey, b.c_custkey) AS contact, CASE WHEN a.c_custkey IS NOT NULL THEN 'id' WHEN b.c_custkey IS NOT NULL THEN 'name' END AS via FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) a ON a.c_custkey = u.user_id LEFT JOIN (SELECT min(c_custkey) AS c_custkey, c_nationkey FROM customer GROUP BY 2) b ON b.c_nationkey = u.user_id",
)
def staged_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    by_id = c.filter("c_acctbal > 3000").select(F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("a"))
    by_name = c.groupBy(F.col("c_nationkey").cast("long").alias("user_id")).agg(F.min("c_custkey").alias("b"))
    return users.join(by_id, "user_id", "left").join(by_name, "user_id", "left").select("user_id", F.coalesce("a", "b").alias("contact"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "name").alias("via"))


@_r.add(
    "next_present_day",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM d) SELECT a.date, b.date AS next_date, a.n AS n, b.n AS next_n FROM i a JOIN i b ON b.k = a.k + 1""",
)
def next_present_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    i = d.join(joins.day_index(d, "date"), "date")
    later = i.select((F.col("idx") - 1).alias("idx"), F.col("date").alias("next_date"), F.col("n").alias("next_n"))
    return i.join(later, "idx").drop("idx")


@_r.add(
    "name_pair_similarity",
    f"""WITH n AS (SELECT p_name AS name FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part UNION SELECT split_part(p_name, ' ', 2) || ' ' || lower(p_type) FROM part), w AS (SELECT DISTINCT name, unnest(string_split(name, ' ')) AS word FROM n),
    p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM w a JOIN w b ON a.word = b.word AND a.name < b.name) SELECT a, b, round({name_similarity_sql("a", "b")}, 6) AS sim FROM p""",
)
def name_pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names (whole, first word only, second word and kind) that share a word."""
    p = table(spark, sf_dir, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    names = p.select(F.explode(F.array(F.col("p_name"), first, F.concat(second, F.lit(" "), F.lower("p_type")))).alias("name")).distinct()
    words = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    return pairs.within(words, ["word"], "name").select("a", "b").distinct().withColumn("sim", F.round(similarity.name_similarity(F.col("a"), F.col("b")), 6))
