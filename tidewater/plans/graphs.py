"""Vector search, topic clusters, relationships and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import network, pairs, topics, vectors
from tidewater.plans.base import Registry, table
from tidewater.session import ensure_checkpoint_dir

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 7").select("embedding").first()[0]


@_r.add("cosine_topk", f"SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS similarity FROM embeddings, {_Q} WHERE list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) >= 0.05 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 20, 0.05).select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


@_r.add(
    "multi_table_search",
    f"WITH s AS (SELECT vec_id, label % 3 AS src, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS c FROM embeddings, {_Q}), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY c DESC, vec_id) AS k FROM s WHERE c >= 0.0) SELECT vec_id, src, round(c, 4) AS similarity FROM r WHERE k <= 10 ORDER BY c DESC, vec_id LIMIT 5",
)
def multi_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("src"), "embedding")
    return vectors.search(v, _query(spark, sf_dir), 5, 0.0, ["src"]).select("vec_id", "src", F.round("similarity", 4).alias("similarity"))


@_r.add(
    "topic_boost",
    f"""WITH u AS (SELECT vec_id, label, embedding, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY 1),
    t AS (SELECT label FROM c, {_Q} ORDER BY list_cosine_similarity(e, q::DOUBLE[]) DESC, label LIMIT 3), h AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, {_Q} ORDER BY s DESC, vec_id LIMIT 30)
    SELECT vec_id, label AS topic, round(least(1.0, s + CASE WHEN label IN (SELECT label FROM t) THEN 0.05 ELSE 0 END), 4) AS boosted FROM h""",
)
def topic_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = table(spark, sf_dir, "embeddings"), _query(spark, sf_dir)
    hits = vectors.search(e.drop("label"), q, 30, -1.0)
    c = vectors.centroids(e, "label").withColumnRenamed("label", "topic")
    return vectors.topic_boost(hits, e.select("vec_id", F.col("label").alias("topic")), c, q).select("vec_id", "topic", F.round("boosted", 4).alias("boosted"))


@_r.add(
    "rerank_merge",
    f"WITH h AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN (vec_id % 97) / 97.0 END AS r, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS s FROM embeddings, {_Q} ORDER BY s DESC, vec_id LIMIT 30) SELECT vec_id, round(coalesce(r, s), 4) AS score FROM h ORDER BY coalesce(r, s) DESC, vec_id LIMIT 10",
)
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vectors.search(table(spark, sf_dir, "embeddings").drop("label"), _query(spark, sf_dir), 100, -1.0)
    hits = hits.withColumn("rerank_score", F.when(F.col("vec_id") % 2 == 0, (F.col("vec_id") % 97) / 97.0))
    return vectors.rerank(hits, 10).select("vec_id", F.round(F.coalesce("rerank_score", "similarity"), 4).alias("score"))


@_r.add("topic_stats", "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))), 4) AS mean_norm FROM embeddings GROUP BY 1")
def topic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vectors.norm(F.col("embedding"))), 4).alias("mean_norm"))


@_r.add(
    "topic_profile",
    "WITH m AS (SELECT label, event_type, ts FROM embeddings JOIN events ON event_id = vec_id), n AS (SELECT label, event_type, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT label, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS sources FROM n GROUP BY 1) SELECT m.label, count(*) AS members, min(ts) AS begins, max(ts) AS ends, any_value(sources) AS sources FROM m JOIN s ON s.label = m.label GROUP BY 1",
)
def topic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time range and source mix of each topic."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), "label")
    return vectors.cluster_profile(v.join(table(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "event_id"), "label", "ts", "event_type")


_FACTS = "f AS (SELECT vec_id AS id, 'd' || label % 3 AS domain, (vec_id % 100) / 100.0::DOUBLE AS confidence, vec_id % 13 = 0 AS superseded, embedding FROM embeddings)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(k, F.concat(F.lit("d"), F.col("label") % 3).alias("domain"), (k % 100 / 100.0).alias("confidence"), (k % 13 == 0).alias("superseded"), "embedding")


@_r.add("fact_search", f"WITH {_FACTS} SELECT id, domain, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS similarity FROM f, {_Q} WHERE NOT superseded AND confidence >= 0.3 AND domain = 'd1' ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, id LIMIT 20")
def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current facts of a domain and a least confidence, nearest to the query."""
    f = _facts(spark, sf_dir).filter("not superseded and confidence >= 0.3 and domain = 'd1'")
    return vectors.search(f, _query(spark, sf_dir), 20, -1.0).select(F.col("vec_id").alias("id"), "domain", F.round("similarity", 4).alias("similarity"))


@_r.add("fact_text_search", "SELECT p_partkey AS id, p_name AS key, p_type AS value FROM part WHERE p_size % 7 > 0 AND (p_size % 10) / 10.0 >= 0.2 AND (p_name ILIKE '%RED%' OR p_type ILIKE '%RED%' OR p_brand ILIKE '%RED%') ORDER BY (p_size % 10) DESC, p_size DESC, p_partkey LIMIT 20")
def fact_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an embedding: facts that hold the text, by confidence, then evidence."""
    p = table(spark, sf_dir, "part").filter("p_size % 7 > 0").withColumn("confidence", F.col("p_size") % 10 / 10.0).filter("confidence >= 0.2")
    return vectors.containing(p, ["p_name", "p_type", "p_brand"], "RED", [F.desc("confidence"), F.desc("p_size"), F.col("p_partkey")], 20).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key"), F.col("p_type").alias("value"))


@_r.add("chunk_search", f"SELECT vec_id AS id, label AS entity, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 4) AS similarity FROM embeddings, {_Q} WHERE label IN (2, 4) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 15")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of given entities, nearest to the query."""
    c = table(spark, sf_dir, "embeddings").filter("label in (2, 4)")
    return vectors.search(c, _query(spark, sf_dir), 15, -1.0).select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), F.round("similarity", 4).alias("similarity"))


@_r.add("chunk_text_search", "SELECT event_id AS id, ts AS time_end FROM events WHERE props ILIKE '%\"K\": 6%' ORDER BY CASE WHEN event_type = 'error' THEN NULL ELSE ts END DESC NULLS LAST, event_id LIMIT 15")
def chunk_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an embedding: chunks that hold the text, the latest first, those without an end last."""
    e = table(spark, sf_dir, "events")
    end = F.when(F.col("event_type") != "error", F.col("ts"))
    return vectors.containing(e, ["props"], '"K": 6', [end.desc_nulls_last(), F.col("event_id")], 15).select(F.col("event_id").alias("id"), F.col("ts").alias("time_end"))


@_r.add("kmeans_two_level")
def kmeans_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.two_level(table(spark, sf_dir, "embeddings"), 5).withColumn("distance", F.round("distance", 6))


@_r.add("nearest_to_centroid")
def nearest_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_members(vectors.kmeans(table(spark, sf_dir, "embeddings"), 5), 15).select("topic", "vec_id", "place")


@_r.add("style_clusters")
def style_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine features of how a person writes, scaled to 0..1 and clustered; what a person lacks counts as 0."""
    e = table(spark, sf_dir, "events")
    text = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "☀").otherwise(""))
    f = network.style_features(e, "user_id", "ts", F.char_length("props"), text.rlike(r"[^\x01-\x7F]"), F.col("props").contains("7"), F.col("event_type") == "click", F.col("value"), 10)
    names = [c for c in f.columns if c not in ("user_id", "messages")]
    scaled = vectors.min_max(f.filter("user_id is not null").fillna(0.0, names), names)
    return vectors.kmeans(scaled.select(F.col("user_id").alias("vec_id"), F.array(*names).alias("embedding")), 5, unit=False).select("vec_id", "topic")


_PEOPLE = "SELECT o_custkey AS person, o_orderdate AS ts, o_orderstatus = 'F' AS sent FROM orders"


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("sent"))


_AS_OF = "DATE '2001-08-01'"
_METRICS = f"m AS (SELECT person, count(*) AS total, count(*) FILTER (WHERE sent) AS sent, count(*) FILTER (WHERE NOT sent) AS received, {_AS_OF} - CAST(max(ts) AS DATE) AS days_since, count(*) / greatest(1.0, ({_AS_OF} - CAST(min(ts) AS DATE)) / 7) AS weekly FROM ({_PEOPLE}) GROUP BY 1)"


@_r.add("person_metrics", f"WITH {_METRICS} SELECT person, total, sent, received, CAST(days_since AS INT) AS days_since, round(weekly, 5) AS weekly, round(1 - abs(sent - received) / total, 5) AS reciprocity FROM m")
def person_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = network.person_metrics(_contacts(spark, sf_dir), "person", "ts", F.col("sent"), F.lit("2001-08-01").cast("date"))
    return m.select("person", "total", "sent", "received", "days_since", F.round("weekly", 5).alias("weekly"), F.round("reciprocity", 5).alias("reciprocity"))


@_r.add("dunbar_layers", f"WITH {_METRICS} SELECT CASE WHEN weekly * 50 >= 7 THEN 'support' WHEN weekly * 50 >= 3 THEN 'sympathy' WHEN weekly * 50 >= 1 THEN 'close' WHEN weekly * 50 >= 0.25 THEN 'active' ELSE 'acquaintance' END AS layer, count(*) AS people FROM m GROUP BY 1")
def dunbar_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = network.person_metrics(_contacts(spark, sf_dir), "person", "ts", F.col("sent"), F.lit("2001-08-01").cast("date"))
    return m.groupBy(network.layer(F.col("weekly") * 50).alias("layer")).agg(F.count(F.lit(1)).alias("people"))


@_r.add("recency_tiers", f"WITH {_METRICS} SELECT CASE WHEN days_since <= 30 THEN 'active' WHEN days_since <= 180 THEN 'warm' WHEN days_since <= 365 THEN 'cool' ELSE 'dormant' END AS tier, count(*) AS people FROM m GROUP BY 1")
def recency_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = network.person_metrics(_contacts(spark, sf_dir), "person", "ts", F.col("sent"), F.lit("2001-08-01").cast("date"))
    d = F.col("days_since")
    return m.groupBy(F.when(d <= 30, "active").when(d <= 180, "warm").when(d <= 365, "cool").otherwise("dormant").alias("tier")).agg(F.count(F.lit(1)).alias("people"))


_TREND = f"WITH c AS (SELECT person, count(*) FILTER (WHERE {_AS_OF} - CAST(ts AS DATE) < 365) AS recent, count(*) FILTER (WHERE {_AS_OF} - CAST(ts AS DATE) >= 365) AS before FROM ({_PEOPLE}) WHERE {_AS_OF} - CAST(ts AS DATE) BETWEEN 0 AND 729 GROUP BY 1), t AS (SELECT *, CASE WHEN recent = 0 THEN 'silent' WHEN before = 0 THEN 'new' WHEN (recent - before) / before > 0.3 THEN 'increasing' WHEN (recent - before) / before < -0.3 THEN 'decreasing' ELSE 'stable' END AS trend FROM c)"


@_r.add("frequency_trend", f"{_TREND} SELECT person, recent, before, trend FROM t")
def frequency_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.frequency_trend(_contacts(spark, sf_dir), "person", "ts", F.lit("2001-08-01").cast("date"), 365)


@_r.add("decay_list", f"{_TREND} SELECT person, trend FROM t WHERE trend IN ('decreasing', 'silent') AND before >= 3")
def decay_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.frequency_trend(_contacts(spark, sf_dir), "person", "ts", F.lit("2001-08-01").cast("date"), 365).filter("trend in ('decreasing', 'silent') and before >= 3").select("person", "trend")


@_r.add("silent_customers", "SELECT o_custkey AS person, count(*) AS earlier FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = orders.o_custkey AND x.o_orderdate >= TIMESTAMP '2001-01-01') GROUP BY 1 HAVING count(*) >= 8")
def silent_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass: silent are those whose last order lies before the window."""
    g = _contacts(spark, sf_dir).groupBy("person").agg(F.count(F.lit(1)).alias("earlier"), F.max("ts").alias("last"))
    return g.filter("last < timestamp_ntz'2001-01-01' and earlier >= 8").select("person", "earlier")


@_r.add("channel_mix", "SELECT o_custkey AS person, count(*) AS n, round(count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*), 4) AS urgent_share, count(DISTINCT o_orderpriority) AS channels, CAST(arg_max(h, (c, -h)) AS INT) AS top_hour FROM (SELECT *, extract(dow FROM o_orderdate) AS h, count(*) OVER (PARTITION BY o_custkey, extract(dow FROM o_orderdate)) AS c FROM orders) GROUP BY 1")
def channel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("h", F.dayofweek("o_orderdate") - 1)
    top = o.groupBy("o_custkey", "h").agg(F.count(F.lit(1)).alias("c")).groupBy("o_custkey").agg(F.max_by("h", F.struct("c", -F.col("h"))).alias("top_hour"))
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("double")), 4).alias("urgent_share"), F.count_distinct("o_orderpriority").alias("channels"))
    return g.join(top, "o_custkey").withColumnRenamed("o_custkey", "person")


@_r.add("style_features", "SELECT conv_id, count(*) AS messages, round(avg(length(text)), 4) AS chars, round(stddev_pop(length(text)), 4) AS spread, round(avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END), 4) AS questions, round(avg(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1.0 ELSE 0.0 END), 4) AS non_ascii_ratio FROM conversations GROUP BY 1 HAVING count(*) >= 3")
def style_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.round(F.avg(F.char_length(t)), 4).alias("chars"), F.round(F.stddev_pop(F.char_length(t)), 4).alias("spread"), F.round(F.avg(t.contains("?").cast("double")), 4).alias("questions"), F.round(F.avg(t.rlike("[^\\x00-\\x7F]").cast("double")), 4).alias("non_ascii_ratio"))
    return g.filter("messages >= 3")


_EDGES = "e AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) * 3 AS w FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3)"


_PART_EDGES = "p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) * 3 AS w FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2)"


def _edges(spark: SparkSession, sf_dir: str, member: str = "l_suppkey", least: int = 3) -> DataFrame:
    m = pairs.dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", member), "l_orderkey").distinct()
    return pairs.within(m, ["l_orderkey"], member, by_pair=True).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("a", "b", (F.col("n") * 3).alias("w"))


#: Synchronous rounds: in each, every node takes the label of most weight among its neighbours and itself.
_PROPAGATED = """k AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), o AS (SELECT a, b, w FROM k UNION ALL SELECT a, a, max(w) FROM k GROUP BY a),
    l AS (SELECT DISTINCT a AS node, a AS c, 0 AS i FROM k UNION ALL SELECT a, c, i + 1 FROM (SELECT a, i, c, row_number() OVER (PARTITION BY a, i ORDER BY w DESC, c) AS best FROM (SELECT o.a, l.i, l.c, sum(o.w) AS w FROM o JOIN l ON l.node = o.b WHERE l.i < 20 GROUP BY ALL)) WHERE best = 1),
    c AS (SELECT node, c AS community FROM l WHERE i = 20)"""


@_r.add("graph_edges", f"WITH {_EDGES} SELECT a, b, w FROM e")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@_r.add("label_propagation", f"WITH RECURSIVE {_EDGES}, {_PROPAGATED} SELECT node, community FROM c")
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return network.label_propagation(_edges(spark, sf_dir))


@_r.add("bridges", f"WITH RECURSIVE {_PART_EDGES}, {_PROPAGATED} SELECT k.a AS node, count(DISTINCT community) AS communities FROM k JOIN c ON c.node = k.b GROUP BY 1 HAVING count(DISTINCT community) > 1")
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are ordered together at least twice: a sparse graph of many communities."""
    ensure_checkpoint_dir(spark)
    edges = _edges(spark, sf_dir, "l_partkey", 2).checkpoint()
    return network.bridges(edges, network.label_propagation(edges))


@_r.add("unlinked_people", "SELECT user_id, count(*) AS n FROM events WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id) GROUP BY 1 HAVING count(*) >= 60")
def unlinked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60").join(s, "user_id", "left_anti")
