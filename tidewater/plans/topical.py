"""Cluster trees over the embeddings, unique labels, greedy matching, and soundtracks of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import intervals, matching, topics, vectors
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


# --- trees


def _tree(v: DataFrame) -> DataFrame:
    """Centres of labels; of thirds within three of four labels; of halves of one third within every fifth label."""
    k, label = F.col("vec_id"), F.col("label").cast("long")
    levels = [
        v.select("embedding", label.alias("node"), F.lit(None).cast("long").alias("parent")),
        v.filter("label % 4 != 0").select("embedding", (100 + label * 10 + k % 3).alias("node"), label.alias("parent")),
        v.filter("label % 5 = 1 and vec_id % 3 = 0").select("embedding", (10_000 + label * 10 + k % 2).alias("node"), (100 + label * 10).alias("parent")),
    ]
    parents = levels[0].select("node", "parent").union(levels[1].select("node", "parent")).union(levels[2].select("node", "parent")).distinct()
    rows = levels[0].union(levels[1]).union(levels[2])
    return vectors.centroids(rows, "node").join(parents, "node")


def _mean(where: str, node: str, parent: str) -> str:
    return f"""SELECT node, parent, list(x ORDER BY i) AS c FROM (SELECT {node} AS node, {parent} AS parent, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE {where} GROUP BY 1, 2, 3) GROUP BY 1, 2"""


_WALK = f"""WITH n AS ({_mean("true", "CAST(label AS BIGINT)", "CAST(NULL AS BIGINT)")} UNION ALL {_mean("label % 4 <> 0", "100 + label * 10 + vec_id % 3", "CAST(label AS BIGINT)")} UNION ALL {_mean("label % 5 = 1 AND vec_id % 3 = 0", "10000 + label * 10 + vec_id % 2", "CAST(100 + label * 10 AS BIGINT)")}),
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    w1 AS (SELECT vec_id, label, v, arg_min(node, (list_distance(v, c), node)) AS node, min(list_distance(v, c)) AS d FROM e JOIN n ON parent IS NULL GROUP BY 1, 2, 3),
    w2 AS (SELECT vec_id, label, v, arg_min(n.node, (list_distance(v, c), n.node)) AS node, min(list_distance(v, c)) AS d FROM w1 JOIN n ON n.parent = w1.node GROUP BY 1, 2, 3),
    w3 AS (SELECT vec_id, label, arg_min(n.node, (list_distance(v, c), n.node)) AS node, min(list_distance(v, c)) AS d FROM w2 JOIN n ON n.parent = w2.node GROUP BY 1, 2),
    w AS (SELECT vec_id, label, node, 1 AS level, d FROM w1 UNION ALL SELECT vec_id, label, node, 2, d FROM w2 UNION ALL SELECT vec_id, label, node, 3, d FROM w3)"""


@_r.add("topic_tree_assignment", f"{_WALK} SELECT vec_id, node, level, round(d, 4) AS distance FROM w QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY level DESC) = 1")
def topic_tree_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific cluster of each item."""
    v = table(spark, sf_dir, "embeddings")
    return topics.walk_down(v, _tree(v)).select("vec_id", "node", "level", F.round("distance", 4).alias("distance"))


@_r.add(
    "topic_tree_figures",
    f"""{_WALK}, s AS (SELECT node, level, 's' || label % 4 AS source, count(*) AS n FROM w GROUP BY 1, 2, 3), m AS (SELECT node, string_agg(source || ':' || n, ',' ORDER BY source) AS sources FROM s GROUP BY 1)
    SELECT w.node, level, count(*) AS members, round(avg(d), 4) AS mean_distance, any_value(sources) AS sources FROM w JOIN m ON m.node = w.node GROUP BY 1, 2""",
)
def topic_tree_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, mean distance and sources of every cluster of the tree."""
    v = table(spark, sf_dir, "embeddings")
    figures = topics.node_figures(topics.walk_down(v, _tree(v)), v.select("vec_id", F.concat(F.lit("s"), F.col("label") % 4).alias("source")), "source")
    mix = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return figures.select("node", "level", "members", F.round("mean_distance", 4).alias("mean_distance"), mix.alias("sources"))


# --- labels and matching

_STYLE = """f AS (SELECT conv_id % 7 AS cluster, least(1.0, avg(length(text)) / 400) AS length, avg(CASE WHEN contains(text, '!') THEN 1.0 ELSE 0 END) AS emoji, avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0 END) AS questions,
    least(1.0, stddev_pop(turn) / 4) AS spread, avg(CASE WHEN turn >= 5 THEN 1.0 ELSE 0 END) AS weekend, avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0 END) AS initiated, avg(CASE WHEN contains(text, 'the') THEN 1.0 ELSE 0 END) AS sentiment FROM conversations GROUP BY 1)"""
_GREEDY = """o AS (SELECT l, r, score, row_number() OVER (ORDER BY score DESC, l, r) AS k FROM s),
    g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ls, CAST([] AS VARCHAR[]) AS rs, CAST(NULL AS BIGINT) AS l, CAST(NULL AS VARCHAR) AS r, CAST(NULL AS DOUBLE) AS score
      UNION ALL SELECT o.k, CASE WHEN free THEN list_append(ls, o.l) ELSE ls END, CASE WHEN free THEN list_append(rs, o.r) ELSE rs END, CASE WHEN free THEN o.l END, CASE WHEN free THEN o.r END, o.score
      FROM (SELECT g.ls, g.rs, g.k, NOT list_contains(g.ls, o.l) AND NOT list_contains(g.rs, o.r) AS free FROM g JOIN o ON o.k = g.k + 1) g JOIN o ON o.k = g.k + 1)"""


@_r.add(
    "style_label_assignment",
    f"""WITH RECURSIVE {_STYLE}, s AS (SELECT CAST(cluster AS BIGINT) AS l, unnest(['formal_professional', 'casual_social', 'proactive_connector', 'appreciative_responder', 'minimal_contact']) AS r,
    unnest([2 * length + 2 * (1 - emoji) + (1 - weekend), 2 * emoji + 2 * weekend + questions, 3 * initiated + 1.5 * spread, 2 * (1 - initiated) + 3 * sentiment, 1.5 * (1 - length) + (1 - emoji) + (1 - initiated) + (1 - sentiment)]) AS score FROM f),
    {_GREEDY} SELECT cluster, coalesce(g.r, 'uncategorized') AS label FROM f LEFT JOIN g ON g.l = f.cluster""",
)
def style_label_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labels of communication style over seven groups of speakers: two stay without one."""
    text = F.col("text")
    share = lambda c: F.avg(c.cast("double"))
    f = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 7).alias("cluster")).agg(
        F.least(F.lit(1.0), F.avg(F.char_length(text)) / 400).alias("length"), share(text.contains("!")).alias("emoji"), share(text.contains("?")).alias("questions"), F.least(F.lit(1.0), F.stddev_pop("turn") / 4).alias("spread"),
        share(F.col("turn") >= 5).alias("weekend"), share(F.col("role") == "user").alias("initiated"), share(text.contains("the")).alias("sentiment"),
    )
    return matching.unique_labels(f, "cluster", matching.style_labels())


@_r.add(
    "greedy_matching",
    f"""WITH RECURSIVE s AS (SELECT CAST(s_nationkey AS BIGINT) AS l, p_brand AS r, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
    {_GREEDY} SELECT l AS nation, r AS brand, score FROM g WHERE l IS NOT NULL""",
)
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation of suppliers gets one brand, by the quantity sold."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("nation"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    sold = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(s, "l_suppkey").join(p, "l_partkey").groupBy("nation", "brand").agg(F.sum("l_quantity").cast("double").alias("score"))
    return matching.greedy_match(sold, "nation", "brand", "score")


# --- soundtracks


@_r.add(
    "event_soundtracks",
    """WITH i AS (SELECT 'trip' AS kind, o_orderkey AS id, CAST(DATE '2024-01-01' + CAST(o_orderkey % 25 AS INT) AS DATE) AS b, CAST(DATE '2024-01-01' + CAST(o_orderkey % 25 + o_orderkey % 4 AS INT) AS DATE) AS e FROM orders
      UNION ALL SELECT 'key_date', c_custkey, CAST(DATE '2023-12-20' + CAST(c_custkey % 60 - 7 AS INT) AS DATE), CAST(DATE '2023-12-20' + CAST(c_custkey % 60 + 7 AS INT) AS DATE) FROM customer),
    d AS (SELECT DISTINCT b, e FROM i), p AS (SELECT CAST(ts AS DATE) AS date, 'artist ' || user_id % 40 AS artist, 'artist ' || user_id % 40 || ' - ' || event_type AS track, CASE WHEN event_id % 3 = 0 THEN 'scrobble' ELSE 'stream' END AS source, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS minutes FROM events),
    m AS (SELECT d.b, d.e, p.* FROM d JOIN p ON p.date BETWEEN d.b AND d.e), t AS (SELECT b, e, count(*) AS total_plays, round(coalesce(sum(minutes), 0), 2) AS total_minutes, count(DISTINCT artist) AS unique_artists, count(*) FILTER (source = 'stream') AS streams, count(*) FILTER (source = 'scrobble') AS scrobbles FROM m GROUP BY 1, 2),
    a AS (SELECT b, e, string_agg(artist, ',' ORDER BY n DESC, artist) AS top_artists FROM (SELECT b, e, artist, count(*) AS n FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY b, e ORDER BY count(*) DESC, artist) <= 5) GROUP BY 1, 2),
    k AS (SELECT b, e, string_agg(track, ',' ORDER BY n DESC, track) AS top_tracks FROM (SELECT b, e, track, count(*) AS n FROM m GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY b, e ORDER BY count(*) DESC, track) <= 5) GROUP BY 1, 2)
    SELECT i.kind, i.id, t.total_plays, t.total_minutes, a.top_artists, k.top_tracks, t.unique_artists, t.streams, t.scrobbles FROM i JOIN t ON t.b = i.b AND t.e = i.e JOIN a ON a.b = i.b AND a.e = i.e JOIN k ON k.b = i.b AND k.e = i.e""",
)
def event_soundtracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was played on trips (orders) and around key dates (customers, a week each way), from two sources."""
    day = lambda base, n: F.date_add(F.lit(base).cast("date"), n.cast("int"))
    o, c, e = F.col("o_orderkey"), F.col("c_custkey"), table(spark, sf_dir, "events")
    spans = table(spark, sf_dir, "orders").select(F.lit("trip").alias("kind"), o.alias("id"), day("2024-01-01", o % 25).alias("b"), day("2024-01-01", o % 25 + o % 4).alias("e"))
    spans = spans.union(table(spark, sf_dir, "customer").select(F.lit("key_date"), c, day("2023-12-20", c % 60 - 7), day("2023-12-20", c % 60 + 7)))
    scrobble = F.col("event_id") % 3 == 0
    plays = e.select(F.to_date("ts").alias("date"), F.concat(F.lit("artist "), F.col("user_id") % 40).alias("artist"), F.col("event_type").alias("track"), F.when(scrobble, "scrobble").otherwise("stream").alias("source"), F.when(~scrobble, F.col("value")).alias("minutes"))
    out = intervals.soundtracks(spans, plays, "b", "e", ["stream", "scrobble"])
    share = F.col("source_breakdown")
    return out.select("kind", "id", "total_plays", F.round("total_minutes", 2).alias("total_minutes"), F.array_join("top_artists", ",").alias("top_artists"), F.array_join("top_tracks", ",").alias("top_tracks"), "unique_artists", share["stream"].alias("streams"), share["scrobble"].alias("scrobbles"))
