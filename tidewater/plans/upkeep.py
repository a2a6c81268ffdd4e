"""Thresholds and patterns under feedback, escalations looked at again, and sources gathered branch by branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewater.operators import fanin, feedback, vectors
from tidewater.plans import signatures
from tidewater.plans.base import Registry, table
from tidewater.streaming import flows

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_RATING = "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 0 WHEN user_id % 10 < CASE event_type WHEN 'click' THEN 9 WHEN 'view' THEN 3 WHEN 'purchase' THEN 6 WHEN 'error' THEN 10 ELSE 0 END THEN 1 ELSE -1 END"
_FIRST = "CASE event_type WHEN 'error' THEN 0.41 WHEN 'signup' THEN 0.93 WHEN 'view' THEN 0.6 ELSE 0.8 END"


def _adjusted(table_: str, as_of: str) -> str:
    return f"""SELECT coalesce(t.key, f.key) AS key, CASE WHEN accepted < 0.5 AND coalesce(value, 7e-1) < 0.95 THEN least(9.5e-1, coalesce(value, 7e-1) + 5e-2) WHEN accepted > 0.8 AND coalesce(value, 7e-1) > 0.4 THEN greatest(4e-1, coalesce(value, 7e-1) - 3e-2) ELSE coalesce(value, 7e-1) END AS value
    FROM {table_} t FULL JOIN (SELECT key, CASE WHEN count(*) >= 5 THEN count(*) FILTER (rating = 1) / count(*) FILTER (rating IN (1, -1)) END AS accepted FROM f WHERE rating IS NOT NULL AND said_at > TIMESTAMP '{as_of}' - INTERVAL 7 DAY AND said_at <= TIMESTAMP '{as_of}' GROUP BY 1) f ON f.key = t.key"""


_RUNS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


@_r.add(
    "threshold_feedback",
    f"""WITH f AS (SELECT event_type AS key, ts AS said_at, {_RATING} AS rating FROM events), t0 AS (SELECT DISTINCT event_type AS key, CAST({_FIRST} AS DOUBLE) AS value FROM events WHERE event_type <> 'click'),
    t1 AS ({_adjusted("t0", _RUNS[0])}), t2 AS ({_adjusted("t1", _RUNS[1])}) SELECT key, round(value, 6) AS value FROM t2""",
)
def threshold_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of thresholds after two runs, each of which reads and rewrites it."""
    e = table(spark, sf_dir, "events")
    said = e.select(F.col("event_type").alias("key"), F.col("ts").alias("at"), F.expr(_RATING).alias("rating"))
    path = flows.scratch(spark, "thresholds")
    e.filter("event_type != 'click'").select(F.col("event_type").alias("key"), F.expr(_FIRST).cast("double").alias("value")).distinct().write.parquet(path)
    for at in _RUNS:
        out = feedback.run(spark, path, said, F.expr(f"timestamp_ntz'{at}'"))
    return out.withColumn("value", F.round("value", 6))


@_r.add(
    "negative_feedback_decay",
    f"""WITH n AS (SELECT 'k' || o_custkey % 10 AS kind, count(*) AS n FROM events JOIN orders ON o_orderkey = event_id WHERE ({_RATING}) = -1 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY AND event_id % 400 < 3 GROUP BY 1 HAVING count(*) >= 2)
    SELECT p_partkey AS id, round(CASE WHEN p_partkey % 4 <> 0 AND n IS NOT NULL THEN least(1.0, (p_partkey % 11) / 10.0 + 0.1) ELSE (p_partkey % 11) / 10.0 END, 6)::DOUBLE AS decay FROM part LEFT JOIN n ON n.kind = 'k' || p_size % 10""",
)
def negative_feedback_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns (parts) whose insights (orders) were rejected twice decay faster."""
    said = table(spark, sf_dir, "events").filter("event_id % 400 < 3").select(F.col("event_id").alias("insight_id"), F.col("ts").alias("at"), F.expr(_RATING).alias("rating"))
    insights = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("insight_id"), F.concat(F.lit("k"), F.col("o_custkey") % 10).alias("kind"))
    k = F.col("p_partkey")
    patterns = table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("k"), F.col("p_size") % 10).alias("kind"), (k % 4 != 0).alias("active"), (k % 11 / 10.0).alias("decay"))
    return feedback.faster_decay(patterns, insights, said, F.expr("timestamp_ntz'2024-01-31 00:00:00'")).select("id", F.round("decay", 6).alias("decay"))


@_r.add(
    "escalation_recheck",
    f"""WITH {signatures._BASE}, x AS (SELECT dimension, metric, max(abs(z)) AS sigma FROM scored WHERE abs(z) >= 1.5 GROUP BY 1, 2), l AS (SELECT dimension, max(date) AS date FROM scored WHERE z IS NOT NULL GROUP BY 1)
    SELECT x.dimension || '/' || x.metric AS metric, round(sigma, 4) AS sigma, round(coalesce(s.z, 0), 4) AS current_z, abs(coalesce(s.z, 0)) >= 0.5 AS still FROM x JOIN l ON l.dimension = x.dimension LEFT JOIN scored s ON s.dimension = x.dimension AND s.metric = x.metric AND s.date = l.date""",
)
def escalation_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that were once beyond 1.5 deviations, and whether they are beyond half a deviation on the latest day."""
    scored = signatures._scored(spark, sf_dir)
    found = scored.filter(F.abs("z") >= 1.5).groupBy(F.concat_ws("/", "dimension", "metric").alias("metric")).agg(F.max(F.abs("z")).alias("sigma"))
    return feedback.recheck(found, scored, 0.5).select("metric", F.round("sigma", 4).alias("sigma"), F.round("current_z", 4).alias("current_z"), "still")


# --- branches


def _branches(spark: SparkSession, sf_dir: str) -> list[fanin.Branch]:
    """Three tables of vectors that are as they should be, one that isn't there, one whose vectors are texts, one without the column."""
    v = {"vec_id": "vec_id", "embedding": "embedding"}
    good = [fanin.Branch(name, lambda: table(spark, sf_dir, "embeddings"), v, f"label % 3 = {i}") for i, name in enumerate(("notes", "mails", "chats"))]
    return [
        *good,
        fanin.Branch("photos", lambda: table(spark, sf_dir, "no_such_table"), v),
        fanin.Branch("posts", lambda: table(spark, sf_dir, "documents"), {"vec_id": "doc_id", "embedding": "text"}),
        fanin.Branch("places", lambda: table(spark, sf_dir, "customer"), {"vec_id": "c_custkey", "embedding": "c_vector"}),
    ]


def _gathered(spark: SparkSession, sf_dir: str) -> fanin.Gathered:
    return fanin.gather(spark, _branches(spark, sf_dir), StructType.fromDDL("vec_id bigint, embedding array<float>"), probe=True)


_Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_HITS = f"h AS (SELECT CASE label % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'mails' ELSE 'chats' END AS source, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, {_Q})"


@_r.add("tolerant_search", f"WITH {_HITS}, p AS (SELECT * FROM h WHERE s >= 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, vec_id) <= 24) SELECT source, vec_id, round(s, 4) AS similarity FROM p ORDER BY s DESC, vec_id LIMIT 12")
def tolerant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of six tables, three of which can't be searched."""
    q = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]
    return vectors.search(_gathered(spark, sf_dir).rows, list(q), 12, 0.0, ["source"]).select("source", "vec_id", F.round("similarity", 4).alias("similarity"))


@_r.add(
    "fanin_status",
    f"""WITH {_HITS}, n AS (SELECT source, count(*) AS n FROM h GROUP BY 1) SELECT b.source, b.status, coalesce(n, 0) AS n FROM (SELECT DISTINCT unnest(['notes', 'mails', 'chats', 'photos', 'posts', 'places']) AS source, unnest(['ok', 'ok', 'ok', 'missing', 'ill_typed', 'no_column']) AS status FROM embeddings) b LEFT JOIN n ON n.source = b.source""",
)
def fanin_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each branch, and its rows."""
    g = _gathered(spark, sf_dir)
    return g.status.join(g.rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").select("source", "status", F.coalesce("n", F.lit(0)).alias("n"))


#: Seventeen sources of texts: table, id, contact, text, day, condition; in expressions that both dialects read alike.
_TEXTS = {
    **{f"document_{la}": ("documents", "CAST(doc_id AS STRING)", "source", "left(text, 500)", "CAST(NULL AS DATE)", f"lang = '{la}' AND length(text) > 10") for la in ("en", "fr", "de", "es")},
    **{f"chat_{role}": ("conversations", "CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING)", "CAST(NULL AS STRING)", "left(text, 500)", "CAST(NULL AS DATE)", f"role = '{role}' AND length(text) > 10") for role in ("user", "assistant", "system")},
    **{f"event_{kind}": ("events", "CAST(event_id AS STRING)", "CAST(user_id AS STRING)", "props", "CAST(ts AS DATE)", f"event_type = '{kind}' AND length(props) > 8") for kind in ("click", "view", "purchase", "error", "signup")},
    "order": ("orders", "CAST(o_orderkey AS STRING)", "CAST(o_custkey AS STRING)", "o_orderpriority", "CAST(o_orderdate AS DATE)", "length(o_orderpriority) > 6"),
    "part": ("part", "CAST(p_partkey AS STRING)", "p_brand", "coalesce(p_type, '') || ' - ' || left(p_name, 400)", "CAST(NULL AS DATE)", "length(p_name) > 10"),
    "customer": ("customer", "CAST(c_custkey AS STRING)", "c_name", "c_mktsegment", "CAST(NULL AS DATE)", "length(c_mktsegment) > 8"),
    "supplier": ("supplier", "CAST(s_suppkey AS STRING)", "CAST(NULL AS STRING)", "s_name", "CAST(NULL AS DATE)", "length(s_name) > 5"),
    "passage": ("benchmark", "CAST(item_id AS STRING)", "CAST(NULL AS STRING)", "left(text, 500)", "CAST(NULL AS DATE)", "length(text) > 10"),
}
_DONE = "SELECT 'document_en' AS source, CAST(doc_id AS STRING) AS source_id FROM labels UNION ALL SELECT 'event_click', CAST(event_id AS STRING) FROM events WHERE user_id % 2 = 0"


def _texts_sql() -> str:
    branches = " UNION ALL ".join(f"SELECT '{n}' AS source, {i} AS source_id, {c} AS contact, {t} AS text, {d} AS date FROM {tab} WHERE {w}" for n, (tab, i, c, t, d, w) in _TEXTS.items())
    return f"WITH sub AS ({branches}), done AS ({_DONE}) SELECT source, source_id, contact, length(text) AS chars, date FROM sub WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.source = sub.source AND done.source_id = sub.source_id)".replace("AS STRING", "AS VARCHAR")


@_r.add("text_fanin", _texts_sql())
def text_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of seventeen sources that haven't been looked at."""
    branches = [fanin.Branch(n, lambda t=tab: table(spark, sf_dir, t), {"source_id": i, "contact": c, "text": t, "date": d}, w) for n, (tab, i, c, t, d, w) in _TEXTS.items()]
    rows = fanin.gather(spark, branches, StructType.fromDDL("source_id string, contact string, text string, date date")).rows
    done = table(spark, sf_dir, "labels").select(F.lit("document_en").alias("source"), F.col("doc_id").cast("string").alias("source_id"))
    done = done.union(table(spark, sf_dir, "events").filter("user_id % 2 = 0").select(F.lit("event_click"), F.col("event_id").cast("string")))
    return fanin.waiting(rows, done, ["source", "source_id"]).select("source", "source_id", "contact", F.char_length("text").cast("long").alias("chars"), "date")
