"""Streams over the events, run to their end in micro-batches of one time slice each, so that state and watermarks are carried; their results equal those of the batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans.base import Registry, table
from tidewater.streaming import flows, stateful

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle


#: Files, and so micro-batches, of a replay.
SLICES = 12


def _events(spark: SparkSession, sf_dir: str, stream: bool = True) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    df = flows.from_files(spark, batch, flows.in_time_slices(batch, "ts", SLICES, "events")) if stream else batch
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _keyed(df: DataFrame, key: str, parts: int) -> DataFrame:
    return df.withColumns({key: F.concat(F.lit("k"), F.col("user_id") % parts), "id": F.col("event_id")})


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as in the table."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.simpleString() == "timestamp" else f.name for f in df.schema))


def _folded(key: str, columns: str, start: str, step: str, where: str = "true") -> str:
    """A rule as SQL: the rows of a key are numbered in order, and a recursive query carries the state from row to row."""
    return f"""WITH RECURSIVE e AS (SELECT 'k' || {key} AS key, event_id AS id, ts, epoch_us(ts) // 1000 AS ms, {columns}, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS k FROM events WHERE {where}),
    z AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, {start} FROM e), r AS (SELECT * FROM z UNION ALL SELECT e.key, e.k, {step} FROM r JOIN e ON e.key = r.key AND e.k = r.k + 1)"""


@_r.add("stream_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "ts")
    out = flows.run_to_end(flows.deduplicated(e.union(e), ["event_id"]), "dedup")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@_r.add(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    x AS (SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM k GROUP BY user_id, s) SELECT * FROM x WHERE n >= 2 AND ended + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(flows.run_to_end(flows.sessions(_events(spark, sf_dir), "user_id", "ts"), "sessions").filter("n >= 2"))


_MINUTES = "CASE severity WHEN 'error' THEN 30 WHEN 'purchase' THEN 120 ELSE 1440 END"
_PASSES = f"last < 0 OR ms - last >= 60000 * {_MINUTES}"
_SUPPRESSED = f"""{_folded("user_id % 20", "event_type AS severity", "CAST(-1 AS BIGINT) AS last, false AS passed, CAST(NULL AS TIMESTAMP) AS at_ts, CAST(NULL AS VARCHAR) AS kind", f"CASE WHEN {_PASSES} THEN ms ELSE last END, {_PASSES}, ts, severity")} SELECT key AS fingerprint, at_ts AS ts, kind AS severity FROM r WHERE passed"""
_SUPPRESS = stateful.suppression({"error": 30, "purchase": 120, "click": 1440, "view": 1440, "signup": 1440})


def _alerts(df: DataFrame) -> DataFrame:
    return _keyed(df, "fingerprint", 20).withColumn("severity", F.col("event_type")).select("fingerprint", "id", "ts", "severity")


@_r.add("stream_suppression", _SUPPRESSED)
def stream_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(flows.run_to_end(stateful.on_stream(_alerts(_events(spark, sf_dir)), _SUPPRESS), "suppression"))


@_r.add("batch_suppression", _SUPPRESSED)
def batch_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(stateful.on_batch(_alerts(_events(spark, sf_dir, stream=False)), _SUPPRESS))


_LIFE = {"error": 30, "purchase": 120, "click": 360, "view": 1440, "signup": 1440}
_QUIET, _LATE = 240, 10
_LIFECYCLE = f"""{_folded("user_id % 60", "event_type AS severity", "CAST(-1 AS BIGINT) AS last, false AS passed, CAST(NULL AS TIMESTAMP) AS at_ts, CAST(NULL AS VARCHAR) AS kind", "CASE WHEN {0} THEN ms ELSE last END, {0}, ts, severity".format("last < 0 OR ms - last >= 60000 * CASE severity WHEN 'error' THEN 30 WHEN 'purchase' THEN 120 WHEN 'click' THEN 360 ELSE 1440 END"))},
    a AS (SELECT key AS fingerprint, at_ts AS raised, kind AS severity FROM r WHERE passed),
    g AS (SELECT key, ms, lead(ms) OVER (PARTITION BY key ORDER BY k) AS next_ms FROM e WHERE k > 0),
    q AS (SELECT key, ms + {_QUIET * 60000} AS due FROM g WHERE next_ms - ms >= {_QUIET * 60000} OR next_ms IS NULL AND ms + {_QUIET * 60000} < (SELECT max(epoch_us(ts) // 1000) - {_LATE * 60000} FROM events)),
    x AS (SELECT fingerprint, raised, severity, min(due) AS due FROM a JOIN q ON q.key = a.fingerprint AND q.due > epoch_us(a.raised) // 1000 GROUP BY 1, 2, 3)
    SELECT fingerprint, raised AS ts, severity, 'raised' AS change, raised FROM a UNION ALL SELECT fingerprint, make_timestamp(due * 1000), severity, 'resolved', raised FROM x WHERE epoch_us(raised) > (due - 604800000) * 1000"""


def _findings(df: DataFrame) -> DataFrame:
    return _keyed(df, "fingerprint", 60).withColumn("severity", F.col("event_type")).select("fingerprint", "id", "ts", "severity")


@_r.add("stream_alert_lifecycle", _LIFECYCLE)
def stream_alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _findings(_events(spark, sf_dir)).withWatermark("ts", f"{_LATE} minutes")
    return _plain(flows.run_to_end(stateful.on_stream(e, stateful.alert_lifecycle(_LIFE, _QUIET)), "lifecycle"))


@_r.add("batch_alert_lifecycle", _LIFECYCLE)
def batch_alert_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence counts up to the last event less the time for late ones, as on the stream."""
    e = _findings(_events(spark, sf_dir, stream=False))
    until = e.agg(F.unix_millis(F.max("ts"))).first()[0]
    return _plain(stateful.on_batch(e, stateful.alert_lifecycle(_LIFE, _QUIET), None if until is None else until - _LATE * 60_000))


_WAKES = "priority >= 4 OR last < 0 OR ms - last >= 3600000"


@_r.add("stream_debounce", f"""{_folded("user_id % 10", "event_id % 5 AS priority", "CAST(-1 AS BIGINT) AS last, false AS passed, CAST(NULL AS TIMESTAMP) AS at_ts, CAST(0 AS BIGINT) AS p", f"CASE WHEN {_WAKES} THEN ms ELSE last END, {_WAKES}, ts, priority")} SELECT key AS source, at_ts AS ts, p AS priority FROM r WHERE passed""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(_events(spark, sf_dir), "source", 10).select("source", "id", "ts", (F.col("event_id") % 5).alias("priority"))
    return _plain(flows.run_to_end(stateful.on_stream(e, stateful.debounce(3600, 4)), "debounce"))


@_r.add(
    "stream_promotion",
    """WITH e AS (SELECT 'k' || user_id % 30 AS source, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id % 30 ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 604800000 PRECEDING AND CURRENT ROW) AS seen FROM events WHERE event_type = 'purchase' AND value > 90)
    SELECT x.source, make_timestamp(x.ms * 1000) AS ts, arg_min(y.seen, y.k) AS seen FROM e x JOIN e y ON y.source = x.source AND y.k BETWEEN x.k AND x.k + 4 AND y.seen >= 3 AND y.ms - x.ms <= 604800000 GROUP BY x.source, x.k, x.ms""",
)
def stream_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(_events(spark, sf_dir).filter("event_type = 'purchase' and value > 90"), "source", 30).select("source", "id", "ts")
    return _plain(flows.run_to_end(stateful.on_stream(e, stateful.promotion()), "promotion"))


_AGAIN = "since >= 0 AND alerted >= 0 AND ms - alerted >= 3600000"
_HEALTH = f"""{_folded("user_id % 10", "event_type <> 'error' AS ok, event_id % 50 = 0 AS muted", "CAST(-1 AS BIGINT) AS since, CAST(-1 AS BIGINT) AS alerted, CAST(NULL AS VARCHAR) AS change, CAST(0 AS BIGINT) AS seconds, CAST(NULL AS TIMESTAMP) AS at_ts", f"CASE WHEN muted THEN since WHEN ok THEN -1 WHEN since < 0 THEN ms ELSE since END, CASE WHEN muted THEN alerted WHEN ok THEN -1 WHEN alerted < 0 OR {_AGAIN} THEN ms ELSE alerted END, CASE WHEN muted THEN NULL WHEN ok THEN CASE WHEN alerted >= 0 THEN 'recovered' END WHEN alerted < 0 THEN 'down' WHEN {_AGAIN} THEN 'still_down' END, CASE WHEN NOT muted AND alerted >= 0 THEN (ms - since) // 1000 ELSE 0 END, ts")} SELECT key AS service, at_ts AS ts, change, seconds FROM r WHERE change IS NOT NULL"""


@_r.add("stream_health_states", _HEALTH)
def stream_health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(_events(spark, sf_dir), "service", 10).select("service", "id", "ts", (F.col("event_type") != "error").alias("ok"), (F.col("event_id") % 50 == 0).alias("muted"))
    return _plain(flows.run_to_end(stateful.on_stream(e, stateful.health_states()), "health"))


_KM = "12742 * asin(sqrt(least(1.0, pow(sin(radians(40 + coalesce(value, 0) / 60 - 40.0) / 2), 2))))"
_TRAVEL = f"""{_folded("user_id % 50", f"{_KM} AS d", "CAST(-1 AS BIGINT) AS gone, CAST(0 AS DOUBLE) AS far, CAST(-1 AS BIGINT) AS begun, CAST(0 AS DOUBLE) AS farthest, CAST(NULL AS TIMESTAMP) AS ends", "CASE WHEN gone < 0 THEN CASE WHEN d > 80 THEN ms ELSE -1 END WHEN d < 20 THEN -1 ELSE gone END, CASE WHEN gone < 0 THEN CASE WHEN d > 80 THEN d ELSE 0 END WHEN d < 20 THEN 0 ELSE greatest(far, d) END, CASE WHEN gone >= 0 AND d < 20 AND ms - gone >= 21600000 THEN gone ELSE -1 END, far, ts")} SELECT key AS person, make_timestamp(begun * 1000) AS begins, ends, round(farthest, 3) AS farthest FROM r WHERE begun >= 0"""


@_r.add("travel_episodes", _TRAVEL)
def travel_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed(_events(spark, sf_dir, stream=False), "person", 50).select("person", "id", "ts", (40 + F.coalesce("value", F.lit(0.0)) / 60).alias("lat"), F.lit(-74.0).alias("lon"))
    return _plain(stateful.on_batch(e, stateful.travel_episodes((40.0, -74.0))))


@_r.add("changed_since", "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' OR (event_type = 'view' AND ts > TIMESTAMP '2024-01-20 00:00:00') OR event_type NOT IN ('click', 'view') GROUP BY 1")
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.createDataFrame([("view", "2024-01-20 00:00:00")], "event_type string, m string").select("event_type", F.col("m").cast("timestamp_ntz").alias("mark"))
    return flows.changed_since(table(spark, sf_dir, "events"), marks, "event_type", "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
