"""Correlations, lags, event studies, trends, year over year, forecasts, indices and detectors over daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import chapters, statistics, windows
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_LONG = "s AS (SELECT CAST(ts AS DATE) AS date, event_type AS metric, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2)"


def _r_sql() -> str:
    """Pearson's r of a.value and b.value."""
    x, y = "a.value", "b.value"
    vx, vy = f"(count(*) * sum({x} * {x}) - sum({x}) * sum({x}))", f"(count(*) * sum({y} * {y}) - sum({y}) * sum({y}))"
    return f"CASE WHEN {vx} * {vy} > 1e-12 THEN (count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt({vx} * {vy}) ELSE 0.0 END"


_OLS = """count(*) AS n, CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) > 1e-12 THEN (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) ELSE 0 END AS slope,
CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) > 1e-12 AND count(*) * sum(y * y) - sum(y) * sum(y) > 1e-9 THEN power(count(*) * sum(x * y) - sum(x) * sum(y), 2) / ((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y))) ELSE 0 END AS r2, avg(y) AS mean, avg(x) AS mx"""
_ORDERS = "s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS metric, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("metric")).agg(F.sum("o_totalprice").alias("value"))


@_r.add(
    "pearson_pairs",
    f"""WITH {_LONG}, r AS (SELECT a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, {_r_sql()} AS r FROM s a JOIN s b ON a.date = b.date AND a.metric < b.metric GROUP BY 1, 2)
    SELECT metric_a, metric_b, n, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.5 THEN 'moderate' ELSE 'weak' END AS strength, round(least(0.9, abs(r)), 6) AS confidence FROM r WHERE n >= 14""",
)
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.pearson_pairs(_daily(spark, sf_dir)).select("metric_a", "metric_b", "n", F.round("r", 6).alias("r"), "strength", F.round("confidence", 6).alias("confidence"))


def _p_sql(r: str, n: str) -> str:
    """The two-sided p-value, as functions.stats.p_value has it."""
    t = f"abs({r} * sqrt(({n} - 2) / greatest(1e-12, 1 - {r} * {r})))"
    u = f"(1 / (1 + 0.3275911 * {t} / sqrt(2)))"
    tail = f"((((1.061405429 * {u} - 1.453152027) * {u} + 1.421413741) * {u} - 0.284496736) * {u} + 0.254829592) * {u} * exp(-{t} * {t} / 2)"
    return f"CASE WHEN {n} > 30 THEN {tail} ELSE least(1.0, 2 * exp(-0.717 * {t} - 0.416 * {t} * {t})) END"


@_r.add("pearson_significance", f"WITH {_ORDERS}, r AS (SELECT a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, {_r_sql()} AS r FROM s a JOIN s b ON a.date = b.date AND a.metric < b.metric GROUP BY 1, 2) SELECT metric_a, metric_b, n, round(r, 6) AS r, round({_p_sql('r', 'n')}, 6) AS p FROM r WHERE n >= 30")
def pearson_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.pearson_pairs(_orders(spark, sf_dir), 30).select("metric_a", "metric_b", "n", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@_r.add(
    "lag_correlation",
    f"""WITH {_LONG}, l AS (SELECT unnest(range(-3, 4)) AS lag), r AS (SELECT a.metric AS metric_a, b.metric AS metric_b, l.lag, count(*) AS n, {_r_sql()} AS r FROM s a CROSS JOIN l JOIN s b ON b.date = a.date + CAST(l.lag AS INT) AND a.metric < b.metric GROUP BY 1, 2, 3)
    SELECT metric_a, metric_b, lag, n, round(r, 6) AS r FROM r WHERE n >= 14 QUALIFY row_number() OVER (PARTITION BY metric_a, metric_b ORDER BY round(abs(r), 9) DESC, lag) = 1""",
)
def lag_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.lag_correlations(_daily(spark, sf_dir)).select("metric_a", "metric_b", F.col("lag").cast("long").alias("lag"), "n", F.round("r", 6).alias("r"))


_PAIRS = [("click", "view"), ("error", "signup"), ("click", "purchase"), ("purchase", "view")]


@_r.add(
    "curated_pairs",
    f"""WITH {_LONG}, p(metric_a, metric_b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)}), i AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM s)), t AS (SELECT s.*, k FROM s JOIN i ON i.date = s.date),
    r0 AS (SELECT a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, {_r_sql()} AS r FROM t a JOIN p ON p.metric_a = a.metric JOIN t b ON b.metric = p.metric_b AND b.k = a.k GROUP BY 1, 2),
    r1 AS (SELECT a.metric AS metric_a, b.metric AS metric_b, {_r_sql()} AS r FROM t a JOIN p ON p.metric_a = a.metric JOIN t b ON b.metric = p.metric_b AND b.k = a.k + 1 GROUP BY 1, 2)
    SELECT r0.metric_a, r0.metric_b, n, round(r0.r, 6) AS r, round(r1.r, 6) AS lag_r, coalesce(abs(r1.r) > abs(r0.r), false) AS precedence FROM r0 LEFT JOIN r1 ON r0.metric_a = r1.metric_a AND r0.metric_b = r1.metric_b WHERE n >= 20""",
)
def curated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame(_PAIRS, "metric_a string, metric_b string")
    return statistics.curated_pairs(_daily(spark, sf_dir), pairs).select("metric_a", "metric_b", "n", F.round("r", 6).alias("r"), F.round("lag_r", 6).alias("lag_r"), "precedence")


def _dimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics named dimension.metric over several years of orders."""
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date(F.date_trunc("month", "o_orderdate")))
    by = [o.groupBy("date", F.concat(F.lit(f"{d}."), F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))).alias("metric")).agg(F.sum("o_totalprice").alias("value")) for d, c in (("status", "o_orderstatus"), ("priority", "o_orderpriority"))]
    return by[0].union(by[1])


_DIMENSIONAL = "s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, 'status.' || lower(regexp_replace(o_orderstatus, '[^A-Za-z0-9]+', '_', 'g')) AS metric, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2 UNION ALL SELECT CAST(date_trunc('month', o_orderdate) AS DATE), 'priority.' || lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g')), sum(o_totalprice) FROM orders GROUP BY 1, 2)"


@_r.add(
    "discovered_pairs",
    f"""WITH {_DIMENSIONAL}, k AS (SELECT metric FROM s GROUP BY 1 HAVING count(*) >= 30), r AS (SELECT a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, {_r_sql()} AS r FROM s a JOIN s b ON a.date = b.date AND a.metric < b.metric WHERE a.metric IN (SELECT metric FROM k) AND b.metric IN (SELECT metric FROM k) GROUP BY 1, 2)
    SELECT metric_a, metric_b, n, round(r, 6) AS r FROM r WHERE n >= 30 AND split_part(metric_a, '.', 1) <> split_part(metric_b, '.', 1) AND NOT (metric_a = 'priority.1_urgent' AND metric_b = 'status.f') AND abs(r) >= 0.4 AND {_p_sql('r', 'n')} < 0.01 ORDER BY 1, 2 LIMIT 20""",
)
def discovered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("priority.1_urgent", "status.f")], "metric_a string, metric_b string")
    return statistics.discovered_pairs(_dimensional(spark, sf_dir), known).select("metric_a", "metric_b", "n", F.round("r", 6).alias("r"))


@_r.add(
    "pair_confirmations",
    f"""WITH {_LONG}, h AS (SELECT *, date >= DATE '2024-01-16' AS late FROM s), r AS (SELECT a.late, a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, {_r_sql()} AS r FROM h a JOIN h b ON a.date = b.date AND a.metric < b.metric GROUP BY 1, 2, 3 HAVING count(*) >= 10),
    c AS (SELECT x.metric_a, x.metric_b, CASE WHEN sign(y.r) = sign(x.r) THEN 1 ELSE 0 END AS hit FROM r x LEFT JOIN r y ON y.late AND y.metric_a = x.metric_a AND y.metric_b = x.metric_b WHERE NOT x.late) SELECT metric_a, metric_b, hit AS confirmed, 1 - hit AS exceptions, CASE WHEN hit = 0 THEN 'rejected' ELSE 'active' END AS status FROM c""",
)
def pair_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _daily(spark, sf_dir)
    prior = statistics.pearson_pairs(s.filter("date < date'2024-01-16'"), 10).withColumns({"confirmed": F.lit(0), "exceptions": F.lit(0)})
    return statistics.confirmations(prior, statistics.pearson_pairs(s.filter("date >= date'2024-01-16'"), 10))


@_r.add(
    "event_study",
    f"""WITH {_LONG}, v(event, event_date) AS (VALUES ('launch', DATE '2024-01-10'), ('outage', DATE '2024-01-20')), o AS (SELECT unnest(range(-7, 8)) AS k), n AS (SELECT event, k, metric, value FROM v CROSS JOIN o JOIN s ON s.date = event_date + CAST(k AS INT)),
    g AS (SELECT event, metric, avg(value) FILTER (WHERE k < 0) AS b, avg(value) FILTER (WHERE k = 0) AS d, avg(value) FILTER (WHERE k > 0) AS a, count(*) FILTER (WHERE k < 0) AS nb, count(*) FILTER (WHERE k = 0) AS nd, count(*) FILTER (WHERE k > 0) AS na FROM n GROUP BY 1, 2)
    SELECT event, metric, round(b, 4) AS before, round(d, 4) AS on_day, round(a, 4) AS after, round((a - b) / abs(b) * 100, 4) AS impact_pct, CAST(round(least(0.95, 0.3 + 0.05 * nd + 0.01 * nb), 4) AS DOUBLE) AS confidence FROM g WHERE nb >= 3 AND nd >= 1 AND na >= 3 AND abs(b) > 1e-9""",
)
def event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.createDataFrame([("launch", "2024-01-10"), ("outage", "2024-01-20")], "event string, d string").select("event", F.col("d").cast("date").alias("event_date"))
    s = statistics.event_study(_daily(spark, sf_dir), events)
    return s.select("event", "metric", *(F.round(c, 4).alias(c) for c in ("before", "on_day", "after", "impact_pct", "confidence")))


@_r.add("binge_days", "SELECT user_id, CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3 HAVING count(*) >= 4")
def binge_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")


@_r.add(
    "travel_days",
    "SELECT user_id, CAST(ts AS DATE) AS date, count(DISTINCT round(value / 10, 0) || ',' || round(value / 25, 0)) AS cells FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT round(value / 10, 0) || ',' || round(value / 25, 0)) > 3",
)
def travel_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct(F.round(F.col("value") / 10, 0), F.round(F.col("value") / 25, 0))
    return table(spark, sf_dir, "events").filter("value is not null").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.count_distinct(cell).alias("cells")).filter("cells > 3")


@_r.add(
    "low_streaks",
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS v FROM events GROUP BY 1, 2), k AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INT) AS i FROM d WHERE v < 45) SELECT user_id, min(date) AS first_day, count(*) AS length FROM k GROUP BY user_id, i HAVING count(*) >= 3",
)
def low_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(stats.exact_avg(F.col("value")).alias("v")).filter("v < 45")
    return windows.streaks(d, ["user_id"], "date").select("user_id", "first_day", "length")


@_r.add(
    "ols_trend",
    f"""WITH {_ORDERS}, w AS (SELECT metric, value AS y, CAST(date - (DATE '2001-07-31' - 89) AS DOUBLE) AS x FROM s WHERE date > DATE '2001-07-31' - 90 AND date <= DATE '2001-07-31'), t AS (SELECT metric, {_OLS} FROM w GROUP BY 1)
    SELECT metric, n, round(slope, 4) AS slope, round(r2, 6) AS r2, CASE WHEN r2 < 0.1 THEN 'stable' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction, CASE WHEN abs(slope / abs(mean)) * 100 > 2 THEN 'fast' WHEN abs(slope / abs(mean)) * 100 > 0.5 THEN 'moderate' ELSE 'slow' END AS velocity FROM t WHERE n >= 14 AND r2 >= 0""",
)
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = statistics.trends(_orders(spark, sf_dir), F.lit("2001-07-31").cast("date"), 90, 14, 0.0)
    return t.select("metric", "n", F.round("slope", 4).alias("slope"), F.round("r2", 6).alias("r2"), "direction", "velocity")


@_r.add(
    "year_trend",
    f"""WITH {_ORDERS}, w AS (SELECT metric, value AS y, CAST(date - (DATE '2000-12-31' - 364) AS DOUBLE) AS x FROM s WHERE date > DATE '2000-12-31' - 365 AND date <= DATE '2000-12-31'), t AS (SELECT metric, {_OLS} FROM w GROUP BY 1)
    SELECT metric, n, round(slope, 4) AS slope, round(slope / abs(mean - slope * mx), 8) AS rel_slope FROM t WHERE n >= 60""",
)
def year_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = statistics.trends(_orders(spark, sf_dir), F.lit("2000-12-31").cast("date"), 365, 60, 0.0)
    return t.select("metric", "n", F.round("slope", 4).alias("slope"), F.round("rel_slope", 8).alias("rel_slope"))


@_r.add(
    "yoy_change",
    f"""WITH {_ORDERS}, y AS (SELECT metric, extract(year FROM date)::INT AS year, avg(value) AS value FROM s WHERE extract(month FROM date) = 3 GROUP BY 1, 2), c AS (SELECT a.metric, a.year, a.value, (a.value - b.value) / abs(b.value) * 100 AS p FROM y a JOIN y b ON a.metric = b.metric AND b.year = a.year - 1)
    SELECT metric, year, round(value, 2) AS value, round(p, 4) AS change_pct, CASE WHEN p > 5 THEN 'rising' WHEN p < -5 THEN 'falling' ELSE 'stable' END AS direction, CASE WHEN abs(p) > 50 THEN 'fast' WHEN abs(p) > 15 THEN 'moderate' ELSE 'slow' END AS velocity FROM c""",
)
def yoy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = statistics.year_over_year(_orders(spark, sf_dir), 3)
    return y.select("metric", "year", F.round("value", 2).alias("value"), F.round("change_pct", 4).alias("change_pct"), "direction", "velocity")


@_r.add(
    "dow_forecast",
    f"""WITH {_ORDERS}, h AS (SELECT metric, extract(dow FROM date)::INT AS dow, avg(value) AS f, count(*) AS c FROM s WHERE date > DATE '2001-06-30' - 90 AND date <= DATE '2001-06-30' GROUP BY 1, 2 HAVING count(*) >= 4), m AS (SELECT metric FROM h GROUP BY 1 HAVING count(*) >= 5),
    d AS (SELECT CAST(range AS DATE) AS date FROM range(DATE '2001-07-01', DATE '2001-07-31', INTERVAL 1 DAY))
    SELECT h.metric, d.date, h.dow, round(f, 1) AS forecast, round(s.value, 2) AS actual, round(abs(s.value - f) / abs(s.value) * 100, 2) AS error_pct FROM h JOIN m ON m.metric = h.metric JOIN d ON extract(dow FROM d.date) = h.dow LEFT JOIN s ON s.metric = h.metric AND s.date = d.date""",
)
def dow_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _orders(spark, sf_dir)
    f = statistics.with_actuals(statistics.weekday_forecast(s, F.lit("2001-06-30").cast("date")), s)
    return f.select("metric", "date", "dow", F.round("forecast", 1).alias("forecast"), F.round("actual", 2).alias("actual"), F.round("error_pct", 2).alias("error_pct"))


@_r.add(
    "mood_like_index",
    """WITH w AS (SELECT CAST(ts AS DATE) AS date, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS a, sum(value) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY 1),
    r AS (SELECT date, least(2.0, a / avg(a) OVER x) / 2.0 AS ra, least(2.0, b / avg(b) OVER x) / 2.0 * 0.5 AS rb FROM w WINDOW x AS (ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT date, round(CASE WHEN ra IS NULL AND rb IS NULL THEN 0.5 ELSE (coalesce(ra, 0) + coalesce(rb, 0)) / ((ra IS NOT NULL)::INT + (rb IS NOT NULL)::INT) END, 6) AS mood FROM r""",
)
def mood_like_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    w = e.groupBy(F.to_date("ts").alias("date")).agg(F.count_if(F.col("event_type") == "click").cast("double").alias("a"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("b"))
    return statistics.capped_index(w, {"a": 1.0, "b": 0.5}).withColumn("mood", F.round("mood", 6))


@_r.add(
    "transition_signals",
    """WITH g AS (SELECT event_type, user_id % 10 AS cohort, count(*) FILTER (WHERE CAST(ts AS DATE) > DATE '2024-01-20') / 10.0 AS r, count(*) FILTER (WHERE CAST(ts AS DATE) <= DATE '2024-01-20') / 20.0 AS b FROM events WHERE CAST(ts AS DATE) > DATE '2023-12-31' AND CAST(ts AS DATE) <= DATE '2024-01-30' GROUP BY 1, 2)
    SELECT event_type || cohort AS kind, round(r, 4) AS recent_rate, round(b, 4) AS baseline_rate, round(least(1.0, abs((r - b) / b)), 4) AS strength FROM g WHERE least(1.0, abs((r - b) / b)) >= 0.1""",
)
def transition_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("kind", F.concat("event_type", F.col("user_id") % 10))
    t = statistics.transition_signals(e, "ts", "kind", F.lit("2024-01-30").cast("date"), least=0.1)
    return t.select("kind", *(F.round(c, 4).alias(c) for c in ("recent_rate", "baseline_rate", "strength")))


@_r.add("yearly_profile", "SELECT extract(year FROM o_orderdate)::INT AS year, count(*) AS orders, round(avg(o_totalprice), 2) AS mean_price, count(DISTINCT o_custkey) AS customers, round(count(*) / count(DISTINCT CAST(o_orderdate AS DATE)), 4) AS per_active_day FROM orders GROUP BY 1")
def yearly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.count_distinct("o_custkey").alias("customers"), F.round(F.count(F.lit(1)) / F.count_distinct(F.to_date("o_orderdate")), 4).alias("per_active_day"))


# Fixed value: words of dates and milestones.
_MARKERS = r"(anniversary|birthday|\d+ years|since \d{4}|back in \d{4}|first met|known .+ for|remember when)"


@_r.add(
    "timeline_markers",
    f"""WITH m AS (SELECT user_id AS person, ts AS sent_at, event_id, CASE event_id % 6 WHEN 0 THEN 'It is her Birthday today' WHEN 1 THEN 'friends for ' || event_id % 40 || ' years' WHEN 2 THEN 'back in 1' WHEN 3 THEN 'I remember when we met, back in 1999' WHEN 4 THEN 'nothing to see' ELSE event_type END AS content FROM events),
    l AS (SELECT * FROM m WHERE regexp_matches(content, '(?i){_MARKERS}') AND sent_at > TIMESTAMP '2024-01-31' - INTERVAL 365 DAY ORDER BY sent_at DESC, event_id LIMIT 30) SELECT person, count(*) AS markers, CAST(min(sent_at) AS DATE) AS first_day, string_agg(content, ' / ' ORDER BY sent_at DESC, event_id) AS contents FROM l GROUP BY 1""",
)
def timeline_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest thirty messages with words of dates and milestones, by person."""
    k = F.col("event_id") % 6
    said = F.when(k == 0, "It is her Birthday today").when(k == 1, F.concat(F.lit("friends for "), F.col("event_id") % 40, F.lit(" years"))).when(k == 2, "back in 1").when(k == 3, "I remember when we met, back in 1999").when(k == 4, "nothing to see").otherwise(F.col("event_type"))
    m = table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), F.col("ts").alias("sent_at"), "event_id", F.left(said, F.lit(300)).alias("content"))
    latest = m.filter(F.col("content").rlike(f"(?i){_MARKERS}") & (F.col("sent_at") > F.expr("timestamp_ntz'2023-01-31'"))).orderBy(F.desc("sent_at"), "event_id").limit(30)
    contents = F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("sent_at").cast("timestamp"))).alias("k"), "event_id", "content")))
    return latest.groupBy("person").agg(F.count(F.lit(1)).alias("markers"), F.to_date(F.min("sent_at")).alias("first_day"), F.array_join(F.transform(contents, lambda x: x["content"]), " / ").alias("contents"))


@_r.add(
    "life_transitions",
    """WITH e AS (SELECT CAST(ts AS DATE) AS at, user_id, event_type, value, CAST(ts AS DATE) >= DATE '2024-01-21' AS now, CAST(ts AS DATE) >= DATE '2024-01-06' AND CAST(ts AS DATE) < DATE '2024-01-21' AS thn, CAST(ts AS DATE) < DATE '2024-01-06' AS ago FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-31'),
    c AS (SELECT count(*) FILTER (WHERE n) AS rt, count(*) FILTER (WHERE n AND NOT t) AS rn, count(*) FILTER (WHERE t) AS bt, count(*) FILTER (WHERE t AND NOT a) AS bn FROM (SELECT user_id, bool_or(now) AS n, bool_or(thn) AS t, bool_or(ago) AS a FROM e WHERE event_type = 'signup' GROUP BY 1)),
    p AS (SELECT r / b AS q, b FROM (SELECT count(DISTINCT floor(value * 10)) FILTER (WHERE now AND event_type = 'click') AS r, count(DISTINCT floor(value * 10)) FILTER (WHERE thn AND event_type = 'click') AS b FROM e)),
    v AS (SELECT (count(*) FILTER (WHERE now) / 10.0) / (count(*) FILTER (WHERE thn) / 15.0) AS q FROM e WHERE event_type = 'signup'), m AS (SELECT avg(value / 20) FILTER (WHERE now) - avg(value / 20) FILTER (WHERE thn) AS d FROM e WHERE event_type = 'error'),
    b AS (SELECT (count(*) FILTER (WHERE now) / 10.0) / (count(*) FILTER (WHERE thn) / 15.0) AS q FROM e WHERE event_type IN ('view', 'error')), w AS (SELECT count(*) AS n FROM (SELECT bool_or(now) AS n, bool_or(thn) AS t FROM e WHERE event_type = 'purchase' GROUP BY user_id, floor(value)) WHERE n AND NOT t),
    s AS (SELECT 'contacts' AS test, 'social_shift' AS type, (rn / rt) / greatest(0.01, bn / bt) / 3 AS strength FROM c WHERE rn / rt > 2 * (bn / bt) AND rn >= 3 UNION ALL SELECT 'places', CASE WHEN q > 2 THEN 'relocation' ELSE 'routine_break' END, CASE WHEN q > 2 THEN (q - 1) / 3 ELSE 1 - q END FROM p WHERE q > 2 OR (q < 0.3 AND b >= 5)
    UNION ALL SELECT 'volume', CASE WHEN q > 1 THEN 'social_shift' ELSE 'stress_period' END, abs(q - 1) / 1.5 FROM v WHERE q > 1.5 OR q < 0.5 UNION ALL SELECT 'moods', CASE WHEN d < 0 THEN 'stress_period' ELSE 'social_shift' END, abs(d) / 0.3 FROM m WHERE abs(d) > 0.1
    UNION ALL SELECT 'meetings', 'routine_break', abs(q - 1) / 2 FROM b WHERE q > 1.8 OR q < 0.4 UNION ALL SELECT 'mails', 'career_change', n / 15 FROM w WHERE n >= 5)
    SELECT test, type, round(least(1.0, strength), 6) AS strength, count(*) FILTER (WHERE least(1.0, strength) >= 0.3) OVER () >= 2 AS together FROM s""",
)
def life_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.to_date("ts")).filter("at < date'2024-01-31'")
    kind, user = F.col("event_type"), F.col("user_id")
    out = statistics.life_transitions(
        e.filter(kind == "signup").select("at", user.alias("who")),
        e.filter(kind == "click").select("at", F.floor(F.col("value") * 10).alias("cell")),
        e.filter(kind == "error").select("at", (F.col("value") / 20).alias("score")),
        e.filter(kind.isin("view", "error")).select("at"),
        e.filter(kind == "purchase").select("at", F.concat_ws("-", user, F.floor("value")).alias("domain")),
        F.lit("2024-01-31").cast("date"), 10, 15,
    )
    return out.withColumn("strength", F.round("strength", 6))


@_r.add(
    "quiet_metrics",
    f"WITH {_LONG}, b AS (SELECT metric, avg(value) AS m, stddev_pop(value) AS sd FROM s WHERE date <= DATE '2024-01-26' GROUP BY 1), l AS (SELECT s.metric, max(abs((value - m) / sd)) AS z FROM s JOIN b ON b.metric = s.metric WHERE s.date > DATE '2024-01-26' GROUP BY 1) SELECT metric, round(z, 4) AS worst_z, z < 2 AS resolved FROM l",
)
def quiet_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies resolve after days without a further one; an escalation looks at the latest score again."""
    s = _daily(spark, sf_dir)
    b = s.filter("date <= date'2024-01-26'").groupBy("metric").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = s.filter("date > date'2024-01-26'").join(b, "metric").groupBy("metric").agg(F.max(F.abs((F.col("value") - F.col("m")) / F.col("sd"))).alias("z"))
    return z.select("metric", F.round("z", 4).alias("worst_z"), (F.col("z") < 2).alias("resolved"))


@_r.add(
    "dimension_metrics",
    """SELECT CAST(ts AS DATE) AS date, CASE event_type WHEN 'click' THEN 'digital' WHEN 'view' THEN 'content' WHEN 'purchase' THEN 'finance' WHEN 'error' THEN 'meta' ELSE 'social' END AS dimension,
    count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE extract(hour FROM ts) BETWEEN 6 AND 11) AS morning, count(*) FILTER (WHERE extract(hour FROM ts) BETWEEN 12 AND 17) AS afternoon, count(*) FILTER (WHERE extract(hour FROM ts) BETWEEN 18 AND 22) AS evening,
    count(*) FILTER (WHERE extract(hour FROM ts) < 6 OR extract(hour FROM ts) > 22) AS night FROM events GROUP BY 1, 2""",
)
def dimension_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    dim = F.col("event_type")
    dim = F.when(dim == "click", "digital").when(dim == "view", "content").when(dim == "purchase", "finance").when(dim == "error", "meta").otherwise("social")
    h = F.hour("ts")
    return e.groupBy(F.to_date("ts").alias("date"), dim.alias("dimension")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(h.between(6, 11)).alias("morning"), F.count_if(h.between(12, 17)).alias("afternoon"), F.count_if(h.between(18, 22)).alias("evening"), F.count_if((h < 6) | (h > 22)).alias("night")
    )




def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily order totals, with an area for each priority."""
    areas = {"1-URGENT": "health/urgent", "2-HIGH": "communication/high", "3-MEDIUM": "photos/medium", "4-NOT SPECIFIED": "search_behavior/other", "5-LOW": "motion/low"}
    names = F.create_map(*[F.lit(x) for kv in areas.items() for x in kv])
    return _orders(spark, sf_dir).withColumn("metric", F.coalesce(F.element_at(names, F.col("metric")), F.col("metric")))


_CHAPTERS = """s AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'health/urgent' WHEN '2-HIGH' THEN 'communication/high' WHEN '3-MEDIUM' THEN 'photos/medium' WHEN '4-NOT SPECIFIED' THEN 'search_behavior/other' WHEN '5-LOW' THEN 'motion/low' ELSE o_orderpriority END AS metric, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
    k AS (SELECT metric FROM s GROUP BY 1 HAVING count(*) >= 84), w AS (SELECT metric, CAST(date_trunc('week', date) AS DATE) AS week, avg(value) AS v FROM s WHERE metric IN (SELECT metric FROM k) GROUP BY 1, 2), z AS (SELECT metric, week, (v - avg(v) OVER x) / nullif(stddev_pop(v) OVER x, 0) AS z, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY metric ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    p AS (SELECT split_part(metric, '/', 1) AS area, week, z FROM z WHERE n = 8 AND abs(z) >= 2), d AS (SELECT week, row_number() OVER (ORDER BY week) AS i FROM (SELECT DISTINCT week FROM p)),
    r AS (SELECT week, i, week AS first, 1 AS g FROM d WHERE i = 1 UNION ALL SELECT d.week, d.i, CASE WHEN d.week - r.first > 14 THEN d.week ELSE r.first END, g + CASE WHEN d.week - r.first > 14 THEN 1 ELSE 0 END FROM r JOIN d ON d.i = r.i + 1),
    c AS (SELECT g, min(p.week) AS begins, count(*) AS shifts, round(least(0.95, 0.3 + 0.15 * count(*) + 0.05 * sum(abs(z))), 2) AS confidence, CASE WHEN bool_or(area = 'health' AND z > 0) AND NOT bool_or(area = 'health' AND z <= 0) THEN 'health_focus' WHEN bool_or(area = 'health' AND z <= 0) AND NOT bool_or(area = 'health' AND z > 0) THEN 'low_activity'
    WHEN bool_or(area = 'communication' AND z > 0) THEN 'social_expansion' WHEN bool_or(area = 'photos') AND bool_or(area = 'search_behavior') THEN 'exploration' WHEN bool_and(z <= 0) THEN 'transition' WHEN count(*) >= 3 THEN 'life_change' ELSE 'routine' END AS type FROM p JOIN r ON r.week = p.week GROUP BY g)"""


@_r.add("life_chapters", f"WITH RECURSIVE {_CHAPTERS} SELECT begins, lead(begins) OVER (ORDER BY g) AS ends, type, shifts, confidence FROM c")
def life_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chapters.chapters(chapters.change_points(_areas(spark, sf_dir)))
    return found.select("begins", "ends", "type", "shifts", "confidence")


@_r.add("similar_chapters", f"WITH RECURSIVE {_CHAPTERS}, a AS (SELECT x.begins, y.begins AS other, round(abs(x.confidence - y.confidence), 9) AS gap FROM c x JOIN c y ON x.type = y.type AND x.begins <> y.begins) SELECT begins, other, round(gap, 4) AS gap FROM a QUALIFY row_number() OVER (PARTITION BY begins ORDER BY gap, other) <= 3")
def similar_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.similar_chapters(chapters.chapters(chapters.change_points(_areas(spark, sf_dir))))


@_r.add(
    "metric_change_points",
    """WITH s AS (SELECT o_orderpriority AS metric, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), k AS (SELECT metric FROM s GROUP BY 1 HAVING count(*) >= 84), w AS (SELECT metric, CAST(date_trunc('week', date) AS DATE) AS week, avg(value) AS v FROM s WHERE metric IN (SELECT metric FROM k) GROUP BY 1, 2),
    z AS (SELECT metric, week, v, avg(v) OVER x AS m, stddev_pop(v) OVER x AS sd, count(*) OVER x AS n FROM w WINDOW x AS (PARTITION BY metric ORDER BY week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT metric, week, round((v - m) / sd, 4) AS z FROM z WHERE n = 8 AND sd > 0 AND abs((v - m) / sd) >= 2""",
)
def metric_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.change_points(_orders(spark, sf_dir)).select("metric", "week", F.round("z", 4).alias("z"))
