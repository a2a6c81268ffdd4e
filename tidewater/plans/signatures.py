"""Daily signatures: metrics, folds, baselines and anomalies over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import baselines, metrics
from tidewater.plans.base import Registry, table

_r = Registry()
QUERIES, ORACLE = _r.queries, _r.oracle

_DAILY = """
daily AS (
  SELECT CAST(ts AS DATE) AS date, event_type AS dimension, CAST(count(*) AS DOUBLE) AS events, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, sum(value) AS total
  FROM events GROUP BY 1, 2),
long AS (
  SELECT date, dimension, 'events' AS metric, events AS value FROM daily
  UNION ALL SELECT date, dimension, 'users', users FROM daily
  UNION ALL SELECT date, dimension, 'total', total FROM daily WHERE total IS NOT NULL)"""

_BASE = (
    _DAILY
    + """,
rolled AS (
  SELECT date, dimension, metric, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(value) OVER w AS n
  FROM long WINDOW w AS (PARTITION BY dimension, metric ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
scored AS (
  SELECT *, CASE WHEN sd > 0 THEN (value - mean) / sd END AS z, CASE WHEN mean <> 0 THEN (value - mean) / mean * 100 END AS pct FROM rolled WHERE n >= 7)"""
)

_LADDER = "CASE WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'high' WHEN abs(z) >= 2.5 THEN 'medium' WHEN abs(z) >= 2 THEN 'low' END"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.daily_long(table(spark, sf_dir, "events"), "ts", F.col("event_type"), {"events": F.count(F.lit(1)), "users": F.count_distinct("user_id"), "total": F.sum("value")})


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.rolling_baseline(_daily(spark, sf_dir), ["dimension", "metric"])


@_r.add("daily_metrics_long", f"WITH {_DAILY} SELECT date, dimension, metric, round(value, 4) AS value FROM long")
def daily_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir).withColumn("value", F.round("value", 4))


@_r.add("baseline_zscore", f"WITH {_BASE} SELECT date, dimension, metric, round(value, 4) AS value, round(mean, 4) AS mean, round(sd, 4) AS sd, n, round(z, 4) AS z, round(pct, 4) AS pct FROM scored")
def baseline_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("date", "dimension", "metric", "n", *(F.round(c, 4).alias(c) for c in ("value", "mean", "sd", "z", "pct")))


@_r.add("anomaly_ladder", f"WITH {_BASE} SELECT date, dimension, metric, round(z, 4) AS z, {_LADDER} AS severity FROM scored WHERE abs(z) >= 2")
def anomaly_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.abs("z") >= 2).select("date", "dimension", "metric", F.round("z", 4).alias("z"), baselines.severity(F.col("z")).alias("severity"))


@_r.add("compound_anomaly", f"WITH {_BASE} SELECT date, count(DISTINCT dimension) AS dimensions, round(max(abs(z)), 4) AS max_abs_z, 'critical' AS severity FROM scored WHERE abs(z) >= 1.2 GROUP BY date HAVING count(DISTINCT dimension) >= 3")
def compound_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.compound_anomalies(_scored(spark, sf_dir).filter(F.abs("z") >= 1.2)).withColumn("max_abs_z", F.round("max_abs_z", 4))


@_r.add("type_dependent_fold", "SELECT CAST(ts AS DATE) AS date, event_type AS kind, round(CASE WHEN event_type IN ('purchase') THEN sum(value) ELSE avg(value) END, 8) AS value FROM events GROUP BY 1, 2")
def type_dependent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.type_dependent_fold(table(spark, sf_dir, "events"), "ts", F.col("event_type"), F.col("value"), ["purchase"]).withColumn("value", F.round("value", 8))
