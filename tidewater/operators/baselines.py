"""Rolling baselines, z-scores and the anomaly ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_baseline(series: DataFrame, keys: list[str], days: int = 30, least: int = 7) -> DataFrame:
    """Mean, population deviation and count of the calendar days before each date; z and pct where there are at least `least`.

    The frame is by day number, so gaps shorten the sample and never reach further back.
    """
    w = Window.partitionBy(*keys).orderBy("day_no").rangeBetween(-days, -1)
    rows = series.withColumn("day_no", F.datediff("date", F.lit("1970-01-01").cast("date")))
    rows = rows.select("date", *keys, "value", F.avg("value").over(w).alias("mean"), F.stddev_pop("value").over(w).alias("sd"), F.count("value").over(w).alias("n"))
    return rows.filter(F.col("n") >= least).select("*", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).alias("z"), F.when(F.col("mean") != 0, (F.col("value") - F.col("mean")) / F.col("mean") * 100).alias("pct"))


def severity(z: Column) -> Column:
    """The ladder on |z|: 4 critical, 3 high, 2.5 medium, 2 low, else null."""
    a = F.abs(z)
    return F.when(a >= 4, "critical").when(a >= 3, "high").when(a >= 2.5, "medium").when(a >= 2, "low")


def compound_anomalies(anomalies: DataFrame, least: int = 3) -> DataFrame:
    """Days on which at least `least` dimensions are anomalous."""
    return anomalies.groupBy("date").agg(F.count_distinct("dimension").alias("dimensions"), F.max(F.abs("z")).alias("max_abs_z")).filter(F.col("dimensions") >= least).withColumn("severity", F.lit("critical"))
