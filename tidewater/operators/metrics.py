"""Daily metrics in long form: one row for each day, dimension and metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_long(df: DataFrame, ts: str, dimension: Column, metrics: dict[str, Column]) -> DataFrame:
    """(date, dimension, metric, value) with one aggregate per metric; days without a row have no metric."""
    wide = df.groupBy(F.to_date(ts).alias("date"), dimension.alias("dimension")).agg(*(c.cast("double").alias(k) for k, c in metrics.items()))
    return wide.unpivot(["date", "dimension"], list(metrics), "metric", "value").filter("value is not null")


def type_dependent_fold(df: DataFrame, ts: str, kind: Column, value: Column, cumulative: list[str]) -> DataFrame:
    """Sum for the cumulative kinds, mean for the others, per day and kind."""
    return (
        df.groupBy(F.to_date(ts).alias("date"), kind.alias("kind"))
        .agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select("date", "kind", F.when(F.col("kind").isin(cumulative), F.col("total")).otherwise(F.col("mean")).alias("value"))
    )
