"""Chapters of a life: change points of weekly means, grouped into boundaries, typed by what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.windows import anchored_groups


def change_points(series: DataFrame, weeks: int = 8, least_z: float = 2.0, least_days: int = 84) -> DataFrame:
    """metric, week, old, new, z: weeks whose mean lies least_z deviations off that of the `weeks` present weeks before."""
    enough = series.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_days).select("metric")
    weekly = series.join(enough, "metric", "left_semi").groupBy("metric", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.avg("value").alias("new"))
    w = Window.partitionBy("metric").orderBy("week").rowsBetween(-weeks, -1)
    rows = weekly.select("metric", "week", "new", F.avg("new").over(w).alias("old"), F.stddev_pop("new").over(w).alias("sd"), F.count("new").over(w).alias("n"))
    scored = rows.filter((F.col("n") == weeks) & (F.col("sd") > 0)).withColumn("z", (F.col("new") - F.col("old")) / F.col("sd"))
    return scored.filter(F.abs("z") >= least_z).select("metric", "week", "old", "new", "z")


def _any(condition: Column) -> Column:
    return F.bool_or(condition)


def chapters(points: DataFrame, days: int = 14) -> DataFrame:
    """begins, ends, type, shifts, confidence, snapshot: a boundary holds the change points of `days` days from its first;
    a chapter runs from one boundary to the next. There are few change points, so one group for all is small."""
    one = points.withColumn("all", F.lit(0))
    grouped = anchored_groups(one, "all", "week", days)
    area, up = F.split_part("metric", F.lit("/"), F.lit(1)), F.col("z") > 0
    health_up, health_down = _any((area == "health") & up), _any((area == "health") & ~up)
    kind = (
        F.when(health_up & ~health_down, "health_focus")
        .when(health_down & ~health_up, "low_activity")
        .when(_any((area == "communication") & up), "social_expansion")
        .when(_any(area == "photos") & _any(area == "search_behavior"), "exploration")
        .when(F.bool_and(~up), "transition")
        .when(F.count(F.lit(1)) >= 3, "life_change")
        .otherwise("routine")
    )
    confidence = F.least(F.lit(0.95), 0.3 + 0.15 * F.count(F.lit(1)) + 0.05 * F.sum(F.abs("z")))
    rows = grouped.groupBy("group").agg(F.min("week").alias("begins"), kind.alias("type"), F.count(F.lit(1)).alias("shifts"), F.round(confidence, 2).alias("confidence"), F.array_sort(F.collect_list(F.struct("metric", F.round("new", 2).alias("value")))).alias("snapshot"))
    return rows.withColumn("ends", F.lead("begins").over(Window.partitionBy(F.lit(0)).orderBy("group"))).drop("group")


def similar_chapters(found: DataFrame, most: int = 3) -> DataFrame:
    """begins, other, gap: for each chapter the `most` of its type with the nearest confidence."""
    a = found.select("type", F.col("begins"), F.col("confidence"))
    b = found.select("type", F.col("begins").alias("other"), F.col("confidence").alias("c"))
    near = a.join(b, "type").filter("begins != other").withColumn("gap", F.round(F.abs(F.col("confidence") - F.col("c")), 9))
    place = F.row_number().over(Window.partitionBy("begins").orderBy("gap", "other"))
    return near.withColumn("place", place).filter(F.col("place") <= most).select("begins", "other", F.round("gap", 4).alias("gap"))
