"""What feedback changes: thresholds that each run reads and rewrites, faster decay of what is rejected, and a second look at escalations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources import sinks


def adjust(thresholds: DataFrame, feedback: DataFrame, as_of: Column, days: int = 7, least: int = 5, default: float = 0.7) -> DataFrame:
    """key, value, before, accepted, direction: each key's threshold after the ratings (key, at, rating) of the last `days` days.

    With `least` ratings or more: below half accepted it rises by .05 to .95 at most; above .8 accepted it falls by .03 to .4 at
    least. Ratings are 1, -1 or others, which count towards `least` only. A key without a threshold has the default.
    """
    recent = feedback.filter((F.col("at") > as_of - F.make_dt_interval(F.lit(days))) & (F.col("at") <= as_of) & F.col("rating").isNotNull())
    g = recent.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") == 1).alias("up"), F.count_if(F.col("rating") == -1).alias("down"))
    share = F.when(F.col("n") >= least, F.try_divide(F.col("up"), F.col("up") + F.col("down")))
    out = thresholds.select("key", F.col("value").alias("before")).join(g.select("key", share.alias("accepted")), "key", "full").withColumn("before", F.coalesce("before", F.lit(default)))
    raised, lowered = (F.col("accepted") < 0.5) & (F.col("before") < 0.95), (F.col("accepted") > 0.8) & (F.col("before") > 0.4)
    value = F.when(raised, F.least(F.lit(0.95), F.col("before") + 0.05)).when(lowered, F.greatest(F.lit(0.4), F.col("before") - 0.03)).otherwise(F.col("before"))
    return out.select("key", value.alias("value"), "before", "accepted", F.when(raised, "raised").when(lowered, "lowered").alias("direction"))


def run(spark: SparkSession, path: str, feedback: DataFrame, as_of: Column) -> DataFrame:
    """One run over the table of thresholds (key, value) at `path`: it is read, adjusted, and put back in its place. Returns it as it is now."""
    sinks.rewrite(adjust(spark.read.schema("key string, value double").parquet(path), feedback, as_of).select("key", "value"), path)
    return spark.read.schema("key string, value double").parquet(path)


def faster_decay(patterns: DataFrame, insights: DataFrame, feedback: DataFrame, as_of: Column, days: int = 30, least: int = 2, step: float = 0.1) -> DataFrame:
    """patterns (id, kind, active, decay) where active ones whose kind's insights (insight_id, kind) got `least` rejections (insight_id, at, rating) in `days` days decay by `step` more, to 1 at most."""
    bad = feedback.filter((F.col("rating") == -1) & (F.col("at") >= as_of - F.make_dt_interval(F.lit(days))))
    counts = bad.join(insights.select("insight_id", "kind"), "insight_id").groupBy("kind").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return patterns.join(counts, "kind", "left").withColumn("decay", F.when(F.col("active") & F.col("_n").isNotNull(), F.least(F.lit(1.0), F.col("decay") + step)).otherwise(F.col("decay"))).select(patterns.columns)


def recheck(escalations: DataFrame, scored: DataFrame, bound: float = 2.5) -> DataFrame:
    """escalations (metric as dimension/name) with the z of the latest day of their dimension (0 where the day lacks the metric) and whether it is anomalous still. scored: date, dimension, metric, z."""
    last = scored.filter("z is not null").groupBy("dimension").agg(F.max("date").alias("date"))
    now = scored.join(last, ["dimension", "date"]).select(F.concat_ws("/", "dimension", "metric").alias("metric"), F.col("z").alias("current_z"))
    z = F.coalesce("current_z", F.lit(0.0))
    return escalations.join(now, "metric", "left").withColumn("current_z", z).withColumn("still", F.abs("current_z") >= bound)
