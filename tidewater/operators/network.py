"""Relationships and social graphs: profiles, layers, edges, communities, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import pairs


def person_metrics(df: DataFrame, person: str, ts: str, sent: Column, as_of: Column) -> DataFrame:
    """person, total, sent, received, first_day, days_since, weekly, reciprocity."""
    g = df.groupBy(person).agg(F.count(F.lit(1)).alias("total"), F.count_if(sent).alias("sent"), F.count_if(~sent).alias("received"), F.to_date(F.min(ts)).alias("first_day"), F.to_date(F.max(ts)).alias("last_day"))
    weeks = F.greatest(F.lit(1.0), F.datediff(as_of, "first_day") / 7)
    return g.select(person, "total", "sent", "received", "first_day", F.datediff(as_of, "last_day").alias("days_since"), (F.col("total") / weeks).alias("weekly"), (1 - F.abs(F.col("sent") - F.col("received")) / F.col("total")).alias("reciprocity"))


def layer(weekly: Column) -> Column:
    """Layers of closeness by contacts a week: 7, 3, 1, 0.25."""
    return F.when(weekly >= 7, "support").when(weekly >= 3, "sympathy").when(weekly >= 1, "close").when(weekly >= 0.25, "active").otherwise("acquaintance")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def label_propagation(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, community: every node takes the label of the greatest weight among its neighbours and itself (ties: the smaller label) until
    nothing moves. All nodes move together; a node's own label counts with its largest edge, which settles two-cycles.

    Each round is one join and two aggregations; its result is checkpointed, so lineage stays short. Links and votes are dealt over as
    many partitions as the number of links needs.
    """
    links = both_ways(edges).groupBy("a", "b").agg(F.sum("w").alias("w"))
    own = links.groupBy("a").agg(F.max("w").alias("w")).select("a", F.col("a").alias("b"), "w")
    links = links.union(own).checkpoint()
    n = pairs.parts_of(links)
    labels = links.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        met = links.repartition(n, "b").join(labels.select(F.col("node").alias("b"), "community").repartition(n, "b"), "b")
        votes = met.repartition(n, "a", "community").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("m")).select("node", (-F.col("m.c")).alias("community"))
        new = best.join(labels.withColumnRenamed("community", "before"), "node").checkpoint()
        labels = new.select("node", "community")
        if not new.filter("community != before").limit(1).count():
            break
    return labels


def bridges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """node, communities: nodes whose neighbours lie in more than one community."""
    c = communities.select(F.col("node").alias("b"), "community")
    g = both_ways(edges).join(c, "b").groupBy(F.col("a").alias("node")).agg(F.count_distinct("community").alias("communities"))
    return g.filter("communities > 1")


def frequency_trend(df: DataFrame, person: str, ts: str, as_of: Column, days: int = 90) -> DataFrame:
    """person, recent, before, trend: counts of the last `days` days and the as many before; 30 % apart is a trend."""
    d = F.datediff(as_of, F.to_date(ts))
    g = df.filter((d >= 0) & (d < 2 * days)).groupBy(person).agg(F.count_if(d < days).alias("recent"), F.count_if(d >= days).alias("before"))
    change = F.try_divide(F.col("recent") - F.col("before"), F.col("before"))
    return g.withColumn("trend", F.when(F.col("recent") == 0, "silent").when(F.col("before") == 0, "new").when(change > 0.3, "increasing").when(change < -0.3, "decreasing").otherwise("stable"))


def style_features(df: DataFrame, person: str, ts: str, length: Column, emoji: Column, question: Column, sent: Column, mood: Column, least: int = 10) -> DataFrame:
    """person, messages and nine features of persons with at least `least` messages."""
    share = lambda c: F.avg(c.cast("double"))
    g = df.groupBy(person).agg(
        F.count(F.lit(1)).alias("messages"), F.avg(length).alias("mean_length"), F.stddev_pop(length).alias("length_spread"), share(emoji).alias("emoji"), share(question).alias("questions"),
        F.avg(F.hour(ts)).alias("mean_hour"), F.stddev_pop(F.hour(ts)).alias("hour_spread"), share(F.dayofweek(ts).isin(1, 7)).alias("weekends"), share(sent).alias("initiated"), F.avg(mood).alias("mood"),
    )
    return g.filter(F.col("messages") >= least)


def voice_metrics(segments: DataFrame) -> DataFrame:
    """person, segments, speaking, mean_segment, conversations, dominance, most_active of segments (person, media, seconds, part).

    Segments are summed by person and recording first; dominance is the mean share of a recording's seconds, whose total is taken over the
    recording's sums, so segments dealt by recording stay where they are. Ties of the most active part go to the smaller one.
    """
    per = segments.filter("media is not null").groupBy("person", "media").agg(F.sum("seconds").alias("s"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("t", F.sum("s").over(Window.partitionBy("media")))
    talk = per.groupBy("person").agg(F.sum("n").alias("segments"), F.sum("s").alias("speaking"), F.count(F.lit(1)).alias("conversations"), F.avg(F.when(F.col("t") > 0, F.col("s") / F.col("t"))).alias("dominance"))
    parts = segments.groupBy("person", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("person").agg(F.max_by("part", F.struct("k", -F.col("part"))).alias("most_active"))
    return talk.join(parts, "person").withColumn("mean_segment", F.col("speaking") / F.col("segments"))
