"""Profiles of relationships: channels, habits, trend, tier, type and health of each person over the last 90 days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.classify import day_part_early
from tidewater.functions.stats import js_round
from tidewater.operators.intervals import top

# Channels of work and of private life, by which the type is inferred.
WORK, PRIVATE = ("google_chat", "gmail"), ("imessage", "instagram", "facebook", "facetime")
#: Channels on which people speak.
SPOKEN = ("voice", "plaud", "facetime")


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


def profiles(messages: DataFrame, calls: DataFrame, video: DataFrame, as_of: Column, work: Sequence[str] = WORK, private: Sequence[str] = PRIVATE) -> DataFrame:
    """One row for each person with any contact in the 90 days up to as_of (a date; both ends count).

    messages: person, ts, channel, direction (sent or received), length, thread; calls: person, ts, channel; video: person, ts. Calls count
    as received, on the channel plaud or else voice. Every part is an aggregation by person before anything is joined; of
    equal channels, hours or days the first by name counts.
    """
    since = F.date_sub(as_of, 90)
    inside = F.to_date("ts").between(since, as_of)
    m = messages.filter(inside)
    sent, received = F.count_if(F.col("direction") == "sent"), F.count_if(F.col("direction") == "received")
    per = m.groupBy("person", "channel").agg(F.count(F.lit(1)).alias("total"), sent.alias("sent"), received.alias("received"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("length").alias("length"))

    def spoken(df: DataFrame, channel: Column) -> DataFrame:
        g = df.filter(inside).groupBy("person", channel.alias("channel")).agg(F.count(F.lit(1)).alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        return g.select("person", "channel", "total", F.lit(0).alias("sent"), F.col("total").alias("received"), "first", "last", F.lit(None).cast("double").alias("length"))

    written = per.withColumn("written", F.lit(True))
    rest = spoken(calls, F.when(F.col("channel") == "plaud", "plaud").otherwise("voice")).union(spoken(video, F.lit("facetime"))).withColumn("written", F.lit(False))
    activity = written.unionByName(rest)
    texted = F.col("written")
    g = activity.groupBy("person").agg(
        F.sum("total").alias("interactions"),
        F.sum(F.when(texted, F.col("sent")).otherwise(0)).alias("sent"),
        F.sum(F.when(texted, F.col("received")).otherwise(0)).alias("received"),
        F.try_divide(F.sum(F.when(texted, F.coalesce("length", F.lit(0.0)) * F.col("total"))), F.sum(F.when(texted, F.col("total")))).alias("length"),
        F.sum(F.when(F.col("channel").isin(*SPOKEN), F.col("total")).otherwise(0)).alias("spoken"),
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.min_by("channel", F.struct(-F.col("total"), "channel")).alias("primary_channel"),
    )
    hours = m.groupBy("person", day_part_early(F.hour("ts")).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    days = m.groupBy("person", F.date_format("ts", "E").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("person", F.coalesce(F.col("thread").cast("string"), F.col("channel"))).orderBy("ts")
    turn = m.select("person", (_seconds("ts") - F.lag(_seconds("ts")).over(w)).alias("gap"), (F.col("direction") != F.lag("direction").over(w)).alias("changed"))
    answers = turn.filter(F.col("changed") & (F.col("gap") > 5) & (F.col("gap") < 86_400)).groupBy("person").agg(js_round(F.avg("gap")).alias("response_seconds"))
    edge, day = F.date_sub(as_of, 30), F.to_date("ts")
    rates = m.groupBy("person").agg(F.count_if(day >= edge).alias("recent"), F.count_if(day <= edge).alias("older"))
    out = g.join(top(hours, ["person"], "part", "n", 2, "contact_hours"), "person", "left").join(top(days, ["person"], "day", "n", 3, "contact_days"), "person", "left").join(answers, "person", "left").join(rates, "person", "left")
    return _ruled(out, as_of, work, private)


def _ruled(out: DataFrame, as_of: Column, work: Sequence[str], private: Sequence[str]) -> DataFrame:
    two = lambda c: js_round(c, 2)
    n, count = F.col("interactions"), F.size("channels")
    more, less = F.greatest("sent", "received"), F.least("sent", "received")
    ago = js_round((F.unix_seconds(as_of.cast("timestamp")) - _seconds("last")) / 86_400)
    out = out.withColumns({
        "reciprocity": F.when(F.col("sent") + F.col("received") > 0, two(less / F.greatest(more, F.lit(1)))).otherwise(0.0),
        "depth": F.least(F.lit(1.0), two(F.coalesce("length", F.lit(0.0)) / 200)),
        "in_person": two(F.col("spoken") / n),
        "recent": F.coalesce("recent", F.lit(0)), "older": F.coalesce("older", F.lit(0)),
        "days_since": ago, "weekly": n / 13,
        "duration_days": js_round((_seconds("last") - _seconds("first")) / 86_400),
    })
    now, then = F.col("recent") / 30, F.col("older") / 60
    trend = F.when((now == 0) & (then == 0), "silent").when(then == 0, "increasing").when(now > then * 1.3, "increasing").when(now < then * 0.7, "decreasing").otherwise("stable")
    weekly, since = F.col("weekly"), F.col("days_since")
    tier = F.when(since > 30, "dormant").when((weekly >= 10) & (count >= 3), "inner_circle").when((weekly >= 5) | (weekly >= 2) & (count >= 2), "close").when(weekly >= 1, "regular").when(n >= 3, "acquaintance").otherwise("dormant")
    at_work, at_home = (F.arrays_overlap("channels", F.array(*map(F.lit, c))) for c in (work, private))
    kind = F.when(at_home, "friend").when(at_work, "colleague").otherwise("unknown")
    recency = F.when(since <= 7, 1.0).when(since <= 14, 0.8).when(since <= 30, 0.5).when(since <= 60, 0.2).otherwise(0.0)
    answer = F.when(F.col("response_seconds").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("response_seconds") / 7200)))
    bonus = F.when(F.col("trend") == "increasing", 0.1).when(F.col("trend") == "stable", 0.05).otherwise(0.0)
    health = F.least(F.lit(1.0), weekly / 10) * 0.25 + F.col("reciprocity") * 0.2 + F.col("depth") * 0.15 + recency * 0.15 + count / 5 * 0.1 + answer * 0.05 + bonus
    return out.withColumn("trend", trend).select(
        "person", "interactions", "channels", "primary_channel", "contact_hours", "contact_days", "response_seconds", "reciprocity", "depth", "in_person", "trend", tier.alias("tier"), kind.alias("type"),
        F.least(F.lit(0.95), 0.4 + count * 0.1 + F.least(F.lit(0.2), n / 200)).alias("tier_confidence"), two(health).alias("health"), F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"), "days_since", "duration_days",
    )
