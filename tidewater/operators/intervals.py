"""Figures over many intervals of days: each distinct interval meets the days once, and the intervals read the result by its bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dictionary(intervals: DataFrame, begin: str, end: str) -> DataFrame:
    """begins, ends, date: the days of each distinct interval; intervals that end before they begin, or lack a bound, have none."""
    spans = intervals.select(F.col(begin).alias("begins"), F.col(end).alias("ends")).filter(F.col("begins") <= F.col("ends")).distinct()
    return spans.select("begins", "ends", F.explode(F.sequence("begins", "ends")).alias("date"))


def sums_within(daily: DataFrame, intervals: DataFrame, begin: str, end: str, keys: list[str], sums: list[str]) -> DataFrame:
    """begins, ends, keys and the sums of daily rows (date, keys, sums) over each distinct interval."""
    return dictionary(intervals, begin, end).join(daily, "date").groupBy("begins", "ends", *keys).agg(*(F.sum(c).alias(c) for c in sums))


def top(rows: DataFrame, by: list[str], item: str, weight: str, k: int, name: str) -> DataFrame:
    """by, name: the k items of greatest weight, in order (ties by item), as an array. Only the k first of a group are gathered."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(weight), item))
    first = rows.withColumn("_p", place).filter(F.col("_p") <= k)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", item))), lambda x: x[item]).alias(name))


def read_back(intervals: DataFrame, begin: str, end: str, figures: DataFrame, how: str = "left") -> DataFrame:
    """intervals with the figures of their bounds."""
    f = figures.withColumnsRenamed({"begins": "_b", "ends": "_e"})
    return intervals.join(f, (F.col(begin) == F.col("_b")) & (F.col(end) == F.col("_e")), how).drop("_b", "_e")


def soundtracks(intervals: DataFrame, plays: DataFrame, begin: str, end: str, sources: list[str], k: int = 5) -> DataFrame:
    """intervals in which anything was played, with total_plays, total_minutes, top_artists, top_tracks, unique_artists and
    source_breakdown (map of each of `sources` to its plays).

    plays: date, artist, track, source, minutes (null where the source has none). All sources count together, so an artist in
    two of them is one; a track is the artist's and the title. Plays meet the intervals after they are counted by day.
    """
    title = F.concat_ws(" - ", "artist", "track")
    daily = plays.groupBy("date", "artist", title.alias("track"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("minutes").alias("minutes"))
    span = ["begins", "ends"]
    per = sums_within(daily, intervals, begin, end, ["artist", "track", "source"], ["n", "minutes"])
    artists = per.groupBy(*span, "artist").agg(F.sum("n").alias("n"))
    tracks = per.groupBy(*span, "track").agg(F.sum("n").alias("n"))
    share: dict[str, Column] = {s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0)) for s in sources}
    figures = per.groupBy(*span).agg(F.sum("n").alias("total_plays"), F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("total_minutes"), F.create_map(*[x for s, c in share.items() for x in (F.lit(s), c)]).alias("source_breakdown"))
    figures = figures.join(artists.groupBy(*span).agg(F.count("artist").alias("unique_artists")), span)
    figures = figures.join(top(artists.filter("artist is not null"), span, "artist", "n", k, "top_artists"), span, "left").join(top(tracks, span, "track", "n", k, "top_tracks"), span, "left")
    return read_back(intervals, begin, end, figures, "inner")
