"""Aggregate operators that need more than one aggregate expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import pairs


def ordered_values(value: Column, order: list[Column]) -> Column:
    """Aggregate: values as an array in the given order."""
    items = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), value.alias("v"))))
    return F.transform(items, lambda s: s["v"])


def mode_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n: the most frequent value of each key, ties to the smaller value. Two aggregations, no window."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def top_values(df: DataFrame, keys: list[str], value: str, k: int, least: int = 1) -> DataFrame:
    """keys, value, n, place: the k most frequent values of each key with at least `least` rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def mean_share(df: DataFrame, group: str, member: str, amount: str) -> DataFrame:
    """member, groups, mean_share: a member's share of each group's amount, averaged over its groups."""
    per = df.groupBy(group, member).agg(F.sum(amount).alias("amount"))
    share = F.try_divide(F.col("amount"), F.sum("amount").over(Window.partitionBy(group)))
    return per.withColumn("share", share).groupBy(member).agg(F.count(F.lit(1)).alias("groups"), F.avg("share").alias("mean_share"))


def duplicates(df: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """keys, n, first: keys with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("first")).filter("n > 1")


def co_members(df: DataFrame, group: str, member: str, ts: str, most_members: int | None = None) -> DataFrame:
    """a < b, together, first_seen, last_seen: pairs of members of the same group.

    Large groups are cut into parts that meet two by two; groups of more than most_members (if given) are left out, as a
    group of everyone says nothing about pairs.
    """
    rows = df.groupBy(group, member).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    if most_members:
        rows = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(group))).filter(F.col("size") <= most_members).drop("size")
    return pairs.within(rows, [group], member, ["lo", "hi"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("together"), F.to_date(F.min("lo_a")).alias("first_seen"), F.to_date(F.max("hi_a")).alias("last_seen"))


def value_profile(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """col, n, vals: distinct values of each column, listed where there are at most `most`."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns))).alias("x")).select("x.*").distinct()
    place = F.row_number().over(Window.partitionBy("col").orderBy("val"))
    few = long.withColumn("place", place).filter(F.col("place") <= most + 1)
    listed = few.groupBy("col").agg(F.array_join(F.array_sort(F.collect_list("val")), ",").alias("vals"))
    n = long.groupBy("col").agg(F.count("val").alias("n"))
    return n.join(listed, "col").select("col", "n", F.when(F.col("n") <= most, F.col("vals")).alias("vals"))
