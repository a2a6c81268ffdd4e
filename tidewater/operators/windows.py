"""Window operators: response times, gaps and islands, sessions, greedy groups, turn counters, overlapping chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import folds


def seconds_of(ts: str | Column) -> Column:
    return F.unix_timestamp((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def response_times(df: DataFrame, key: str, order: list[str], kind: str, first: str, then: str, least: int = 1, most: int = 86_400) -> DataFrame:
    """Rows of kind `first` that `then` follows directly within the bounds, with the seconds between."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.select("*", F.lead(kind).over(w).alias("_next"), F.lead(order[0]).over(w).alias("_at"))
    gap = seconds_of("_at") - seconds_of(order[0])
    return rows.filter((F.col(kind) == first) & (F.col("_next") == then)).withColumn("seconds", gap).filter(F.col("seconds").between(least, most)).drop("_next", "_at")


def streaks(days: DataFrame, keys: list[str], date: str, least: int = 3) -> DataFrame:
    """keys, first_day, last_day, length: runs of consecutive dates (date minus its number is constant in a run)."""
    one = days.select(*keys, date).distinct()
    w = Window.partitionBy(*keys).orderBy(date)
    island = F.date_sub(F.col(date), F.row_number().over(w))
    return one.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(date).alias("first_day"), F.max(date).alias("last_day"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("_i")


def sessions(df: DataFrame, key: str, order: list[str], gap_seconds: int = 1800) -> DataFrame:
    """df with session (from 1 within each key): a new one begins where the gap exceeds gap_seconds."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = seconds_of(order[0]) - seconds_of(F.lag(order[0]).over(w))
    new = F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def session_rows(df: DataFrame, key: str, order: list[str], gap_seconds: int = 1800, least: int = 2) -> DataFrame:
    """key, session, started, ended, n of the sessions with at least `least` rows."""
    s = sessions(df, key, order, gap_seconds)
    return s.groupBy(key, "session").agg(F.min(order[0]).alias("started"), F.max(order[0]).alias("ended"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def gap_clusters(df: DataFrame, keys: list[str], day: str, score: str, most_gap: int) -> DataFrame:
    """keys, first_day, last_day, n, best_day, best: chains of points at most most_gap days from the last member; the member of the largest |score|."""
    w = Window.partitionBy(*keys).orderBy(day)
    new = F.coalesce((F.datediff(day, F.lag(day).over(w)) > most_gap).cast("int"), F.lit(1))
    chained = df.withColumn("_new", new).withColumn("_c", F.sum("_new").over(w))
    best = F.max_by(F.struct(F.col(day).alias("d"), F.col(score).alias("s")), F.struct(F.abs(score), -F.datediff(day, F.lit("1970-01-01").cast("date")))).alias("b")
    return chained.groupBy(*keys, "_c").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n"), best).select(*keys, "first_day", "last_day", "n", F.col("b.d").alias("best_day"), F.col("b.s").alias("best"))


def anchored_groups(df: DataFrame, key: str, day: str, most_days: int) -> DataFrame:
    """df with group (from 1): a group holds the days at most most_days after its first member; not chainable.

    The rule is sequential, so the days of a key are folded in order; a key has a row for each day at most.
    """

    def step(state: tuple, r) -> tuple[tuple, list[tuple]]:
        number, first = state
        name, d = r
        at = pd.Timestamp(d)
        if first is None or (at - first).days > most_days:
            number, first = number + 1, at
        return (number, first), [(name, d, number)]

    days = df.select(key, day).distinct()
    grouped = folds.fold(days, [key], [day], lambda: (0, None), step, f"{key} {days.schema[key].dataType.simpleString()}, {day} date, `group` long")
    return df.join(grouped, [key, day])


def turn_signals(df: DataFrame, conv: str, turn: str, role: str) -> DataFrame:
    """conv, turns, repeats: user turns that directly follow a user turn."""
    w = Window.partitionBy(conv).orderBy(turn)
    again = (F.col(role) == "user") & (F.lag(role).over(w) == "user")
    return df.withColumn("_a", F.coalesce(again, F.lit(False)).cast("int")).groupBy(conv).agg(F.count(F.lit(1)).alias("turns"), F.sum("_a").alias("repeats"))


def rapid_fire(df: DataFrame, key: str, order: list[str], seconds: int = 10) -> DataFrame:
    """key, rapid: rows less than `seconds` after the key's row before."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = seconds_of(order[0]) - seconds_of(F.lag(order[0]).over(w))
    return df.withColumn("_r", F.coalesce((gap < seconds).cast("int"), F.lit(0))).groupBy(key).agg(F.sum("_r").alias("rapid"))


def chunks(df: DataFrame, conv: str, order: str, size: int = 50, step: int = 40) -> DataFrame:
    """Rows in overlapping chunks (from 0) of `size` rows, a new one every `step`; the last chunk is the first that reaches the end."""
    w = Window.partitionBy(conv)
    rows = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    last = F.when(F.col("_n") <= size, 0).otherwise(F.ceil((F.col("_n") - size) / step))
    low = F.greatest(F.lit(0), F.floor((F.col("_i") - size) / step) + 1)
    high = F.least(F.floor(F.col("_i") / step), last)
    return rows.withColumn("chunk", F.explode(F.sequence(low.cast("int"), high.cast("int")))).drop("_i", "_n")


def day_radius_clusters(df: DataFrame, day: str, lat: str, lon: str, id_: str, km: float = 50.0) -> DataFrame:
    """day, id, cluster (from 1): a photo joins the day's first cluster whose first member is within km, or, without a
    place (null or not finite), the day's first cluster; a first member without a place is near to all.

    The order (by id) decides, so a day is folded in sequence. Its clusters are the state, by cubes of side km around the globe's
    centre: who is within km lies in one of 27 cubes, which hold a few first members each, so a photo's cost doesn't grow.
    """
    from math import asin, cos, floor, isfinite, radians, sin, sqrt

    side = km * (1 + 1e-9)

    def far(a: tuple[float, float], b: tuple[float, float]) -> float:
        h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
        return 12742 * asin(sqrt(min(1.0, max(0.0, h))))

    def cube(at: tuple[float, float]) -> tuple[int, int, int]:
        y, x = radians(at[0]), radians(at[1])
        return floor(6371 * cos(y) * cos(x) / side), floor(6371 * cos(y) * sin(x) / side), floor(6371 * sin(y) / side)

    def step(state: dict, r) -> tuple[dict, list[tuple]]:
        d, number, x, y = r
        at = None if pd.isna(x) or pd.isna(y) or not (isfinite(x) and isfinite(y)) else (float(x), float(y))
        cubes, here = state["cubes"], None
        if at is None:
            near = [1] if state["n"] else []
        else:
            here = i, j, k = cube(at)
            around = ((i + a, j + b, k + c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))
            near = [n for c in around for n, seed in cubes.get(c, ()) if far(seed, at) <= km]
            near += [state["anywhere"]] if state["anywhere"] else []
        hit = min(near, default=None)
        if hit is None:
            hit = state["n"] = state["n"] + 1
            if at is None:
                state["anywhere"] = hit
            else:
                cubes.setdefault(here, []).append((hit, at))
        return state, [(d, number, hit)]

    return folds.fold(df.select(day, id_, lat, lon), [day], [id_], lambda: {"n": 0, "anywhere": 0, "cubes": {}}, step, f"{day} date, {id_} long, cluster long")
