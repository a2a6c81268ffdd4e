"""Correlations, lags, event studies, trends, year over year, forecasts and composite indices over long daily series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import stats
from tidewater.operators import joins

# A long series has (date, metric, value).


def pearson_pairs(series: DataFrame, least: int = 14) -> DataFrame:
    """metric_a < metric_b, n, r, p, strength, confidence for all pairs with at least `least` common days."""
    a, b = (series.select("date", F.col("metric").alias(f"metric_{x}"), F.col("value").alias(x)) for x in "ab")
    pairs = a.join(b, "date").filter("metric_a < metric_b").groupBy("metric_a", "metric_b").agg(F.count(F.lit(1)).alias("n"), stats.pearson(F.col("a"), F.col("b")).alias("r"))
    r = F.abs("r")
    return pairs.filter(F.col("n") >= least).withColumns({"p": stats.p_value(F.col("r"), F.col("n")), "strength": F.when(r > 0.7, "strong").when(r > 0.5, "moderate").otherwise("weak"), "confidence": F.least(F.lit(0.9), r)})


def lag_correlations(series: DataFrame, lags: range = range(-3, 4), least: int = 14, least_r: float = 0.0) -> DataFrame:
    """metric_a < metric_b, lag, n, r: the lag (b read `lag` calendar days after a) with the largest |r|, the lowest lag on ties."""
    a = series.select("date", F.col("metric").alias("metric_a"), F.col("value").alias("a"))
    b = joins.with_lags(series.select("date", F.col("metric").alias("metric_b"), F.col("value").alias("b")), "date", "b", ["metric_b"], list(lags))
    r = a.join(b, "date").filter("metric_a < metric_b").groupBy("metric_a", "metric_b", "lag").agg(F.count(F.lit(1)).alias("n"), stats.pearson(F.col("a"), F.col("b")).alias("r")).filter(F.col("n") >= least)
    best = F.max(F.struct(F.round(F.abs("r"), 9).alias("k"), (-F.col("lag")).alias("l"), "n", "r")).alias("m")
    return r.groupBy("metric_a", "metric_b").agg(best).select("metric_a", "metric_b", (-F.col("m.l")).alias("lag"), "m.n", "m.r").filter(F.abs("r") >= least_r)


def curated_pairs(series: DataFrame, pairs: DataFrame, least: int = 20) -> DataFrame:
    """metric_a, metric_b, n, r, lag_n, lag_r, precedence for listed pairs; the lag goes to the next day present."""
    idx = joins.day_index(series, "date")
    s = series.join(idx, "date")
    a = s.select("idx", F.col("metric").alias("metric_a"), F.col("value").alias("a"))
    b = s.select("idx", F.col("metric").alias("metric_b"), F.col("value").alias("b"))

    def r(right: DataFrame, prefix: str) -> DataFrame:
        both = a.join(pairs, "metric_a").join(right, ["idx", "metric_b"])
        return both.groupBy("metric_a", "metric_b").agg(F.count(F.lit(1)).alias(f"{prefix}n"), stats.pearson(F.col("a"), F.col("b")).alias(f"{prefix}r"))

    out = r(b, "").join(r(b.withColumn("idx", F.col("idx") - 1), "lag_"), ["metric_a", "metric_b"], "left")
    return out.filter(F.col("n") >= least).withColumn("precedence", F.coalesce(F.abs("lag_r") > F.abs("r"), F.lit(False)))


def discovered_pairs(series: DataFrame, known: DataFrame, least_days: int = 30, least_r: float = 0.4, most_p: float = 0.01, most: int = 20) -> DataFrame:
    """Pairs of metrics of different dimensions ('dimension.metric') that no listed pair covers, first in order of their names."""
    enough = series.groupBy("metric").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least_days).select("metric")
    found = pearson_pairs(series.join(enough, "metric", "left_semi"), least_days)
    found = found.filter(F.substring_index("metric_a", ".", 1) != F.substring_index("metric_b", ".", 1)).join(known, ["metric_a", "metric_b"], "left_anti")
    return found.filter((F.abs("r") >= least_r) & (F.col("p") < most_p)).orderBy("metric_a", "metric_b").limit(most)


def confirmations(prior: DataFrame, current: DataFrame) -> DataFrame:
    """metric_a, metric_b, confirmed, exceptions, status: each earlier pair is confirmed by a current one of the same sign, else an exception; more exceptions than confirmations reject it."""
    now = current.select("metric_a", "metric_b", F.col("r").alias("now"))
    hit = F.coalesce(F.signum("now") == F.signum("r"), F.lit(False))
    out = prior.join(now, ["metric_a", "metric_b"], "left").select("metric_a", "metric_b", (F.col("confirmed") + F.when(hit, 1).otherwise(0)).alias("confirmed"), (F.col("exceptions") + F.when(hit, 0).otherwise(1)).alias("exceptions"))
    return out.withColumn("status", F.when(F.col("exceptions") > F.col("confirmed"), "rejected").otherwise("active"))


def event_study(series: DataFrame, events: DataFrame, days: int = 7, least: int = 3) -> DataFrame:
    """event, metric, before, on_day, after, impact_pct: means of the days before, of and after events (event, event_date)."""
    near = joins.around_events(series, events, "date", "event_date", days)
    g = near.groupBy("event", "metric").agg(
        *(F.avg(F.when(c, F.col("value"))).alias(k) for k, c in (("before", F.col("offset") < 0), ("on_day", F.col("offset") == 0), ("after", F.col("offset") > 0))),
        *(F.count(F.when(c, F.col("value"))).alias(k) for k, c in (("nb", F.col("offset") < 0), ("nd", F.col("offset") == 0), ("na", F.col("offset") > 0))),
    )
    ok = g.filter(F.col("nb").between(least, 10**9) & (F.col("nd") >= 1) & (F.col("na") >= least) & (F.abs("before") > 1e-9))
    return ok.withColumn("impact_pct", (F.col("after") - F.col("before")) / F.abs("before") * 100).withColumn("confidence", F.least(F.lit(0.95), 0.3 + 0.05 * F.col("nd") + 0.01 * F.col("nb")))


def trends(series: DataFrame, last: Column, days: int, least: int, least_r2: float = 0.05) -> DataFrame:
    """metric, n, slope, r2, rel_slope, direction, velocity over the last `days` days up to `last`."""
    x = F.datediff("date", F.date_sub(last, days - 1)).cast("double")
    recent = series.filter((F.col("date") > F.date_sub(last, days)) & (F.col("date") <= last)).withColumn("x", x)
    slope, intercept, r2 = stats.ols(F.col("value"), F.col("x"))
    t = recent.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), slope.alias("slope"), intercept.alias("intercept"), r2.alias("r2"), F.avg("value").alias("mean"))
    t = t.filter((F.col("n") >= least) & (F.col("r2") >= least_r2))
    per_day = F.abs(F.try_divide("slope", F.abs("mean"))) * 100
    return t.select(
        "metric", "n", "slope", "r2",
        F.try_divide("slope", F.abs("intercept")).alias("rel_slope"),
        F.when(F.col("r2") < 0.1, "stable").when(F.col("slope") > 0, "rising").otherwise("falling").alias("direction"),
        F.when(per_day > 2, "fast").when(per_day > 0.5, "moderate").otherwise("slow").alias("velocity"),
    )


def year_over_year(series: DataFrame, month: int, least_years: int = 2) -> DataFrame:
    """metric, year, value, change_pct, direction, velocity, significance: the same calendar month in successive years."""
    y = series.filter(F.month("date") == month).groupBy("metric", F.year("date").alias("year")).agg(F.avg("value").alias("value"))
    before = y.select("metric", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    years = y.groupBy("metric").agg(F.count(F.lit(1)).alias("years"))
    out = y.join(before, ["metric", "year"]).join(years, "metric").filter(F.col("years") >= least_years)
    pct = F.try_divide(F.col("value") - F.col("before"), F.abs("before")) * 100
    return out.withColumn("change_pct", pct).select(
        "metric", "year", "value", "change_pct",
        F.when(F.col("change_pct") > 5, "rising").when(F.col("change_pct") < -5, "falling").otherwise("stable").alias("direction"),
        F.when(F.abs("change_pct") > 50, "fast").when(F.abs("change_pct") > 15, "moderate").otherwise("slow").alias("velocity"),
        F.least(F.lit(1.0), F.col("years") / 10).alias("significance"),
    )


def weekday_forecast(series: DataFrame, last: Column, history: int = 90, ahead: int = 30, least: int = 4, least_days: int = 5) -> DataFrame:
    """metric, date, dow (0 Sunday), forecast: each weekday's mean over the history, for the days ahead."""
    h = series.filter((F.col("date") > F.date_sub(last, history)) & (F.col("date") <= last))
    per = h.groupBy("metric", (F.dayofweek("date") - 1).alias("dow")).agg(F.avg("value").alias("forecast"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least)
    enough = per.groupBy("metric").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") >= least_days).select("metric")
    days = per.sparkSession.range(1).select(F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, ahead))).alias("date")).withColumn("dow", F.dayofweek("date") - 1)
    return per.join(enough, "metric", "left_semi").join(F.broadcast(days), "dow").select("metric", "date", "dow", "forecast")


def with_actuals(forecast: DataFrame, series: DataFrame) -> DataFrame:
    actual = series.select("metric", "date", F.col("value").alias("actual"))
    return forecast.join(actual, ["metric", "date"], "left").withColumn("error_pct", F.try_divide(F.abs(F.col("actual") - F.col("forecast")), F.abs("actual")) * 100)


def capped_index(wide: DataFrame, parts: dict[str, float], cap: float = 2.0) -> DataFrame:
    """date, mood: mean of the parts' ratios to their own mean of the 30 days before, capped and scaled to 0..1; 0.5 where no part has one."""
    w = Window.partitionBy(F.lit(0)).orderBy("day_no").rangeBetween(-30, -1)
    rows = wide.withColumn("day_no", F.datediff("date", F.lit("1970-01-01").cast("date")))
    ratios = [F.least(F.lit(cap), F.try_divide(F.col(c), F.avg(c).over(w))) / cap * weight for c, weight in parts.items()]
    scored = rows.withColumn("_parts", F.array_compact(F.array(*ratios)))
    mean = F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x) / F.size("_parts")
    return scored.select("date", F.when(F.size("_parts") > 0, mean).otherwise(0.5).alias("mood"))


def transition_signals(events: DataFrame, ts: str, kind: str, as_of: Column, recent: int = 10, before: int = 20, least: float = 0.3) -> DataFrame:
    """kind, recent_rate, baseline_rate, change, strength: daily rates of the recent window against the one before it."""
    d = F.to_date(ts)
    rows = events.filter((d > F.date_sub(as_of, recent + before)) & (d <= as_of))
    now = d > F.date_sub(as_of, recent)
    g = rows.groupBy(kind).agg((F.count_if(now) / recent).alias("recent_rate"), (F.count_if(~now) / before).alias("baseline_rate"))
    change = F.try_divide(F.col("recent_rate") - F.col("baseline_rate"), F.col("baseline_rate"))
    return g.withColumn("change", change).withColumn("strength", F.least(F.lit(1.0), F.abs("change"))).filter(F.col("strength") >= least)


def life_transitions(contacts: DataFrame, places: DataFrame, moods: DataFrame, meetings: DataFrame, mails: DataFrame, as_of: Column, recent: int = 30, before: int = 90, least: float = 0.3) -> DataFrame:
    """test, type, strength, together: the six tests of a changed life over the last `recent` days against the `before` days before them.

    All tables have at (date); contacts: who; places: cell; moods: score; mails: domain; meetings count alone. `together` tells whether two
    tests at least reach `least`. Distinct values are reduced to one row each first, so every test is an aggregation that combines early.
    """
    # The bounds and scales of the six tests.
    start, base = F.date_sub(as_of, recent), F.date_sub(as_of, recent + before)
    now, then, ago = F.col("at") >= start, (F.col("at") >= base) & (F.col("at") < start), F.col("at") < base

    def seen(df: DataFrame, key: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.bool_or(now).alias("now"), F.bool_or(then).alias("then"), F.bool_or(ago).alias("ago"))

    def signal(test: str, type_: Column, strength: Column, where: Column) -> list[Column]:
        return [F.lit(test).alias("test"), type_.alias("type"), F.least(F.lit(1.0), strength).alias("strength"), F.coalesce(where, F.lit(False)).alias("ok")]

    c = seen(contacts, "who").agg(F.count_if("now").alias("rt"), F.count_if(F.col("now") & ~F.col("then")).alias("rn"), F.count_if("then").alias("bt"), F.count_if(F.col("then") & ~F.col("ago")).alias("bn"))
    r, b = F.try_divide("rn", "rt"), F.try_divide("bn", "bt")
    new = c.select(*signal("contacts", F.lit("social_shift"), r / F.greatest(F.lit(0.01), b) / 3, (r > 2 * b) & (F.col("rn") >= 3)))
    p = seen(places, "cell").agg(F.count_if("now").alias("r"), F.count_if("then").alias("b")).withColumn("q", F.try_divide("r", "b"))
    where = p.select(*signal("places", F.when(F.col("q") > 2, "relocation").otherwise("routine_break"), F.when(F.col("q") > 2, (F.col("q") - 1) / 3).otherwise(1 - F.col("q")), (F.col("q") > 2) | (F.col("q") < 0.3) & (F.col("b") >= 5)))

    def rate(df: DataFrame) -> DataFrame:
        return df.agg((F.count_if(now) / recent).alias("r"), (F.count_if(then) / before).alias("b")).withColumn("q", F.try_divide("r", "b"))

    q = F.col("q")
    volume = rate(contacts).select(*signal("volume", F.when(q > 1, "social_shift").otherwise("stress_period"), F.abs(q - 1) / 1.5, (q > 1.5) | (q < 0.5)))
    m = moods.agg((F.avg(F.when(now, F.col("score"))) - F.avg(F.when(then, F.col("score")))).alias("d"))
    mood = m.select(*signal("moods", F.when(F.col("d") < 0, "stress_period").otherwise("social_shift"), F.abs("d") / 0.3, F.abs("d") > 0.1))
    busy = rate(meetings).select(*signal("meetings", F.lit("routine_break"), F.abs(q - 1) / 2, (q > 1.8) | (q < 0.4)))
    d = seen(mails, "domain").agg(F.count_if(F.col("now") & ~F.col("then")).alias("n"))
    work = d.select(*signal("mails", F.lit("career_change"), F.col("n") / 15, F.col("n") >= 5))
    rows = reduce(DataFrame.unionByName, [new, where, volume, mood, busy, work]).filter("ok").drop("ok")
    strong = F.sum((F.col("strength") >= least).cast("int")).over(Window.partitionBy(F.lit(0)))  # six rows at most
    return rows.withColumn("together", strong >= 2)


def spikes(daily: DataFrame, keys: list[str], days: int = 30, times: float = 2.0) -> DataFrame:
    """Rows (keys, date, value) whose value exceeds `times` the mean of the `days` days before, with that mean."""
    w = Window.partitionBy(*keys).orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    return daily.withColumn("mean", F.avg("value").over(w)).filter((F.col("mean") > 0) & (F.col("value") > times * F.col("mean")))


def resolved(anomalies: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Anomalies (metric, date) older than `days` days of metrics without one since."""
    limit = F.date_sub(as_of, days)
    recent = anomalies.filter(F.col("date") >= limit).select("metric").distinct()
    return anomalies.filter(F.col("date") < limit).join(recent, "metric", "left_anti").select(anomalies.columns)
