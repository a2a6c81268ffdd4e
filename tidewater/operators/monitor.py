"""Findings about a job queue and its model calls: failure rates, failing types, depth, stuck jobs, recency of subsystems, fallbacks and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(df: DataFrame, source: str, severity: Column, fingerprint: Column, value: Column, note: Column) -> DataFrame:
    """Findings (source, severity, fingerprint, value, note) of the rows that have a severity."""
    return df.select(F.lit(source).alias("source"), severity.alias("severity"), fingerprint.alias("fingerprint"), value.cast("double").alias("value"), note.cast("string").alias("note")).filter("severity is not null")


def _level(value: Column, critical: Column, warning: Column) -> Column:
    return F.when(critical, "critical").when(warning, "warning").otherwise(F.lit(None).cast("string"))


def job_failures(jobs: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """jobs: job_type, status, updated_at, last_error. Over half failed within the hour is critical, a fifth a warning; a type with three failures is a finding (critical from ten), with its latest error; the `most` worst."""
    recent = jobs.filter((F.col("updated_at") >= as_of - F.expr("interval 1 hour")) & F.col("status").isin("failed", "completed"))
    rate = recent.agg(F.avg((F.col("status") == "failed").cast("double")).alias("rate"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))
    r = F.col("rate")
    level = _level(r, r > 0.5, r >= 0.2)
    whole = _rows(rate, "job-failures", level, F.concat(F.lit("job-failure-rate-"), level), r, F.concat_ws("/", "failed", "total"))
    failed = jobs.filter("status = 'failed'")
    latest = failed.groupBy("job_type").agg(F.max(F.struct("updated_at", "last_error"))["last_error"].alias("last_error"))
    often = failed.filter(F.col("updated_at") >= as_of - F.expr("interval 1 hour")).groupBy("job_type").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    worst = often.orderBy(F.desc("n"), "job_type").limit(most).join(latest, "job_type")
    n = F.col("n")
    types = _rows(worst, "job-failures", _level(n, n >= 10, n >= 3), F.concat(F.lit("job-type-failing-"), "job_type"), n, F.left(F.coalesce("last_error", F.lit("unknown")), F.lit(200)))
    return whole.unionByName(types)


def queue_depth(jobs: DataFrame, as_of: Column) -> DataFrame:
    """jobs: job_type, status, claimed_at. Over 200 pending are a warning, over 500 critical; jobs claimed over 20 minutes ago are stuck (critical from five), with their types."""
    late = (F.col("status") == "processing") & (F.col("claimed_at") < as_of - F.expr("interval 20 minutes"))
    g = jobs.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(late).alias("stuck"), F.array_join(F.array_sort(F.collect_set(F.when(late, F.col("job_type")))), ", ").alias("types"))
    p, s = F.col("pending"), F.col("stuck")
    level = _level(p, p > 500, p > 200)
    depth = _rows(g, "queue-depth", level, F.concat(F.lit("queue-depth-"), level), p, F.lit(None))
    return depth.unionByName(_rows(g, "queue-depth", _level(s, s >= 5, s > 0), F.lit("stuck-jobs"), s, F.col("types")))


def subsystem_recency(jobs: DataFrame, checks: DataFrame, as_of: Column) -> DataFrame:
    """checks: job_type, label, warn_hours, critical_hours. Hours since the last completion; what never completed is no finding."""
    last = jobs.filter("status = 'completed'").groupBy("job_type").agg(F.max("completed_at").alias("last"))
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9
    c = checks.join(last.filter("last is not null"), "job_type").withColumn("hours", hours)
    return _rows(c, "subsystem-recency", _level(hours, F.col("hours") > F.col("critical_hours"), F.col("hours") > F.col("warn_hours")), F.concat(F.lit("subsystem-stale-"), "job_type"), F.col("hours"), F.col("label"))


def model_health(usage: DataFrame, as_of: Column) -> DataFrame:
    """usage: at, fallback, error. Within the hour: over ten fallbacks are critical, three a warning; over five errors a warning."""
    g = usage.filter(F.col("at") >= as_of - F.expr("interval 1 hour")).agg(F.count(F.lit(1)).alias("total"), F.count_if("fallback").alias("fallbacks"), F.count("error").alias("errors"))
    f, e = F.col("fallbacks"), F.col("errors")
    level = _level(f, f > 10, f >= 3)
    falls = _rows(g, "model-health", level, F.concat(F.lit("model-fallback-"), level), f, F.col("total"))
    return falls.unionByName(_rows(g, "model-health", F.when(e > 5, "warning"), F.lit("model-errors-warning"), e, F.col("total")))


def findings(jobs: DataFrame, usage: DataFrame, checks: DataFrame, as_of: Column) -> DataFrame:
    return reduce(DataFrame.unionByName, [job_failures(jobs, as_of), queue_depth(jobs, as_of), subsystem_recency(jobs, checks, as_of), model_health(usage, as_of)])


# --- indices and pairs


def mood_index(wide: DataFrame, ratios: list[str], direct: list[str], hats: list[str], days: int = 30) -> DataFrame:
    """date, mood: the mean of a day's scores, to two places; 0.5 where it has none. Ratios to the mean of the `days` days before count to 1 at most; direct
    values as they are; a hat is 1 from half to one and a half times its mean, falls to 0 at two and a half times, and rises from 0 below half."""
    w = Window.partitionBy(F.lit(0)).orderBy("day_no").rangeBetween(-days, -1)  # a row a day
    rows = wide.withColumn("day_no", F.datediff("date", F.lit("1970-01-01").cast("date")))

    def ratio(c: str) -> Column:
        base = F.avg(c).over(w)
        return F.when(base > 0, F.col(c) / base)

    def hat(c: str) -> Column:
        x = ratio(c)
        return F.when(x > 1.5, F.greatest(F.lit(0.0), 1 - (x - 1.5))).when(x < 0.5, x * 2).when(x.isNotNull(), 1.0)

    scores = [F.when(ratio(c).isNotNull(), F.least(F.lit(1.0), ratio(c))) for c in ratios] + [F.col(c).cast("double") for c in direct] + [hat(c) for c in hats]
    out = rows.withColumn("_s", F.array_compact(F.array(*scores)))
    mean = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.size("_s")
    return out.select("date", F.when(F.size("_s") > 0, F.floor(mean * 100 + 0.5) / 100).otherwise(0.5).alias("mood"))


def invalidated(pairs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """pairs (status, confirmed, exceptions, discovered_at) where pending ones over `days` days old with some confirmations, but more exceptions, become rejected."""
    gone = (F.col("status") == "pending") & (F.col("exceptions") > F.col("confirmed")) & (F.col("confirmed") > 0) & (F.col("discovered_at") < as_of - F.make_dt_interval(F.lit(days)))
    return pairs.withColumn("status", F.when(gone, "rejected").otherwise(F.col("status")))
