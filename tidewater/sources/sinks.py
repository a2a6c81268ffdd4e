"""Sinks for Parquet: upserts as pure functions of old and new rows, retention, and an atomic rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], do_nothing: bool = False) -> DataFrame:
    """New rows replace old ones of their key, or are dropped where the key exists. Keys are unique in old and in new."""
    if do_nothing:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def additive_upsert(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str] = (), sets: list[str] = (), least: list[str] = (), most: list[str] = ()) -> DataFrame:
    """Counts add up, arrays unite, first and last dates widen."""
    rows = old.unionByName(new)
    return rows.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in sums), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most)
    )


def coalescing_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values replace old ones unless they are null."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in rest))
    return old.join(n, keys, "full").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in rest))


def versioned_upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """History stays: a new row gets the next version, and the row before points to it in superseded_by."""
    last = old.groupBy(*keys).agg(F.max(version).alias("_v"))
    fresh = new.drop(version).join(last, keys, "left").withColumn(version, F.coalesce("_v", F.lit(0)) + 1).drop("_v").withColumn("superseded_by", F.lit(None).cast("long"))
    done = old.join(fresh.select(*keys, F.col(version).alias("_next")), keys, "left")
    kept = done.withColumn("superseded_by", F.when(F.col("_next").isNotNull() & (F.col(version) == F.col("_next") - 1), F.col("_next")).otherwise(F.col("superseded_by"))).drop("_next")
    return kept.unionByName(fresh.select(kept.columns))


def retain(df: DataFrame, ts: str, as_of: Column, days: int, expires: str | None = None) -> DataFrame:
    """Rows not older than `days` that have not expired."""
    keep = F.col(ts) >= as_of - F.make_dt_interval(F.lit(days))
    return df.filter(keep if expires is None else keep & (F.col(expires).isNull() | (F.col(expires) > as_of)))


def rewrite(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Writes a table beside the old one and puts it in its place by renaming, as a Parquet table can't be read and overwritten in one job.

    A run that dies before the renaming leaves the old table; one that dies within it leaves both, as .next and .before.
    """
    path = path.rstrip("/")
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}.next")
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    now, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".next", ".before"))
    files = now.getFileSystem(conf)
    files.delete(old, True)
    if files.exists(now) and not files.rename(now, old) or not files.rename(new, now):
        raise OSError(f"{path} couldn't be put in place")
    files.delete(old, True)
