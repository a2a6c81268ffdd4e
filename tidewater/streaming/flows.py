"""Streams over files: exactly-once ingest, sessions, change detection, and running to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def from_files(spark: SparkSession, schema_of: DataFrame, folder: str, names: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """A stream of a folder's Parquet files; names is a pattern of file names."""
    return spark.readStream.schema(schema_of.schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)


def in_time_slices(df: DataFrame, ts: str, slices: int, name: str = "slices") -> str:
    """Writes a table as one file for each of `slices` stretches of time with about as many rows, the earliest first, as sources that land one file after the other.

    The bounds are approximate quantiles (a fixed number of values on the driver); each slice is read with its bounds pushed down.
    Rows without a time are in the first slice. Streams read files in order of their time of writing.
    """
    folder = scratch(df.sparkSession, name)
    at = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    cuts = sorted(set(at.approxQuantile("at", [k / slices for k in range(1, slices)], 0.001)))
    bounds = [F.timestamp_micros(F.lit(int(c))).cast(df.schema[ts].dataType) for c in cuts]
    for k in range(len(bounds) + 1):
        part = F.lit(True) if k == 0 else F.col(ts) >= bounds[k - 1]
        part = part & (F.col(ts) < bounds[k]) if k < len(bounds) else part
        part = part | F.col(ts).isNull() if k == 0 else part
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{folder}")
    return folder


def run_to_end(df: DataFrame, name: str, each_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs a stream over all that is available now. Without each_batch, rows go to Parquet and are read back."""
    spark = df.sparkSession
    out = scratch(spark, name)
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", scratch(spark, f"{name}-log")).outputMode("append")
    if each_batch is not None:
        writer.foreachBatch(each_batch).start().awaitTermination()
        return None
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def deduplicated(df: DataFrame, keys: list[str], ts: str | None = None, within: str | None = None) -> DataFrame:
    """Rows whose keys are new: for ever (state grows with the keys), or within a watermark (bounded state)."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys) if ts and within else df.dropDuplicates(keys)


def sessions(df: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, started, ended, n: a session is out once the watermark has passed its end."""
    s = df.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))
    return s.drop("session_window")


def changed_since(df: DataFrame, marks: DataFrame, source: str, ts: str) -> DataFrame:
    """Rows after their source's mark (sources without a mark: all)."""
    m = marks.select(source, F.col("mark").alias("_mark"))
    return df.join(m, source, "left").filter(F.col("_mark").isNull() | (F.col(ts) > F.col("_mark"))).drop("_mark")


def new_marks(df: DataFrame, marks: DataFrame, source: str, ts: str) -> DataFrame:
    return df.groupBy(source).agg(F.max(ts).alias("mark")).unionByName(marks).groupBy(source).agg(F.max("mark").alias("mark"))
