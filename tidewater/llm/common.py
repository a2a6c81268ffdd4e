"""Helpers that the corpus operators share: scratch tables, checked broadcasts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where it is unset (tests) a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared scratch folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a scratch table that no later plan reads."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], max_rows: int, how: str = "left") -> DataFrame:
    """Joins a per-key table: broadcast when a count shows at most max_rows rows, else by a shuffle that AQE may split."""
    small = len(right.select(F.lit(1)).limit(max_rows + 1).groupBy().count().filter(F.col("count") <= max_rows).take(1)) == 1
    return left.join(F.broadcast(right) if small else right, on, how)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what a task holds as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Sets Arrow batches of at most so many rows where the session has Spark's own 10,000: texts are long, and batches lie outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def schema_with(df: DataFrame, extra: str) -> str:
    """DDL of df's columns and then of extra."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), extra])
