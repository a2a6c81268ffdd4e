"""Sessions: the defaults that the library's results rest on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "tidewater", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Callers on a cluster give their own master and shared checkpoint folder."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder from spark.checkpoint.dir; only where it is unset (tests) one of this machine."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tidewater-"))
