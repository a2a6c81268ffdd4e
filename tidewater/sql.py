"""Read-only SQL for callers that may look but not touch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_READS = re.compile(r"(?is)^\s*(select|with)\b")


def read_only(spark: SparkSession, query: str, denied: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """The first `limit` rows of one SELECT (or WITH ... SELECT) that names no denied table; anything else is refused."""
    if not _READS.match(query) or ";" in query.rstrip().rstrip(";"):
        raise ValueError("only a single SELECT or WITH statement is allowed")
    named = {w.lower() for w in re.findall(r"\w+", query)}
    if hit := sorted(t for t in denied if t.lower() in named):
        raise ValueError(f"not allowed: {', '.join(hit)}")
    return spark.sql(query.rstrip().rstrip(";")).limit(limit)
