"""Many sources as one table: each branch is checked by itself, so that one that is missing or ill-typed costs its rows only, and says so."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NullType, StructType


@dataclass(frozen=True)
class Branch:
    """load gives the source; columns: expressions over it, by name in the common table (left out: null); where: a condition."""

    name: str
    load: Callable[[], DataFrame]
    columns: dict[str, str]
    where: str = "true"


@dataclass(frozen=True)
class Gathered:
    rows: DataFrame  #: source, and the columns of the common schema
    status: DataFrame  #: source, status (ok, missing, no_column, ill_typed, unreadable), detail


def _fits(have: DataType, want: DataType) -> bool:
    """Only widening is done in silence: equal types, any nulls, numbers to wider numbers, dates to times, and these within arrays."""
    if have == want or isinstance(have, NullType):
        return True
    if have.typeName() == want.typeName() == "array":
        return _fits(have.elementType, want.elementType)
    order = ["byte", "short", "integer", "long", "float", "double"]
    a, b = have.typeName(), want.typeName()
    return a in order and b in order and order.index(a) < order.index(b) or (a, b) in (("date", "timestamp"), ("date", "timestamp_ntz"))


def _check(branch: Branch, schema: StructType, probe: bool) -> tuple[DataFrame | None, str, str]:
    try:
        source = branch.load()
        source.schema  # noqa: B018 (reads the footer of a file that is there)
    except (PySparkException, Py4JJavaError) as e:
        return None, "missing", type(e).__name__
    try:
        rows = source.filter(branch.where).select(*(F.expr(branch.columns.get(f.name, "null")).alias(f.name) for f in schema))
    except PySparkException as e:
        return None, "no_column" if "UNRESOLVED" in str(e.getCondition()) else "ill_typed", str(e.getCondition())
    bad = [f"{f.name}: {rows.schema[f.name].dataType.simpleString()}" for f in schema if not _fits(rows.schema[f.name].dataType, f.dataType)]
    if bad:
        return None, "ill_typed", ", ".join(bad)
    rows = rows.select(F.lit(branch.name).alias("source"), *(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    if probe:
        try:
            rows.limit(1).collect()
        except (PySparkException, Py4JJavaError) as e:
            return None, "unreadable", type(e).__name__
    return rows, "ok", ""


def gather(spark: SparkSession, branches: list[Branch], schema: StructType, probe: bool = False) -> Gathered:
    """The union of the branches that fit the schema, and the status of all. probe: reads a row of each, which finds files that can't be read."""
    checked = [(b.name, *_check(b, schema, probe)) for b in branches]
    good = [rows for _, rows, _, _ in checked if rows is not None]
    none = spark.createDataFrame([], StructType([*spark.range(0).select(F.lit("").alias("source")).schema, *schema]))
    rows = reduce(DataFrame.unionByName, good) if good else none
    return Gathered(rows, spark.createDataFrame([(n, s, d) for n, _, s, d in checked], "source string, status string, detail string"))


def waiting(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
