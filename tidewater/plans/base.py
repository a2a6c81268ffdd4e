"""What the query modules share: a registry and the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries of one module and their SQL, filled by a decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grams_sql(x: str) -> str:
    """Distinct trigrams of the words of x."""
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def jaccard_sql(x: str, y: str) -> str:
    return f"coalesce(len(list_intersect({x}, {y})) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0.0)"


def name_similarity_sql(a: str, b: str) -> str:
    """The rules on parts of a name, for names in lower case with single blanks."""
    x, y = f"string_split({a}, ' ')", f"string_split({b}, ' ')"
    pairs = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
    p, q = pairs.format(a), pairs.format(b)
    dice = f"coalesce(2.0 * len(list_intersect({p}, {q})) / nullif(len({p}) + len({q}), 0), 0.0)"
    many, one = f"len({x}) > 1 AND len({y}) > 1", f"(len({x}) = 1 OR len({y}) = 1)"
    return f"""CASE WHEN {a} = {b} THEN 1.0 WHEN {many} AND {x}[1] = {y}[1] AND {x}[-1] = {y}[-1] THEN 0.95 WHEN {many} AND {x}[-1] = {y}[-1] THEN 0.45 WHEN {one} AND {x}[1] = {y}[1] THEN 0.7 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.65 ELSE {dice} END"""
