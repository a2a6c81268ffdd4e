"""All queries of the library: name -> (spark, sf_dir) -> DataFrame, and the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of tidewater.plans; each has QUERIES and ORACLE.
PLANS = ("signatures", "daily", "aggregates", "joined", "windowed", "statistical", "projected", "graphs", "resolution", "merging", "topical", "relations", "upkeep", "watching", "imported", "persons", "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in PLANS:
        out |= import_module(f"tidewater.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in PLANS:
        out |= import_module(f"tidewater.plans.{name}").ORACLE
    return out
