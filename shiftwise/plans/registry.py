"""Registry of the driver queries: name -> (Spark builder, oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
test tables.  The oracle SQL is the same question in plain SQL (DuckDB
dialect) over views with the same table names.  Output columns are aliased
identically on both sides and cast to simple types (bigint, double, string)
so results compare value by value.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shiftwise.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a driver query; ``oracle=None`` marks a rows-only check."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from shiftwise.plans import helpers, ml, quality, relational, reports, scalars, streams, text, warehouse  # noqa: F401
