"""Registry of named queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, and its SQL where there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def long(column, name: str):
    return column.cast("long").alias(name)


def cells(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """One row per array element: (keys, slot, value), rounded.

    The arrays are never empty; the outer form keeps Spark from deriving a filter
    on their size, which would evaluate them twice.
    """
    rows = df.select(*keys, F.posexplode_outer(vec).alias("slot", "value"))
    return rows.select(*keys, F.col("slot").cast("long").alias("slot"),
                       F.round(F.col("value").cast("double"), 6).alias("value"))
