"""Joins that stay whole and even when one key holds a large part of all rows."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20  # a side is sent to all executors only if its rows are counted to stay below this

BATCH_ROWS = 1000            # worked on at once in Python
TASK_ROWS = 20_000           # narrow rows that a task takes at least, where a step is fitted to its rows
HOT_SHARE = 1000  # a group of over this share of all rows is not gathered by its key


def sent_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, a stored table, marked for broadcast if its counted rows are small.

    Beyond the limit it is returned as it is, and the join shuffles.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of at most `rows` narrow rows, in no more tasks than they fill.

    Partitions are only joined, never split: a long table keeps its own number.
    """
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` joined to the stored facts of their group, which hold its row count `n`.

    Groups of over a thousandth of the `total` rows are fewer than a thousand, so
    they are sent to all executors and their rows stay where they are; only the
    others meet by their key.
    """
    hot = F.broadcast(groups.filter(F.col("n") * HOT_SHARE > total))
    rest = groups.filter(F.col("n") * HOT_SHARE <= total)
    cold = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cold.join(rest, keys))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys in which null equals null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def map_columns(df: DataFrame, inputs: dict[str, Column], schema: str, work: Callable) -> DataFrame:
    """`work` over the record batches of the named inputs only.

    Other columns of `df`, whatever their names, are not sent to Python.
    `work` maps one `pa.RecordBatch` to any number of batches.
    """

    def run(batches):
        for batch in batches:
            # Spark's batches have a number of rows, not of bytes: long texts come in small pieces.
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield from work(batch.slice(at, BATCH_ROWS))
        give_back()

    return df.select(*[c.alias(n) for n, c in inputs.items()]).mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that this Python worker holds but does not use: it lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()],
        names=list(columns))
