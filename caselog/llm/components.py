"""Connected components of a link table, by repeated shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.tables import fitted
from caselog.session import cut

SENT_ROWS = 100_000  # links of which the smallest neighbours are sent to all executors, and not shuffled


def components(links: DataFrame) -> DataFrame:
    """(node, component): every linked node with the smallest node it can reach.

    `links` has integer columns a and b. Alternates two steps until nothing
    changes: every node's larger neighbours, then its smaller ones, are tied to
    the smallest neighbour. The table of links stays about as long as it began
    and the number of rounds grows as the logarithm of its nodes. Each round is
    a written table, so a lost executor repeats one round. Nothing is collected
    but a count and a checksum. A short table takes few tasks a round, whatever
    the number of shuffle partitions, as each task costs the driver memory. Null
    ends and links of a node with itself are ignored; no links give no rows.
    """
    table = cut(_directed(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    seen = None
    while (state := _state(table)) != seen:
        seen = state
        table = cut(_small_star(_large_star(table, state[0]), state[0]), "links")
    ends = table.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = table.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return ends.unionByName(fitted(roots, seen[0]))


def _directed(links: DataFrame) -> DataFrame:
    return (links.filter("a is not null and b is not null and a <> b")
            .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())


def _state(table: DataFrame) -> tuple:
    row = table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _met(rows: DataFrame, least: DataFrame, key: str, links: int) -> DataFrame:
    """`rows` joined to the smallest neighbour of their `key`, at most two keys for each of the `links`."""
    return rows.join(F.broadcast(fitted(least, 2 * links)) if links <= SENT_ROWS else least, key)


def _large_star(table: DataFrame, links: int) -> DataFrame:
    """(hi, lo) with every larger neighbour tied to the smallest of node and neighbours."""
    both = table.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(
        table.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("lo"))
    # Only the larger neighbours move: rows (lo, hi) of the table, by their smaller end.
    larger = table.select(F.col("lo").alias("node"), F.col("hi"))
    return fitted(_met(larger, least, "node", links).select("hi", "lo").distinct(), links)


def _small_star(table: DataFrame, links: int) -> DataFrame:
    """(hi, lo) with a node and its smaller neighbours tied to the smallest of them."""
    least = table.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = _met(table, least, "hi", links).filter("lo <> least").select(
        F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return fitted(moved.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct(), 2 * links)
