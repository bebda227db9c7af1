"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.session import cut


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, rows: int) -> DataFrame:
    """`docs` with `label`, for at most `rows` labelled documents.

    These are the documents with the smallest hashes of their doc_id among the
    allowed ones, the same at any size and in any order. Null labels are none; a
    doc_id that is labelled twice takes the larger label, one that stands in several rows of
    `docs` gives the text with the smallest hash. Only so many ids are sent to the executors.
    """
    known = labels.filter(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    kept = cut(chosen.withColumnRenamed("doc_id", "__id"), "labelled")
    found = docs.join(F.broadcast(kept), F.col("doc_id") == F.col("__id")).drop("__id")
    order = F.struct(F.xxhash64("text"), F.struct(*sorted(c for c in docs.columns if c in ("text", "lang", "n_chars"))))
    return found.groupBy(F.col("doc_id").alias("__of")).agg(
        F.min_by(F.struct(*found.columns), order).alias("__row")).select("__row.*")
