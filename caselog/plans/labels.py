"""Class labels, for any number of classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.constants import SMALL_ROWS
from caselog.operators.ordered import Ordered, Position
from caselog.session import cut


def label_table(cases: DataFrame, label: str, limit: int = SMALL_ROWS) -> tuple[DataFrame, int]:
    """(label, label_id): the classes in order, numbered from 0, and their number."""
    found = cut(cases.filter(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct(), "classes")
    number = found.count()
    ranked = Ordered(found, [], ["label"], number, limit).add(place=Position()).result()
    return ranked.select("label", F.col("place").cast("int").alias("label_id")), number
