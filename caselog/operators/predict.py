"""Dense vectors of cases, for classifiers that need them; `cells` has the same in long form."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.log import EventLog, with_case
from caselog.operators.sequence import is_valid


def flat_cases(df: DataFrame, log: EventLog, vec: str = "vec", valid: Column | None = None) -> DataFrame:
    """(case, mean, last, len): mean and last vector of the valid events, and their number.

    A case without a valid event stays, with zeros and `len` 0. All three are
    aggregates with map-side partials: a case is never ordered or collected,
    however long it is. `valid` may give the condition on raw columns, which is
    cheaper than looking at the vector.
    """
    if valid is None:
        valid = is_valid(F.col(vec).cast("array<float>"))
    events = with_case(df, log).select(
        F.col(log.case).alias("case"), F.coalesce(valid, F.lit(False)).alias("__valid"), F.col(vec).alias("__vec"),
        log.order_key().alias("__order"))
    found = events.groupBy("case").agg(
        vector_to_array(Summarizer.sum(array_to_vector(
            F.when(F.col("__valid"), F.col("__vec")).otherwise(blank_of("__vec"))))).alias("total"),
        F.max_by("__vec", F.when(F.col("__valid"), F.col("__order"))).alias("last"),
        F.count(F.when(F.col("__valid"), 1)).alias("len"),
    )
    number = F.greatest(F.col("len"), F.lit(1))
    return found.select("case", F.transform("total", lambda x: x / number).alias("mean"),
                        F.coalesce("last", blank_of("total")).alias("last"), "len")


def blank_of(vec: str) -> Column:
    """As many zeros as `vec` has values."""
    return F.array_repeat(F.lit(0.0), F.size(vec))


def feature_vectors(flat: DataFrame, cases: DataFrame, extra: str = "features") -> DataFrame:
    """`cases` with `input`: mean, last step, length and the case's own features."""
    joined = cases.join(flat, "case")
    parts = F.concat("mean", "last", F.array(F.col("len").cast("double")), F.col(extra))
    return joined.withColumn("input", array_to_vector(parts)).drop("mean", "last", "len")
