"""Row-level expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselog.constants import (
    MISSING_NUMBER,
    MISSING_TEXT,
    PAIR_SEPARATOR,
    PAIR_TOKEN,
    WORD_BLANKS,
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_minutes(seconds: Column | str) -> Column:
    """Started minutes of a duration in seconds."""
    return F.ceil(as_column(seconds).cast("double") / F.lit(60.0)).cast("double")


def number_or_null(c: Column | str) -> Column:
    """As double, NaN counted as missing."""
    d = as_column(c).cast("double")
    return F.when(~F.isnan(d), d)


def missing_to_null(c: Column | str) -> Column:
    """As double, with both NaN and the missing marker as null."""
    d = number_or_null(c)
    return F.when(d != F.lit(float(MISSING_NUMBER)), d)


def concat_present(columns: Sequence[str], separator: str = "_",
                   missing: str = MISSING_TEXT) -> Column:
    """The columns' non-missing values as one text; '' when all are missing."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws(separator, *[F.when(t != missing, t) for t in texts])


def bin_key(c: Column | str) -> Column:
    """Bin as text: whole numbers without a decimal point."""
    d = as_column(c)
    return F.when(d == F.floor(d), d.cast("long").cast("string")).otherwise(d.cast("string"))


def pair_text(activity: Column | str, key: Column | str) -> Column:
    return F.concat(as_column(activity), F.lit(PAIR_SEPARATOR), as_column(key))


def pair_tokens(pair: Column | str) -> Column:
    """All `word|word` tokens of a pair text."""
    return F.regexp_extract_all(as_column(pair), F.lit(PAIR_TOKEN), F.lit(0))


def word_tokens(text: Column | str) -> Column:
    """Lower-case words, split at blanks and punctuation."""
    blanked = F.translate(as_column(text), WORD_BLANKS, " " * len(WORD_BLANKS))
    return F.array_remove(F.split(F.lower(blanked), " "), "")


def argmax(values: Column | str) -> Column:
    """0-based index of the first maximum."""
    v = as_column(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_slot(place: Column, width: int, value: Column) -> Column:
    """Array of `width` zeros with `value` at the 1-based `place`; all zeros for null or 0."""
    zero = F.lit(0.0)
    filled = F.concat(F.array_repeat(zero, place - 1), F.array(value), F.array_repeat(zero, F.lit(width) - place))
    return F.when(place > 0, filled).otherwise(F.array_repeat(zero, width))


def truncated(c: Column | str) -> Column:
    """Towards zero, as double."""
    return as_column(c).cast("long").cast("double")


def step_value(c: Column, edges: Sequence[float], values: Sequence) -> Column:
    """`values[i]` for the last `edges[i] <= c`, null below the first edge.

    Written as a balanced tree of comparisons on literals, so that a row costs
    log2(edges) compiled comparisons and no lookup table is shipped.
    """

    def pick(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(values[low])
        middle = (low + high) // 2
        return F.when(c < F.lit(edges[middle]), pick(low, middle)).otherwise(pick(middle, high))

    if not edges:
        return F.lit(None)
    return F.when(c >= F.lit(edges[0]), pick(0, len(edges)))
