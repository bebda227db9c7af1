"""Word index and text sequences, in long form: one row per word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.constants import BROADCAST_BYTES, CASE_ROWS, PAD_WORD, SMALL_ROWS
from caselog.functions.columns import word_tokens
from caselog.log import CaseProfile, EventLog, case_profile, with_case
from caselog.operators.lookup import Lookup, row_bytes
from caselog.operators.ordered import Ordered, Position
from caselog.operators.sequence import log_lengths, pad_steps, with_steps
from caselog.session import cut


def word_counts(df: DataFrame, log: EventLog, text: str) -> DataFrame:
    """(word, n, first): occurrences, and where the word is seen first in the log."""
    words = df.select(log.row_key().alias("row"), F.posexplode(word_tokens(text)).alias("place", "word"))
    return words.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("first"))


class WordIndex:
    """Words numbered from 1 by falling count, the one seen first before on ties."""

    def __init__(self, df: DataFrame, log: EventLog, text: str, limit: int = SMALL_ROWS,
                 broadcast_bytes: int = BROADCAST_BYTES):
        counts = cut(word_counts(df, log, text))
        row = counts.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(["word"])), F.lit(0)).alias("size")).first()
        self.words = row["rows"]
        ranked = Ordered(counts, [], [F.desc("n"), "first"], self.words, limit)
        self.table = ranked.add(place=Position()).result().select(
            "word", "n", (F.col("place") + 1).alias("word_id"))
        self.lookup = Lookup(self.table, ["word"], self.words, row["size"], broadcast_bytes)

    @property
    def size(self) -> int:
        """Vocabulary size, the padding id included."""
        return self.words + 1

    def ids(self, words: DataFrame) -> DataFrame:
        """`words` with their `word_id`. While the index is small in bytes it is sent to all
        executors; beyond, only frequent words are, whose rows stay where they are."""
        return self.lookup.join(words)


def text_steps(df: DataFrame, log: EventLog, text: str, index: WordIndex,
               profile: CaseProfile | None = None, limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, place, word_id) of every word of every event."""
    events = with_steps(df, log, profile, limit)
    words = events.select(
        F.col(log.case).alias("case"), "step", F.posexplode(word_tokens(text)).alias("place", "word"))
    return index.ids(words).select("case", "step", "place", "word_id")


def text_width(df: DataFrame, log: EventLog, text: str) -> int:
    """Most words of an event; a missing text has none."""
    return with_case(df, log).agg(F.max(word_number(text)).alias("n")).first()["n"] or 0


def word_number(text: str):
    return F.size(F.coalesce(word_tokens(text), F.array().cast("array<string>")))


def padded_text(df: DataFrame, log: EventLog, text: str, index: WordIndex, eos: bool = True,
                limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, vec): word ids of every event, padded by 0 to the widest event.

    The closing step and the padding steps consist of the same 0.
    """
    profile, width = case_profile(df, log), text_width(df, log, text)
    words = text_steps(df, log, text, index, profile, limit)
    filled = words.groupBy("case", "step").agg(
        F.array_sort(F.collect_list(F.struct("place", "word_id"))).alias("items"))
    ids = F.col("items.word_id")
    blank = F.lit(PAD_WORD).cast("long")
    vec = F.concat(ids, F.array_repeat(blank, F.lit(width) - F.size("items")))
    wordy = filled.select("case", "step", vec.alias("vec"))
    lengths = log_lengths(df, log)
    empty = with_steps(df, log, profile, limit).filter(word_number(text) == 0).select(
        F.col(log.case).alias("case"), "step", F.array_repeat(blank, width).alias("vec"))
    return wordy.unionByName(empty).unionByName(
        pad_steps(lengths, width, profile.longest + int(eos), PAD_WORD, "long"))
