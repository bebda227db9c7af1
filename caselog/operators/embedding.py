"""TF-IDF pseudo-embedding of activity-key pairs, in long form.

Each case is a document whose tokens are its events' `activity|key` pairs. The
score of a token in a case is its L2-normalised TF-IDF, min-max scaled over all
cases (a case without the token counts as 0). Only (case, token) pairs that
occur are stored, so the size follows the log and not cases x vocabulary.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.constants import BROADCAST_BYTES, DENSE_WIDTH, MISSING_TEXT, SMALL_ROWS
from caselog.functions.columns import bin_key, concat_present, one_slot, pair_text, pair_tokens
from caselog.log import EventLog, with_case
from caselog.operators.lookup import Lookup, fit_lookup, row_bytes
from caselog.operators.ordered import Ordered, Position
from caselog.session import cut

# Fixed value: a range below ten times the double precision counts as constant.
NO_RANGE = 10 * 2.220446049250313e-16


def keyed(df: DataFrame, log: EventLog, key, exact_tokens: bool = False) -> DataFrame:
    """Events with `key` as text, their `pair`, and the pair's `tokens`.

    An activity with blanks or signs gives a token that is only its tail; the pair
    itself is then no token and scores 0. `exact_tokens` takes every pair whole.
    """
    pair = pair_text(F.col(log.activity).cast("string"), F.col("key"))
    tokens = F.array_compact(F.array("pair")) if exact_tokens else F.coalesce(
        pair_tokens("pair"), F.array().cast("array<string>"))
    return df.withColumn("key", key).withColumn("pair", pair).withColumn("tokens", tokens)


def duration_keyed(df: DataFrame, log: EventLog, bin_column: str = "bin", **options) -> DataFrame:
    numeric = df.schema[bin_column].dataType.simpleString() != "string"
    return keyed(df, log, bin_key(bin_column) if numeric else F.col(bin_column), **options)


def feature_keyed(df: DataFrame, log: EventLog, features: list[str], separator: str = "_",
                  missing: str = MISSING_TEXT, **options) -> DataFrame:
    return keyed(df, log, concat_present(features, separator, missing), **options)


def term_counts(events: DataFrame, log: EventLog) -> DataFrame:
    """(case, token, tf), counted map-side before the shuffle.

    A case with a token-less event also has a row without token, so that the
    number of cases can be read from this table.
    """
    return (
        with_case(events, log).select(F.col(log.case).alias("case"), F.explode_outer("tokens").alias("token"))
        .groupBy("case", "token").agg(F.count(F.lit(1)).alias("tf"))
    )


class TokenTable:
    """Term statistics of a keyed log, counted once and kept in the shared folder.

    Tables with one row per token, and that of all scores, meet their rows as a `Lookup`: sent to all
    executors while their measured bytes are small; beyond, only tokens that many rows hold are.
    """

    def __init__(self, events: DataFrame, log: EventLog, broadcast_bytes: int = BROADCAST_BYTES):
        counted = cut(term_counts(events, log))
        self.limit = broadcast_bytes
        self.terms = counted.filter(F.col("token").isNotNull())
        row = counted.groupBy("case").agg(F.count("token").alias("rows"), F.sum(row_bytes(["token"])).alias("size")).agg(
            F.count(F.lit(1)).alias("cases"), F.sum("rows").alias("rows"), F.sum("size").alias("size")).first()
        self.cases, self.rows, self.bytes = row["cases"], row["rows"] or 0, row["size"] or 0
        self.vocabulary = cut(self.terms.groupBy("token").agg(F.count(F.lit(1)).alias("df")))
        self.words = fit_lookup(self.vocabulary.withColumnRenamed("df", "n"), ["token"], broadcast_bytes)

    def _by_token(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """`right` has one row per token, with `n`, the number of rows in `left`."""
        return Lookup(right, ["token"], self.words.rows, self.words.size, self.limit).join(left)

    def idf(self) -> DataFrame:
        """(token, df, cases, idf): ln((1 + N) / (1 + df)) + 1."""
        n = F.lit(self.cases).cast("long")
        return self.vocabulary.select(
            "token", "df", n.alias("cases"),
            (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))

    def weights(self) -> DataFrame:
        """(case, token, tf, tfidf): tf * idf with unit length per case."""
        weighted = self._by_token(self.terms, self.idf().select("token", "idf", F.col("df").alias("n"))).select(
            "case", "token", "tf", (F.col("tf") * F.col("idf")).alias("weight"))
        square = F.col("weight") * F.col("weight")
        length = weighted.groupBy("case").agg(F.sqrt(F.sum(square)).alias("length"))
        return weighted.join(length, "case").select(
            "case", "token", "tf", (F.col("weight") / F.col("length")).alias("tfidf"))

    def scores(self) -> DataFrame:
        """(case, token, tf, tfidf, score): min-max per token over all cases, absent ones being 0."""
        weights = self.weights()
        everywhere = F.count(F.lit(1)) >= F.lit(self.cases)
        spread = weights.groupBy("token").agg(
            F.when(everywhere, F.min("tfidf")).otherwise(F.lit(0.0)).alias("low"),
            F.max("tfidf").alias("high"), F.count(F.lit(1)).alias("n"),
        )
        span = F.col("high") - F.col("low")
        score = (F.col("tfidf") - F.col("low")) / F.when(span < NO_RANGE, F.lit(1.0)).otherwise(span)
        return self._by_token(weights, spread).select("case", "token", "tf", "tfidf", score.alias("score"))


def embedded(events: DataFrame, log: EventLog, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The keyed log with each event's `score`; 0 where its pair is no token.

    A (case, token) pair that many events hold is sent to where they are, so a case with a large
    share of the log is not gathered in one task.
    """
    terms = TokenTable(events, log, broadcast_bytes)
    scores = terms.scores().select(
        F.col("case").alias(log.case), F.col("token").alias("pair"), F.col("score").alias("__score"), F.col("tf").alias("n"))
    found = Lookup(scores, [log.case, "pair"], terms.rows, terms.bytes, broadcast_bytes).join(events.drop("tokens"), keep=True)
    return found.withColumn("score", F.coalesce("__score", F.lit(0.0))).drop("__score")


def duration_embedding(df: DataFrame, log: EventLog, bin_column: str = "bin", **options) -> DataFrame:
    return embedded(duration_keyed(df, log, bin_column, **options), log)


def feature_embedding(df: DataFrame, log: EventLog, features: list[str], separator: str = "_",
                      missing: str = MISSING_TEXT, **options) -> DataFrame:
    return embedded(feature_keyed(df, log, features, separator, missing, **options), log)


def vocabulary(events: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """(key, slot): the distinct keys of a keyed log in text order, numbered from 0."""
    keys = cut(events.filter(F.col("key").isNotNull()).select("key").distinct())
    return Ordered(keys, [], ["key"], keys.count(), limit).add(slot=Position()).result()


def vocabulary_lookup(events: DataFrame, limit: int = SMALL_ROWS) -> Lookup:
    """The vocabulary of a keyed log as a lookup of `key`, with `slot` and the number of events `n`."""
    keys = cut(events.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    found = fit_lookup(keys, ["key"])
    return replace(found, table=Ordered(keys, [], ["key"], found.rows, limit).add(slot=Position()).result())


def slotted(events: DataFrame, words: DataFrame) -> DataFrame:
    """Embedded events with the `slot` of their key: a sparse vector of one entry."""
    return events.join(words, "key", "left")


def vocabulary_list(events: DataFrame, limit: int = DENSE_WIDTH) -> list[str]:
    """The vocabulary of a keyed log on the driver, for the dense forms; fails beyond `limit` keys."""
    keys = events.filter(F.col("key").isNotNull()).select("key").distinct()
    found = [r["key"] for r in keys.limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} keys: use `slotted` instead of a dense form")
    return sorted(found)


def wide(events: DataFrame, keys: list[str], prefix: str = "key_") -> DataFrame:
    """One score column per key; a projection, since each event has one key."""
    return events.select("*", *[
        F.when(F.col("key") == k, F.col("score")).otherwise(F.lit(0.0)).alias(f"{prefix}{k}") for k in keys
    ])


def dense(keys: list[str]):
    """The event's scores as an array over the vocabulary."""
    place = F.array_position(F.lit(keys).cast("array<string>"), F.col("key")).cast("int")
    return one_slot(place, len(keys), F.col("score"))


def case_documents(events: DataFrame, log: EventLog, pieces: int) -> DataFrame:
    """(case, part, document): each case's pairs in order, joined by blanks.

    Scoring does not need the texts. `events` carry `step`; a long case is cut
    into parts of `pieces` events, so that no row grows with its case.
    """
    return (
        events.withColumn("part", F.floor(F.col("step") / pieces).cast("long"))
        .groupBy(F.col(log.case).alias("case"), "part")
        .agg(F.array_sort(F.collect_list(F.struct("step", "pair"))).alias("items"))
        .select("case", "part", F.array_join(F.col("items.pair"), " ").alias("document"))
    )
