"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Words, their endings (last two characters) and pairs of words are hashed into
buckets. Two multinomials are counted over them, one from trusted texts and one
from the whole corpus. A text's score is the mean over its n-grams of
log(trusted / corpus), so it does not depend on its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 16_384          # bounded by this parameter, whatever the corpus
SMOOTHING = 1.0           # added to every bucket of both multinomials
THRESHOLD = -0.25         # least mean log ratio of a kept text

# The signs counted as symbols, and the blanks around words.
SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t-\r]+"


def words(text: Column) -> Column:
    """Runs outside blanks; no element for blank, empty or null text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def grams(words_column: str, keep: list[str], buckets: int) -> Callable[[DataFrame], DataFrame]:
    """(*keep, bucket) per n-gram of a DataFrame with an array of words; null buckets are none."""
    def rows(df: DataFrame) -> DataFrame:
        at = df.select(*keep, words_column, F.posexplode_outer(words_column).alias("__k", "__word"))
        word, after = F.col("__word"), F.get(words_column, F.col("__k") + 1)
        cells = F.array(
            F.when(word.isNotNull(), _bucket(F.lit(0), word, buckets=buckets)),
            F.when(word.isNotNull(), _bucket(F.lit(1), F.substring(word, -2, 2), buckets=buckets)),
            F.when(after.isNotNull(), _bucket(F.lit(2), word, after, buckets=buckets)))
        return at.select(*keep, F.explode(cells).alias("bucket"))
    return rows


@dataclass(frozen=True)
class Ratio:
    """log(trusted / corpus) of each bucket."""

    weights: list[float]

    def column(self) -> Column:
        text = ",".join(repr(w) for w in self.weights)
        return F.split(F.lit(text), ",").cast("array<double>")  # folded to one literal


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def fit_ratio(docs: DataFrame, trusted: Column, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> Ratio:
    """Counts over all of `docs`; `trusted` marks the rows of the trusted target.

    The n-grams are counted per bucket before they are shuffled. The driver
    gets `buckets` numbers. Null texts have no n-grams; without any trusted
    n-gram all weights are 0.
    """
    held = docs.select(words(F.col("text")).alias("w"), F.coalesce(trusted, F.lit(False)).cast("long").alias("good"))
    rows = held.transform(grams("w", ["good"], buckets)).filter("bucket is not null").groupBy("bucket").agg(
        F.sum("good").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # at most `buckets` rows
    good, whole = [smoothing] * buckets, [smoothing] * buckets
    for row in rows:
        good[row["bucket"]] += row["good"]
        whole[row["bucket"]] += row["n"]
    of_good, of_whole = sum(good), sum(whole)
    if of_good == smoothing * buckets:  # nothing to compare with
        return Ratio([0.0] * buckets)
    return Ratio([round(log(g / of_good) - log(w / of_whole), 6) for g, w in zip(good, whole, strict=True)])


# The repeated three-word windows of a row. Hash and place are packed into one number, so that one sort of
# numbers brings equal hashes together; the full hashes decide. A text of over 2^20 windows packs less of the hash.
_GRAMS = ("slice(transform(sequence(0, greatest(size(__w) - 3, 0)),"
          " k -> xxhash64(get(__w, k), get(__w, k + 1), get(__w, k + 2))), 1, greatest(size(__w) - 2, 0))")
_PACKED = "transform(__g, (h, k) -> (h & ~__mask) | k)"
_AGAIN = ("filter(__sorted, (x, k) -> ((x ^ get(__sorted, k - 1)) & ~__mask) <=> 0L"
          " or ((x ^ get(__sorted, k + 1)) & ~__mask) <=> 0L)")
_COVERED = ("aggregate(__places, named_struct('n', 0L, 'end', 0L),"
            " (a, k) -> named_struct('n', a.n + (k + 3 - greatest(k, a.end)), 'end', k + 3), a -> a.n)")


def base_counts(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with its words `__w` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Everything is computed within a row: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("__w", words(F.col("text")))
    rows = rows.withColumn("__g", F.expr(_GRAMS)).withColumn("__mask", F.expr(
        "shiftleft(1L, greatest(20, int(ceil(log2(size(__w) + 1))))) - 1"))
    rows = rows.withColumn("__sorted", F.sort_array(F.expr(_PACKED)))
    rows = rows.withColumn("__close", F.expr(_AGAIN))
    # Equal packed hashes: their places, by the full hash. Two hashes that agree in the packed
    # part only are told apart here.
    rows = rows.withColumn("__places", F.expr(
        "if(size(__close) = 0, cast(array() as array<bigint>), array_sort(transform(filter(__close, (x, k) ->"
        " __g[int(x & __mask)] <=> __g[int(get(__close, k - 1) & __mask)]"
        " or __g[int(x & __mask)] <=> __g[int(get(__close, k + 1) & __mask)]), x -> x & __mask)))"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    rows = rows.withColumn("__lines", lines)
    return rows.select(
        *docs.columns, "__w",
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_COVERED).alias("n_repeat_words"),
    )


def quality(docs: DataFrame, ratio: Ratio, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, score, kept: one row per row of `docs`.

    Words are runs outside 0x20 and 0x09-0x0D of the whole text. word_chars:
    code points in words; n_symbols: characters of `SYMBOLS`; n_dup_lines: lines
    with a word that equal an earlier line; n_repeat_words: words inside
    three-word windows that occur twice or more. base_failed: under 50 words, or
    over half of them repeated. kept: not base_failed and score >= threshold.

    The n-grams of a row are summed where they are made, and only sums are
    shuffled. Null and empty texts count 0 and fail. Rows without a doc_id are
    judged like any other, and repeated rows returned as often as they occur.
    Other columns are ignored. An empty table gives no rows.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = base_counts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")))
    keys = ["doc_id", "text_hash", *counts]
    at = rows.transform(grams("__w", keys, len(ratio.weights)))
    weights = ratio.column()
    summed = at.groupBy(*keys).agg(
        F.count("bucket").alias("n"), F.sum(F.get(weights, F.col("bucket"))).alias("total"), F.count(F.lit(1)).alias("cells"))
    # Each row made three cells per word, and three without words: equal rows have been summed together.
    copies = F.col("cells") / (3 * F.greatest("n_words", F.lit(1)))
    score = F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n"), 6)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = summed.select("doc_id", *counts, failed.alias("base_failed"), score.alias("score"),
                           F.explode(F.sequence(F.lit(1), F.round(copies).cast("int"))).alias("__copy"))
    return judged.select("doc_id", *counts, "base_failed", "score",
                         (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
