"""Benchmark decontamination by spaced seeds.

A seed reads the tokens of a window at fixed positions and ignores the others,
so it still matches when an ignored token was replaced. The two masks below
were searched so that every aligned window of 13 tokens with at most two
replaced ones holds a full match of one of them (a test goes through all 78
ways). Test seeds are joined to the seeds at every position of every training
text; a hit is then confirmed by comparing the aligned tokens around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.tables import same, sent_if_small
from caselog.session import cut

MASKS = ((0, 3, 7, 8, 9, 10), (0, 1, 2, 3, 5, 6))
WINDOW = 13      # aligned tokens compared
REPLACED = 2     # of these, so many may differ
LEAST = 8        # tokens of a test item that can be matched
SPAN = 1 + max(mask[-1] for mask in MASKS)


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(tokens: str, at: str) -> Column:
    """One hash per mask at 0-based position `at`; null where the mask reaches past the end."""
    cells = []
    for number, mask in enumerate(MASKS):
        # get() is null beyond the end; the last place decides.
        picked = [F.get(F.col(tokens), F.col(at) + F.lit(k)) for k in mask]
        cells.append(F.when(F.col(at) + F.lit(mask[-1]) < F.size(tokens), F.xxhash64(F.lit(number), *picked)))
    return F.array(*cells)


def _positions(df: DataFrame, keep: list[str], tokens: str, at: str) -> DataFrame:
    """A row per token position and mask, with its seed.

    The outer form keeps Spark from deriving a filter on the array's size, which
    would compute the tokens twice; empty texts give a null seed.
    """
    rows = df.select(*keep, tokens, F.posexplode_outer(tokens).alias(at, "__token"))
    return rows.withColumn("seed", F.explode(_seeds(tokens, at)))


def overlaps(docs: DataFrame, benchmark: DataFrame, item: str = "item_id") -> DataFrame:
    """doc_id, text_hash, item_id, doc_start, item_start, n_tokens, n_equal of confirmed overlaps.

    A document overlaps an item if, at some alignment, a window of 13 tokens
    (an item of 8 to 12 tokens: all of it) has at most 2 replaced tokens (such
    an item: none). Each (document, item) gives one row: the span from the
    first to the last such window, in token positions of the document, and the
    most equal tokens found in one window. Tokens are lower-cased runs of
    letters and digits, so case and punctuation don't matter.

    Null and empty texts and items of under 8 tokens overlap nothing. Rows that
    repeat a doc_id and a text count once; a null doc_id or item id stays null
    in the result. Repeated items each give their row. Other columns are
    ignored. Empty tables give no rows.
    """
    items = benchmark.select(F.col(item).alias("item_id"), token_hashes(F.col("text")).alias("item")).filter(
        F.size("item") >= LEAST)
    tests = _positions(items, ["item_id"], "item", "item_at").filter("seed is not null").withColumn(
        "width", F.least(F.size("item"), F.lit(WINDOW)))
    # What of the item can be in one window with the hit, and where that begins.
    tests = tests.withColumn("low", F.greatest(F.lit(0), F.col("item_at") - F.lit(WINDOW - 1))).withColumn(
        "around", F.slice("item", F.col("low") + 1, 2 * WINDOW + SPAN)).select(
        "seed", "item_id", "item_at", "width", "low", "around")
    seeds = cut(tests, "seeds")

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), token_hashes(F.col("text")).alias("doc"))
    trained = _positions(texts, ["doc_id", "text_hash"], "doc", "doc_at").select(
        "doc_id", "text_hash", "doc_at", "seed")
    # Only hits leave the scan, one per place of the item; copies of a text make no more of them.
    hits = cut(trained.join(sent_if_small(seeds.select("seed", "item_id", "item_at"), 64), "seed").groupBy(
        "doc_id", "text_hash", "item_id", "doc_at", "item_at").agg(F.count(F.lit(1)).alias("n")), "hits")
    places = hits.join(sent_if_small(seeds.drop("seed").distinct(), 64 + 8 * (2 * WINDOW + SPAN)), [
        hits["item_id"].eqNullSafe(seeds["item_id"]), hits["item_at"] == seeds["item_at"]]).select(
        hits["doc_id"], hits["text_hash"], hits["item_id"], "width", "low", "around",
        (F.col("doc_at") - hits["item_at"] + F.col("low")).alias("begin"))
    return _verified(texts, hits, places)


def _verified(texts: DataFrame, hits: DataFrame, places: DataFrame) -> DataFrame:
    """Spans of the places whose aligned tokens agree well enough."""
    wanted = sent_if_small(cut(hits.select("doc_id", "text_hash").distinct(), "hit_texts"), 32)
    mine = cut(texts.join(wanted, same(texts, wanted, ["doc_id", "text_hash"]), "left_semi").dropDuplicates(
        ["doc_id", "text_hash"]), "texts")
    aligned = places.join(mine, same(places, mine, ["doc_id", "text_hash"])).select(
        places["doc_id"], places["text_hash"], "item_id", "width", "low", "around", "begin", "doc")
    # The document's tokens aligned with `around`; places before its start differ.
    aligned = aligned.withColumn("equal", F.expr(
        "transform(around, (t, k) -> if(begin + k >= 0 and get(doc, begin + k) <=> t, 1, 0))"))
    window = F.expr(
        "transform(sequence(0, greatest(size(equal) - width, 0)),"
        " k -> named_struct('n', aggregate(slice(equal, k + 1, width), 0, (a, x) -> a + x), 'k', k))")
    allowed = F.when(F.col("width") < WINDOW, 0).otherwise(REPLACED)
    good = F.filter("windows", lambda w: w["n"] >= F.col("width") - F.col("allowed"))
    passed = aligned.select("doc_id", "text_hash", "item_id", "width", "begin", "low", window.alias("windows"),
                            allowed.alias("allowed")).withColumn("good", good).filter(F.size("good") > 0)
    ends = passed.select(
        "doc_id", "text_hash", "item_id",
        (F.col("begin") + F.col("good")[0]["k"]).alias("first"),
        (F.col("low") + F.col("good")[0]["k"]).alias("item_first"),
        (F.col("begin") + F.element_at("good", -1)["k"] + F.col("width")).alias("last"),
        F.array_max(F.transform("good", lambda w: w["n"])).alias("n"))
    return ends.groupBy("doc_id", "text_hash", "item_id").agg(
        F.min("first").cast("long").alias("doc_start"), F.min("item_first").cast("long").alias("item_start"),
        (F.max("last") - F.min("first")).cast("long").alias("n_tokens"), F.max("n").cast("long").alias("n_equal"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap no item of `benchmark`."""
    found = cut(overlaps(docs, benchmark).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "overlaps")
    bad = sent_if_small(found, 32)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(bad, same, "left_anti")
