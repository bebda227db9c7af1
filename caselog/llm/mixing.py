"""Mixing sources to target weights by hierarchical budgets of tokens.

A tree of domain, language and source holds the documents. From the root down, the
budget of a node is shared among its children by weight; a child that has fewer
tokens than its share gives what is left to its siblings by their weights. A node
is never given more than its leaves hold, so shortages reach the siblings first and
an ancestor only when a whole subtree is used up. All amounts are whole numbers.

A leaf reads its documents in epochs, each in an order of its own drawn from the
seed: whole epochs first, then the beginning of one more that fills the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.quality_rules import words
from caselog.llm.tables import with_group
from caselog.session import cut

LEVELS = ("domain", "lang", "source")
NO_VALUE = "(none)"    # branch of documents without a language or source
DRAWER = 4             # hex digits of the order that spread a leaf over tasks

# Parameters of the registered query and the pipeline: domains by the number in the
# source's name, and weights; anything not named weighs 1.
DOMAINS = {0: "web", 1: "news", 2: "forum", 3: "books"}
WEIGHTS = {"domain": {"web": 4, "news": 3, "forum": 2, "books": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def source_domain(source: Column) -> Column:
    number = F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("long"), F.lit(0)) % len(DOMAINS)
    found = F.lit(DOMAINS[0])
    for k, name in DOMAINS.items():
        found = F.when(number == k, name).otherwise(found)
    return found


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    found = F.lit(1)
    for value, weight in weights.get(level, {}).items():
        found = F.when(F.col(level) == value, weight).otherwise(found)
    return found.cast("long")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], tokens: int, epochs: int) -> DataFrame:
    """`leaves` (LEVELS, tokens, n) with `budget`: whole numbers that fill `tokens` as far as they can.

    A leaf's capacity is `epochs` times its tokens.
    """
    held = leaves.withColumn("capacity", F.col("tokens") * epochs)
    parents = held.agg(F.least(F.coalesce(F.sum("capacity"), F.lit(0)), F.lit(tokens)).alias("budget"))
    path: list[str] = []
    for level in LEVELS:
        nodes = held.groupBy(*path, level).agg(F.sum("capacity").alias("capacity"))
        if path:
            nodes = nodes.join(parents.withColumnRenamed("budget", "given"), path)
        else:
            nodes = nodes.withColumn("given", F.lit(parents.first()["budget"]))
        parents = cut(_shared(nodes, path, level, weights), "budgets")
        path = [*path, level]
    return leaves.join(parents.select(*LEVELS, "budget"), list(LEVELS))


def _shared(nodes: DataFrame, path: list[str], level: str, weights: dict) -> DataFrame:
    """(path, level, budget): the children of each node, filled in order of capacity by weight."""
    own = Window.partitionBy(*path)
    order = own.orderBy("need", level)
    rows = nodes.withColumn("w", _weight(level, weights)).withColumn("need", F.col("capacity") / F.col("w"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn(
        "weight_left", F.sum("w").over(own) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # A child is full if its fair share of what is left covers its capacity.
    rows = rows.withColumn("full", F.col("capacity") * F.col("weight_left") <= F.col("w") * F.col("left"))
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(own), F.lit(0))
    rest = F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(own), F.lit(0))
    rows = rows.withColumn("rest", rest).withColumn("open_weight", open_weight)
    rows = rows.withColumn("part", F.when(~F.col("full"), F.expr("(w * rest) div open_weight")))
    spare = F.col("rest") - F.coalesce(F.sum("part").over(own), F.lit(0))
    number = F.sum(F.when(F.col("full"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("spare", spare).withColumn("number", number)
    return rows.select(*path, level, F.when(F.col("full"), F.col("capacity")).otherwise(
        F.col("part") + F.when(F.col("number") <= F.col("spare"), 1).otherwise(0)).cast("long").alias("budget"))


def mixed(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, percent: int = 50, epochs: int = 2,
          seed: int = 7, domain: Column | None = None) -> DataFrame:
    """doc_id, text_hash, epoch, domain, lang, source, n_tokens, tokens_taken of the selected documents.

    The budget is `percent` of all tokens (words of the whole texts). A document
    that is taken in several epochs gives a row for each. `tokens_taken` is
    n_tokens, but for the one document of a leaf that the budget cuts. Within an
    epoch documents come by md5 of seed, epoch and doc_id, equal ones by text.

    A null language or source is a branch of its own; rows without a doc_id are
    ordered as id "". Null and empty texts hold no tokens and come along only in
    whole epochs of a leaf that has tokens. Repeated rows count as often as they
    occur. Other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        (source_domain(F.col("source")) if domain is None else domain).alias("domain"),
        F.coalesce(F.col("lang"), F.lit(NO_VALUE)).alias("lang"),
        F.coalesce(F.col("source"), F.lit(NO_VALUE)).alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    rows = cut(rows.withColumn("domain", F.coalesce("domain", F.lit(NO_VALUE))), "lengths")
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
    total, n = leaves.agg(F.sum("tokens"), F.sum("n")).first()
    given = cut(budgets(leaves, weights, (total or 0) * percent // 100, epochs).withColumn(
        "whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))).withColumn(
        "rest", F.col("budget") - F.col("whole") * F.col("tokens")).select(*LEVELS, "n", "whole", "rest"), "given")

    at = with_group(rows, given, list(LEVELS), n or 0).withColumn(
        "key", F.md5(F.concat(F.lit(f"{seed}:"), (F.col("whole") + 1).cast("string"), F.lit(":"),
                              F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    at = at.withColumn("drawer", F.substring("key", 1, DRAWER))
    # A leaf's order is cut into drawers; the tokens before a drawer are sums, the rest is counted inside it.
    sums = at.groupBy(*LEVELS, "drawer").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.partitionBy(*LEVELS).orderBy("drawer").rowsBetween(Window.unboundedPreceding, -1)
    drawers = sums.select(*LEVELS, "drawer", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*LEVELS, "drawer").orderBy("key", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = at.join(drawers, [*LEVELS, "drawer"]).withColumn(
        "before", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    more = F.when(F.col("before") < F.col("rest"), F.col("whole") + 1).otherwise(F.col("whole"))
    taken = placed.withColumn("last", more).filter("last > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))))
    return taken.select(
        "doc_id", "text_hash", "epoch", *LEVELS, "n_tokens",
        F.when(F.col("epoch") <= F.col("whole"), F.col("n_tokens")).otherwise(
            F.least("n_tokens", F.col("rest") - F.col("before"))).alias("tokens_taken"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` as the mixture holds them: once per epoch, uncut documents only.

    Rows that repeat a doc_id and a text are taken together if one of them is taken.
    """
    chosen = cut(mixed(docs, **options).filter("tokens_taken = n_tokens").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "epoch").distinct(), "chosen")
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (
        F.xxhash64("text") == F.col("__hash"))).select(*[docs[c] for c in docs.columns])


def _sql() -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    def level_sql(level: str, path: list[str], parent: str | None) -> str:
        keys = ", ".join([*path, level])
        by = f"PARTITION BY {', '.join(path)}" if path else ""
        given = (f"JOIN (SELECT {', '.join(path)}, budget AS given FROM {parent}) USING ({', '.join(path)})"
                 if path else "CROSS JOIN (SELECT least(sum(capacity), sum(tokens) * 50 // 100) AS given FROM leaves)")
        prior = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        return f"""
{level}_0 AS (SELECT *, {weight(level)} AS w, capacity / ({weight(level)}) AS need
    FROM (SELECT {keys}, sum(capacity)::BIGINT AS capacity FROM leaves GROUP BY {keys}) {given}),
{level}_1 AS (SELECT *,
    given - coalesce(sum(capacity) OVER ({by} ORDER BY need, {level} {prior}), 0) AS remaining,
    sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by} ORDER BY need, {level} {prior}), 0) AS weight_left
    FROM {level}_0),
{level}_2 AS (SELECT *, capacity * weight_left <= w * remaining AS filled FROM {level}_1),
{level}_3 AS (SELECT *,
    given - coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0) AS rest,
    sum(w) FILTER (NOT filled) OVER ({by}) AS open_weight,
    count(*) FILTER (NOT filled) OVER ({by} ORDER BY need, {level} ROWS UNBOUNDED PRECEDING) AS number
    FROM {level}_2),
{level}_4 AS (SELECT *, CASE WHEN filled THEN NULL ELSE (w * rest) // open_weight END AS part FROM {level}_3),
{level}_5 AS (SELECT {keys}, (CASE WHEN filled THEN capacity ELSE part + CASE WHEN number <=
    rest - coalesce(sum(part) OVER ({by}), 0) THEN 1 ELSE 0 END END)::BIGINT AS budget FROM {level}_4)"""

    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    domain = " ".join(f"WHEN {k} THEN '{v}'" for k, v in DOMAINS.items())
    return f"""
WITH lengths AS (
    SELECT doc_id, CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), 0) % {len(DOMAINS)}
               {domain} END AS domain,
           coalesce(lang, '{NO_VALUE}') AS lang, coalesce(source, '{NO_VALUE}') AS source,
           CASE WHEN trim(coalesce(text, ''), {blanks}) = '' THEN 0 ELSE
               len(regexp_split_to_array(trim(text, {blanks}), '[ \\t-\\r]+')) END::BIGINT AS n_tokens
    FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * 2)::BIGINT AS capacity
    FROM lengths GROUP BY ALL),
{level_sql("domain", [], None)},
{level_sql("lang", ["domain"], "domain_5")},
{level_sql("source", ["domain", "lang"], "lang_5")},
given AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole,
    budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest
    FROM source_5 JOIN leaves USING (domain, lang, source)),
placed AS (SELECT lengths.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
    ORDER BY md5('7:' || (whole + 1) || ':' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM lengths JOIN given USING (domain, lang, source))
SELECT doc_id, epoch::BIGINT AS epoch, domain, lang, source, n_tokens,
       (CASE WHEN epoch <= whole THEN n_tokens ELSE least(n_tokens, rest - before) END)::BIGINT AS tokens_taken
FROM (SELECT *, unnest(range(1, (CASE WHEN before < rest THEN whole + 1 ELSE whole END)::BIGINT + 1)) AS epoch FROM placed)
"""


SQL = _sql()
