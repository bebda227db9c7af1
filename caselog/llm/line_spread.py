"""Cross-site boilerplate lines, by the number of distinct sites that show them.

A HyperLogLog sketch of the sites is built per line hash in every task and merged
by the aggregation, so a line on millions of pages moves one sketch per task. Lines
whose estimate is near the threshold get an exact distinct count. Lines shown by
`min_sites` sites or more are removed from every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.quality_rules import BLANKS
from caselog.llm.tables import with_group
from caselog.session import cut

MIN_SITES = 10
LG_K = 12          # sketch of 4,096 registers: standard error 1.6 %
MARGIN = 0.1       # estimates this near the threshold (relative) are counted exactly

HASHES = ["h1", "h2"]


def _lines(docs: DataFrame, site: Column, *keep: str) -> DataFrame:
    """(*keep, site, h1, h2, pos) of every line with a word, blanks at its ends ignored."""
    cut_text = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select(*keep, site.cast("string").alias("site"), F.posexplode(cut_text).alias("pos", "raw"))
    rows = rows.withColumn("line", F.btrim("raw", F.lit(BLANKS))).filter("line <> ''")
    return rows.select(*keep, "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, site: Column, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """h1, h2, n of the lines shown by at least `min_sites` sites (n: how often). A stored table.

    A null site is none. Lines without a word are not counted.
    """
    lines = _lines(docs, site)
    sketched = lines.groupBy(*HASHES).agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"))
    # A line shown fewer times than there are sites to reach needs no estimate.
    spread = cut(sketched.filter(F.col("n") >= min_sites).select(
        *HASHES, "n", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    near = spread.filter(F.col("sites").between(min_sites * (1 - margin), min_sites * (1 + margin)))
    total = spread.agg(F.sum("n")).first()[0] or 0
    exact = with_group(lines, near, HASHES, total).groupBy(*HASHES).agg(
        F.countDistinct("site").alias("exact"), F.first("n").alias("n")).filter(F.col("exact") >= min_sites)
    sure = spread.filter(F.col("sites") > min_sites * (1 + margin))
    return cut(sure.select(*HASHES, "n").unionByName(exact.select(*HASHES, "n")), "boilerplate")


def without_boilerplate(docs: DataFrame, site: Column, min_sites: int = MIN_SITES) -> DataFrame:
    """Every row of `docs` with n_lines, n_removed, and `text` without boilerplate lines.

    n_lines counts the lines with a word. Other lines, and everything in the lines
    that stay, are left as they were. Null text stays null with no lines. Rows
    without a site show their lines on no site but lose boilerplate like others.
    Repeated rows are returned as often as they occur. Columns n_lines and n_removed of
    `docs` give way to these. An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_removed")
    found = boilerplate(docs, site, min_sites)
    total = found.agg(F.sum("n")).first()[0] or 0
    lines = _lines(docs.withColumn("__hash", F.xxhash64("text")), site, "doc_id", "__hash")
    # Hot lines stay where they are; what meets by document is bounded by its lines.
    removed = cut(with_group(lines, found, HASHES, total).groupBy("doc_id", "__hash").agg(
        F.collect_set("pos").alias("__removed")).select(
        F.col("doc_id").alias("__id"), F.col("__hash").alias("__of"), "__removed"), "removed")
    rows = docs.join(removed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__of")), "left")
    every = F.split("text", "\n")
    rows = rows.withColumn("__lines", every)
    kept = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(
        F.filter("__lines", lambda line, at: ~F.array_contains("__removed", at)), "\n"))
    with_word = F.size(F.filter(F.coalesce("__lines", F.array()), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    return rows.select(
        *[kept.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        with_word.cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"))


SQL = """
WITH lines AS (
    SELECT doc_id, source, pos, raw, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
    FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
          FROM documents)),
spread AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
marked AS (SELECT lines.*, spread.line IS NOT NULL AS gone FROM lines LEFT JOIN spread ON lines.line = spread.line)
SELECT doc_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
       md5(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_md5
FROM marked GROUP BY doc_id
"""
