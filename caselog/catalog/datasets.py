"""Case table, assembly and split queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from caselog.catalog.embedding import BINNED, DURATION_KEYS, FEATURE_KEYS, FEATURES, TOKENS, VOCABULARY, binned
from caselog.catalog.encoding import CATEGORIES, CELLS, NUMBERS, vector_sql
from caselog.catalog.registry import query
from caselog.catalog.sql import BLANKS, CASES, EV, with_
from caselog.log import case_table
from caselog.operators import dataset as d
from caselog.plans.features import Inputs, assembled_cells, with_placeholder
from caselog.sources.views import EVENTS, customer_cases, event_log


@query("first_non_null_case_table", with_(EV) + """
SELECT case_id, arg_min(activity, (start_ts, event_id)) AS activity,
  round(arg_min(nullif(amount, -1), (start_ts, event_id)) FILTER (amount <> -1), 6) AS amount
FROM ev GROUP BY case_id""")
def first_non_null_case_table(spark, folder):
    log = event_log(spark, folder).withColumn("amount", F.nullif("amount", F.lit(-1.0)))
    return case_table(log, EVENTS, ["activity", "amount"]).withColumn("amount", F.round("amount", 6))


def renamed(sql: str, suffix: str) -> str:
    """The CTEs of an embedding under other names."""
    return re.sub(r"\b(keyed|tokens|tf|idf|weights|spread|scores|embedded|vocab)\b", rf"\1{suffix}", sql)


EVENT_WORDS = f"""words AS (
  SELECT case_id, event_id, start_ts, place - 1 AS place, word FROM (
    SELECT case_id, event_id, start_ts, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM (
      SELECT case_id, event_id, start_ts, list_filter(string_split(lower(translate(activity,
        '{BLANKS}' || chr(9) || chr(10), repeat(' ', {len(BLANKS) + 2}))), ' '), lambda w : w <> '') AS ws
      FROM ev))),
idx AS (
  SELECT word, row_number() OVER (ORDER BY n DESC, first) AS word_id FROM (
    SELECT word, count(*) AS n, min((case_id, start_ts, event_id, place)) AS first FROM words GROUP BY word))"""

ASSEMBLED = with_(
    *BINNED, DURATION_KEYS, TOKENS, VOCABULARY, renamed(FEATURE_KEYS, "_f"), renamed(TOKENS, "_f"), renamed(VOCABULARY, "_f"),
    EVENT_WORDS, CASES, vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>"), CELLS,
    vector_sql("cases", ["case_id"], ["nation"], ["balance"], median=True, name="cvec"), """labels AS (
  SELECT result, row_number() OVER (ORDER BY result) - 1 AS label_id FROM (SELECT DISTINCT result FROM cases)),
wanted AS (SELECT case_id, CAST(label_id AS INTEGER) AS label_id FROM cases JOIN labels USING (result)
  WHERE case_id IN (SELECT case_id FROM ev)),
widths AS (
  SELECT (SELECT max(slot) + 1 FROM vectors) AS e, (SELECT count(*) FROM vocab) AS d, (SELECT count(*) FROM vocab_f) AS f,
    (SELECT max(place) + 1 FROM words) AS t),
all_cells AS (
  SELECT case_id, 'event' AS input, slot, span, value FROM cells_ JOIN ev USING (event_id)
  UNION ALL SELECT case_id, 'duration', e + slot, 1, score FROM embedded JOIN vocab USING (key), widths WHERE score <> 0
  UNION ALL SELECT case_id, 'feature', e + d + slot, 1, score_f.score FROM embedded_f AS score_f JOIN vocab_f USING (key), widths WHERE score <> 0
  UNION ALL SELECT case_id, 'text', e + d + f + place, 1, word_id FROM words JOIN idx USING (word), widths
  UNION ALL SELECT case_id, 'case', e + d + f + t + slot, 1, value FROM cvec, widths
    WHERE value <> 0 OR slot NOT IN (SELECT slot FROM cvec_onehot_slots))""") + """
SELECT case_id, label_id, input, CAST(slot AS BIGINT) AS slot, CAST(span AS BIGINT) AS span, count(*) AS n,
  round(CAST(sum(value) AS DOUBLE), 4) AS total
FROM all_cells JOIN wanted USING (case_id) GROUP BY ALL"""


def assembled(spark, folder):
    events = with_placeholder(binned(spark, folder))
    inputs = Inputs(CATEGORIES, NUMBERS, "bin", FEATURES, "activity", ["nation"], ["balance"])
    return assembled_cells(events, customer_cases(spark, folder), EVENTS, "result", inputs)


@query("assemble_inputs", ASSEMBLED)
def assemble_inputs(spark, folder):
    """Event, duration, feature, text and case inputs in one space of slots, by case; steps are shown counted and summed."""
    ready = assembled(spark, folder)
    sums = ready.cells.groupBy("case", "input", "slot", "span").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.join(ready.labels.select("case", "label_id"), "case").withColumnRenamed("case", "case_id")


QUOTAS = """sizes AS (SELECT result, count(*) AS n FROM cases GROUP BY result),
shares AS (
  SELECT result, n, n * (t - CAST(ceil(t * CAST(0.2 AS DOUBLE)) AS BIGINT)) / CAST(t AS DOUBLE) AS share,
    t - CAST(ceil(t * CAST(0.2 AS DOUBLE)) AS BIGINT) AS train_rows
  FROM sizes, (SELECT count(*) AS t FROM cases)),
quotas AS (
  SELECT result, n, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, result)
    <= train_rows - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS train
  FROM shares)"""


@query("split_quotas", with_(CASES, QUOTAS) + "SELECT result AS label, n, train FROM quotas")
def split_quotas(spark, folder):
    return d.class_quotas(customer_cases(spark, folder), "result")


@query("stratified_split", with_(CASES, QUOTAS) + """
SELECT case_id, CASE WHEN row_number() OVER (
    PARTITION BY result ORDER BY md5('42:' || CAST(case_id AS VARCHAR))) <= train THEN 'train' ELSE 'test' END AS split
FROM cases JOIN quotas USING (result)""")
def stratified_split(spark, folder):
    cases = customer_cases(spark, folder).select("case_id", "result")
    return d.fit_stratified(cases, "case_id", "result").apply(cases).select("case_id", "split")


@query("tail_split", with_(EV) + """
SELECT case_id, CASE WHEN row_number() OVER (ORDER BY case_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
  THEN 'train' ELSE 'validation' END AS split
FROM (SELECT DISTINCT case_id FROM ev)""")
def tail_split(spark, folder):
    cases = event_log(spark, folder).select("case_id").distinct()
    return d.fit_tail(cases, "case_id").apply(cases)

