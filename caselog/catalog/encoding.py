"""Attribute encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.registry import cells, long, query
from caselog.catalog.sql import CASES, EV, TURNS, WORDS, with_
from caselog.operators import encode as c
from caselog.operators.words import WordIndex, padded_text, text_steps
from caselog.sources.views import TURNS as TURN_LOG, customer_cases, event_log, turn_log

CATEGORIES = ["activity", "resource"]
NUMBERS = ["amount", "duration_min"]


# -- SQL pieces -------------------------------------------------------------------------------


def onehot_sql(view, keys, columns, missing=None, name="onehot"):
    """CTE `name` (keys, slot, value): one row per category slot."""
    blocks, hits = [], []
    for i, col in enumerate(columns):
        blocks.append(f"SELECT DISTINCT {i} AS block, {col} AS value FROM {view}")
        masked = f"WHEN v.{col} = '{missing}' THEN -1.0 " if missing else ""
        hits.append(f"SELECT {', '.join('v.' + k for k in keys)}, s.slot, CAST(CASE {masked}"
                    f"WHEN v.{col} = s.value THEN 1 ELSE 0 END AS DOUBLE) AS value "
                    f"FROM {view} v, {name}_slots s WHERE s.block = {i}")
    return f"""{name}_slots AS (
  SELECT block, value, row_number() OVER (ORDER BY block, value) - 1 AS slot FROM ({' UNION ALL '.join(blocks)})),
{name} AS ({' UNION ALL '.join(hits)})"""


def minmax_sql(view, keys, columns, median=False, name="scaled"):
    """CTE `name` (keys, slot, value): scaled numbers, missing ones -1 or the median."""
    parts = []
    for i, col in enumerate(columns):
        valid = f"nullif({col}, -1)"
        value = f"coalesce({valid}, m)" if median else valid
        scaled = f"({value} - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END"
        shown = scaled if median else f"coalesce({scaled}, -1)"
        parts.append(f"SELECT {', '.join(keys)}, {i} AS slot, {shown} AS value FROM {view}, "
                     f"(SELECT min({valid}) AS lo, max({valid}) AS hi, median({valid}) AS m FROM {view})")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def vector_sql(view, keys, categories, numbers, missing=None, median=False, name="vectors"):
    """CTE `name` (keys, slot, value): one-hot slots, then scaled numbers."""
    ks = ", ".join(keys)
    return ",\n".join([
        onehot_sql(view, keys, categories, missing, f"{name}_onehot"),
        minmax_sql(view, keys, numbers, median, f"{name}_scaled"),
        f"""{name} AS (
  SELECT {ks}, slot, value FROM {name}_onehot
  UNION ALL SELECT {ks}, slot + (SELECT count(*) FROM {name}_onehot_slots), value FROM {name}_scaled)""",
    ])


CELLS = """cells_ AS (
  SELECT event_id, slot, 1 AS span, value FROM vectors
  WHERE value <> 0 AND NOT (value = -1 AND slot IN (SELECT slot FROM vectors_onehot_slots))
  UNION ALL SELECT event_id, slot, 1, value FROM vectors
  WHERE value = 0 AND slot NOT IN (SELECT slot FROM vectors_onehot_slots)
  UNION ALL SELECT event_id, min(slot), count(*), -1 FROM vectors JOIN vectors_onehot_slots USING (slot)
  WHERE vectors.value = -1 GROUP BY event_id, block)"""


# -- queries ------------------------------------------------------------------------------------


@query("onehot", with_(EV, onehot_sql("ev", ["event_id"], CATEGORIES)) + "SELECT * FROM onehot")
def onehot(spark, folder):
    log = event_log(spark, folder)
    return cells(log.withColumn("vec", c.fit_onehot(log, CATEGORIES).vector()), ["event_id"])


@query("onehot_masked", with_(EV, onehot_sql("ev", ["event_id"], CATEGORIES, "<NO_DESC>")) + "SELECT * FROM onehot")
def onehot_masked(spark, folder):
    log = event_log(spark, folder)
    return cells(log.withColumn("vec", c.fit_onehot(log, CATEGORIES, "<NO_DESC>").vector()), ["event_id"])


@query("onehot_sparse", with_(EV, onehot_sql("ev", ["event_id"], CATEGORIES)) + """
SELECT event_id, CASE WHEN block = 0 THEN 'activity' ELSE 'resource' END AS name, o.slot,
  CASE WHEN s.value = '<NO_DESC>' THEN CAST(-1 AS DOUBLE) ELSE o.value END AS cell
FROM onehot o JOIN onehot_slots s USING (slot) WHERE o.value = 1""")
def onehot_sparse(spark, folder):
    log = event_log(spark, folder)
    return c.onehot_cells(log, ["event_id"], CATEGORIES, c.category_slots(log, CATEGORIES), "<NO_DESC>")


@query("minmax_masked", with_(EV, minmax_sql("ev", ["event_id"], NUMBERS)) + """
SELECT event_id, CAST(slot AS BIGINT) AS slot, round(value, 6) AS value FROM scaled""")
def minmax_masked(spark, folder):
    log = event_log(spark, folder)
    return cells(log.withColumn("vec", c.fit_minmax(log, NUMBERS).vector()), ["event_id"])


@query("median_minmax", with_(EV, minmax_sql("ev", ["event_id"], NUMBERS, True)) + """
SELECT event_id, CAST(slot AS BIGINT) AS slot, round(value, 6) AS value FROM scaled""")
def median_minmax(spark, folder):
    log = event_log(spark, folder)
    return cells(log.withColumn("vec", c.fit_median(log, NUMBERS).vector()), ["event_id"])


@query("label_onehot", with_(CASES) + """,
labels AS (SELECT result, row_number() OVER (ORDER BY result) - 1 AS label_id FROM (SELECT DISTINCT result FROM cases))
SELECT case_id, CAST(a.label_id AS INTEGER) AS label_id, b.label_id AS slot,
  CASE WHEN a.label_id = b.label_id THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS value
FROM cases JOIN labels a USING (result), labels b""")
def label_onehot(spark, folder):
    return cells(c.encoded_labels(customer_cases(spark, folder), "result"), ["case_id", "label_id"], "label_vec")


@query("case_features", with_(CASES, vector_sql("cases", ["case_id"], ["nation"], ["balance"], median=True)) + """
SELECT case_id, slot, round(value, 6) AS value FROM vectors""")
def case_features(spark, folder):
    cases = customer_cases(spark, folder)
    return cells(c.fit_vectors(cases, ["nation"], ["balance"]).apply(cases), ["case_id"])


@query("case_features_masked", with_(CASES, vector_sql("cases", ["case_id"], ["result"], ["balance"], "BUILDING")) + """
SELECT case_id, slot, round(value, 6) AS value FROM vectors""")
def case_features_masked(spark, folder):
    cases = customer_cases(spark, folder)
    return cells(c.fit_vectors(cases, ["result"], ["balance"], True, True, "BUILDING").apply(cases), ["case_id"])


@query("event_vector", with_(EV, vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>")) + """
SELECT event_id, slot, round(value, 6) AS value FROM vectors""")
def event_vector(spark, folder):
    log = event_log(spark, folder)
    return cells(c.fit_vectors(log, CATEGORIES, NUMBERS, True, True).apply(log), ["event_id"])


INDEX = """idx AS (
  SELECT word, n, row_number() OVER (ORDER BY n DESC, c, t, p) AS word_id FROM (
    SELECT word, count(*) AS n, min_by(case_id, (case_id, turn, place)) AS c,
      min_by(turn, (case_id, turn, place)) AS t, min_by(place, (case_id, turn, place)) AS p
    FROM words GROUP BY word)),
places AS (SELECT case_id, turn, row_number() OVER (PARTITION BY case_id ORDER BY turn) - 1 AS step FROM turns)"""


@query("word_index", with_(TURNS, WORDS, INDEX) + """
SELECT word, n, word_id, (SELECT count(*) + 1 FROM idx) AS vocab_size FROM idx""")
def word_index(spark, folder):
    index = WordIndex(turn_log(spark, folder), TURN_LOG, "text")
    return index.table.withColumn("vocab_size", F.lit(index.size).cast("long"))


@query("text_sequence", with_(TURNS, WORDS, INDEX) + """
SELECT case_id, step, CAST(place AS BIGINT) AS place, word_id
FROM words JOIN idx USING (word) JOIN places USING (case_id, turn)""")
def text_sequence(spark, folder):
    log = turn_log(spark, folder)
    rows = text_steps(log, TURN_LOG, "text", WordIndex(log, TURN_LOG, "text"))
    return rows.select(F.col("case").alias("case_id"), "step", long(F.col("place"), "place"), "word_id")


@query("text_sequence_padded", with_(TURNS, WORDS, INDEX) + """,
size AS (SELECT max(step) + 2 AS steps, (SELECT max(place) + 1 FROM words) AS width FROM places)
SELECT c.case_id, s.step, w.slot, CAST(coalesce(word_id, 0) AS DOUBLE) AS value
FROM (SELECT DISTINCT case_id FROM turns) c,
  (SELECT unnest(range(0, (SELECT steps FROM size))) AS step) s,
  (SELECT unnest(range(0, (SELECT width FROM size))) AS slot) w
  LEFT JOIN places p ON p.case_id = c.case_id AND p.step = s.step
  LEFT JOIN words ON words.case_id = p.case_id AND words.turn = p.turn AND words.place = w.slot
  LEFT JOIN idx ON idx.word = words.word""")
def text_sequence_padded(spark, folder):
    log = turn_log(spark, folder)
    rows = padded_text(log, TURN_LOG, "text", WordIndex(log, TURN_LOG, "text"))
    return cells(rows.withColumnRenamed("case", "case_id"), ["case_id", "step"])


@query("role_sequence", with_(TURNS) + """,
idx AS (
  SELECT role, row_number() OVER (ORDER BY n DESC, c, t) AS word_id FROM (
    SELECT role, count(*) AS n, min_by(case_id, (case_id, turn)) AS c, min_by(turn, (case_id, turn)) AS t
    FROM turns GROUP BY role))
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY turn) - 1 AS step, word_id
FROM turns JOIN idx USING (role)""")
def role_sequence(spark, folder):
    log = turn_log(spark, folder)
    rows = text_steps(log, TURN_LOG, "role", WordIndex(log, TURN_LOG, "role"))
    return rows.select(F.col("case").alias("case_id"), "step", "word_id")

