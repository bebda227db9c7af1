"""Sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.embedding import (
    BINNED,
    DURATION_KEYS,
    FEATURE_KEYS,
    FEATURES,
    TOKENS,
    VOCABULARY,
    duration_keyed,
)
from caselog.catalog.encoding import CATEGORIES, CELLS, NUMBERS, vector_sql
from caselog.catalog.registry import cells, long, query
from caselog.catalog.sql import CASES, EV, LI, TURNS, WORDS, float6, with_
from caselog.operators import encode as c
from caselog.operators import sequence as q
from caselog.operators.embedding import embedded, feature_keyed, slotted, vocabulary
from caselog.operators.encode import fit_vectors
from caselog.operators.words import text_width, word_number
from caselog.plans.features import embedding_layer, with_placeholder
from caselog.sources.views import EVENTS, LINES, TURNS as TURN_LOG, customer_cases, event_log, line_log, turn_log

LINE_CATEGORIES, LINE_NUMBERS = ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"]
LINE_ORDER = "start_ts, l_linenumber, l_partkey, l_suppkey"

# One narrow vector per event, for the plain sequence operators.
def narrow():
    return F.array("amount", "duration_min")


STEPS = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start_ts, event_id) - 1 AS step FROM ev),
lengths AS (SELECT case_id, count(*) AS len FROM ev GROUP BY case_id),
narrow AS (
  SELECT case_id, step, 0 AS slot, amount AS value FROM placed UNION ALL SELECT case_id, step, 1, duration_min FROM placed)"""


def named(rows):
    return cells(rows.withColumnRenamed("case", "case_id"), ["case_id", "step"])


def padded_sql(eos: bool, source: str = "filled", lengths: str = "lengths") -> str:
    """CTE `dense`: `source` (case_id, step, slot, value) with closing and padding steps."""
    end = int(eos)
    return f"""slots AS (SELECT DISTINCT slot FROM {source}),
grid AS (
  SELECT l.case_id, l.len, s.step, t.slot FROM {lengths} l,
    (SELECT unnest(range(0, (SELECT max(len) + {end} FROM {lengths}))) AS step) s, slots t),
dense AS (
  SELECT g.case_id, g.step, g.slot, CASE WHEN g.step < g.len THEN f.value
    WHEN g.step = g.len AND {end} = 1 THEN 0 ELSE -1 END AS value
  FROM grid g LEFT JOIN {source} f USING (case_id, step, slot))"""


SHOW = f"SELECT case_id, step, CAST(slot AS BIGINT) AS slot, {float6('value')} AS value FROM "


@query("sequences", with_(EV, STEPS) + SHOW + "narrow")
def sequences(spark, folder):
    return named(q.steps(event_log(spark, folder), EVENTS, narrow()))


@query("sequence_rows", with_(EV, STEPS) + """
SELECT case_id, CAST(step // 40 AS BIGINT) AS chunk, min(step) AS first_step, count(*) AS steps,
  sum(duration_min) AS total FROM placed GROUP BY 1, 2""")
def sequence_rows(spark, folder):
    """Arrays of up to 40 steps, shown by their size and the sum of their values."""
    rows = q.case_rows(q.steps(event_log(spark, folder), EVENTS, F.array("duration_min")), 40)
    total = F.aggregate("steps", F.lit(0.0), lambda a, v: a + F.get(v, F.lit(0)).cast("double"))
    return rows.select(F.col("case").alias("case_id"), "chunk", "first_step",
                       F.size("steps").cast("long").alias("steps"),
                       total.alias("total"))


@query("padded_sequences", with_(EV, STEPS, padded_sql(False, "narrow")) + SHOW + "dense")
def padded_sequences(spark, folder):
    return named(q.padded_log(event_log(spark, folder), EVENTS, 2, narrow(), False))


@query("eos_sequences", with_(EV, STEPS, padded_sql(True, "narrow")) + SHOW + "dense")
def eos_sequences(spark, folder):
    return named(q.padded_log(event_log(spark, folder), EVENTS, 2, narrow(), True))


def _encoded(view, key, order, categories, numbers, missing, median):
    """CTE `filled`: event vectors at their step."""
    return f"""keyed_rows AS (
  SELECT *, row_number() OVER (ORDER BY {order}) AS rid,
    row_number() OVER (PARTITION BY case_id ORDER BY {order}) - 1 AS step FROM {view}),
{vector_sql("keyed_rows", ["rid"], categories, numbers, missing, median)},
filled AS (SELECT case_id, step, slot, value FROM vectors JOIN keyed_rows USING (rid)),
lengths AS (SELECT case_id, count(*) AS len FROM {view} GROUP BY case_id)"""


@query("encode_events", with_(EV, _encoded("ev", "event_id", "start_ts, event_id", CATEGORIES, NUMBERS,
                                           "<NO_DESC>", False), padded_sql(False)) + SHOW + "dense")
def encode_events(spark, folder):
    log = event_log(spark, folder)
    vectors = fit_vectors(log, CATEGORIES, NUMBERS, True, True)
    return named(q.padded_log(log, EVENTS, vectors.width, vectors.vector(), False))


@query("encode_events_unmasked", with_(EV, _encoded("ev", "event_id", "start_ts, event_id", CATEGORIES, NUMBERS,
                                                    None, True), padded_sql(True)) + SHOW + "dense")
def encode_events_unmasked(spark, folder):
    log = event_log(spark, folder)
    vectors = fit_vectors(log, CATEGORIES, NUMBERS)
    return named(q.padded_log(log, EVENTS, vectors.width, vectors.vector(), True))


def _layer(keys):
    return f"""{VOCABULARY},
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY start_ts, event_id) - 1 AS step FROM embedded),
filled AS (
  SELECT case_id, step, slot, CASE WHEN placed.key = vocab.key THEN score ELSE 0 END AS value FROM placed, vocab),
lengths AS (SELECT case_id, count(*) AS len FROM ev GROUP BY case_id),
{padded_sql(keys)}"""


@query("duration_embedding_layer", with_(*BINNED, DURATION_KEYS, TOKENS, _layer(False)) + SHOW + "dense")
def duration_embedding_layer(spark, folder):
    return named(embedding_layer(duration_keyed(spark, folder), EVENTS, eos=False))


@query("feature_embedding_layer", with_(EV, FEATURE_KEYS, TOKENS, _layer(True)) + SHOW + "dense")
def feature_embedding_layer(spark, folder):
    keyed = feature_keyed(with_placeholder(event_log(spark, folder)), EVENTS, FEATURES)
    return named(embedding_layer(keyed, EVENTS, eos=True))


# -- simultaneous events --------------------------------------------------------------------------


@query("max_cooccur", with_(EV, LI) + """
SELECT 'ev' AS log, max(n) AS max_cooccur FROM (SELECT count(*) AS n FROM ev GROUP BY case_id, start_day)
UNION ALL SELECT 'li', max(n) FROM (SELECT count(*) AS n FROM li GROUP BY case_id, start_ts)""")
def max_cooccur(spark, folder):
    events = q.largest_cooccurrence(event_log(spark, folder), EVENTS).select(F.lit("ev").alias("log"), "max_cooccur")
    lines = q.largest_cooccurrence(line_log(spark, folder), LINES).select(F.lit("li").alias("log"), "max_cooccur")
    return events.unionAll(lines)


def stacked_sql(view, start, order):
    """CTE `stacked`: the view with the step and place of each event."""
    return f"""marked AS (
  SELECT *, row_number() OVER w - 1 AS nr,
    CASE WHEN lag({start}) OVER w = {start} THEN 0 ELSE 1 END AS fresh
  FROM {view} WINDOW w AS (PARTITION BY case_id ORDER BY {order})),
islands AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY case_id ORDER BY nr) - 1 AS BIGINT) AS step FROM marked),
stacked AS (SELECT *, row_number() OVER (PARTITION BY case_id, step ORDER BY nr) - 1 AS place FROM islands)"""


@query("stack_simultaneous", with_(EV, stacked_sql("ev", "start_day", "start_ts, event_id")) + """
SELECT case_id, event_id, step, place FROM stacked""")
def stack_simultaneous(spark, folder):
    return q.stacked_events(event_log(spark, folder), EVENTS).select("case_id", "event_id", "step", "place")


def concurrent_sql(view, start, order, categories, numbers, missing, eos):
    return f"""{stacked_sql(view, start, order)},
rows_ AS (SELECT *, row_number() OVER (ORDER BY case_id, nr) AS rid FROM stacked),
{vector_sql("rows_", ["rid"], categories, numbers, missing)},
width AS (SELECT max(slot) + 1 AS w FROM vectors),
most AS (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM {view} GROUP BY case_id, {start})),
stepped AS (SELECT case_id, step, count(*) AS n FROM stacked GROUP BY 1, 2),
slots_ AS (SELECT unnest(range(0, (SELECT w * m FROM width, most))) AS slot),
filled AS (
  SELECT s.case_id, s.step, t.slot, coalesce(v.value, -1) AS value
  FROM stepped s CROSS JOIN slots_ t CROSS JOIN width
    LEFT JOIN rows_ r ON r.case_id = s.case_id AND r.step = s.step AND r.place = t.slot // w
    LEFT JOIN vectors v ON v.rid = r.rid AND v.slot = t.slot % w),
lengths AS (SELECT case_id, count(*) AS len FROM stepped GROUP BY case_id),
{padded_sql(eos)}"""


@query("encode_events_concurrent", with_(LI, concurrent_sql(
    "li", "start_ts", LINE_ORDER, LINE_CATEGORIES, LINE_NUMBERS, None, False)) + """
SELECT case_id, step, count(*) AS width, round(sum(v), 5) AS total, round(sum(v * (slot + 1)), 5) AS weighted
FROM (SELECT case_id, step, slot, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM dense) GROUP BY case_id, step""")
def encode_events_concurrent(spark, folder):
    """Every step of every case, shown by its width, sum and slot-weighted sum."""
    log = line_log(spark, folder)
    encoding = c.fit_cells(log, LINE_CATEGORIES, LINE_NUMBERS, True, True)
    stacked = q.stacked_log(log, LINES, columns=[*LINE_CATEGORIES, *LINE_NUMBERS])
    rows = q.padded_stacked_cells(stacked, LINES, encoding, False, "blank")
    # A span fills the slots slot..slot + span - 1; slots count from 1 in the weighted sum.
    value = F.col("value").cast("float").cast("double")
    weight = F.col("span") * (2 * F.col("slot") + F.col("span") + 1) / 2
    keys, width = [F.col("case").alias("case_id"), "step"], F.lit(encoding.width * stacked.most).cast("long").alias("width")
    total, weighted = value * F.col("span"), value * weight
    events = rows.filter(~F.col("blank")).groupBy(*keys).agg(
        width, F.round(F.sum(total), 5).alias("total"), F.round(F.sum(weighted), 5).alias("weighted"))
    # A padding step is one row and stays where it is.
    return events.unionByName(rows.filter("blank").select(
        *keys, width, F.round(total, 5).alias("total"), F.round(weighted, 5).alias("weighted")))


@query("encode_events_concurrent_eos", with_(EV, concurrent_sql(
    "ev", "start_day", "start_ts, event_id", ["activity"], ["amount"], None, True)) + SHOW + "dense")
def encode_events_concurrent_eos(spark, folder):
    log = event_log(spark, folder)
    vectors = fit_vectors(log, ["activity"], ["amount"], True, True)
    return named(q.padded_stacked_log(log, EVENTS, vectors.width, vectors.vector(), True))


# -- shape and mask --------------------------------------------------------------------------------


@query("tensor_shape", with_(EV) + """
SELECT (SELECT count(DISTINCT case_id) FROM ev) AS cases,
  (SELECT max(n) + 1 FROM (SELECT count(*) AS n FROM ev GROUP BY case_id)) AS steps,
  (SELECT count(DISTINCT activity) + count(DISTINCT resource) + 2 FROM ev) AS width, true AS regular""")
def tensor_shape(spark, folder):
    log = event_log(spark, folder)
    width = c.category_slots(log, CATEGORIES).count() + len(NUMBERS)
    shapes = q.input_shapes({"event": q.Input(q.log_lengths(log, EVENTS), width, True)})
    return shapes.select("cases", "steps", "width", "regular")


@query("input_shapes", with_(*BINNED, DURATION_KEYS, CASES, """sizes AS (
  SELECT count(*) AS cases, max(n) AS steps FROM (SELECT count(*) AS n FROM ev GROUP BY case_id)),
widths AS (
  SELECT 'event' AS input, (SELECT count(DISTINCT activity) + count(DISTINCT resource) + 2 FROM ev) AS width
  UNION ALL SELECT 'duration', (SELECT count(DISTINCT key) FROM keyed)
  UNION ALL SELECT 'activity text', 1)""") + """
SELECT input, cases, steps, width, true AS regular,
  (SELECT count(DISTINCT result) FROM cases) AS classes, (SELECT count(DISTINCT nation) + 1 FROM cases) AS case_features
FROM widths, sizes""")
def input_shapes(spark, folder):
    """Shape of every input, their agreement, and the numbers of classes and case features."""
    log, cases = event_log(spark, folder), customer_cases(spark, folder)
    lengths = q.log_lengths(log, EVENTS)
    widths = {
        "event": c.category_slots(log, CATEGORIES).count() + len(NUMBERS),
        "duration": vocabulary(duration_keyed(spark, folder)).count(),
        "activity text": text_width(log, EVENTS, "activity"),
    }
    classes = c.category_slots(cases, ["result"]).count()
    features = c.category_slots(cases, ["nation"]).count() + 1
    return q.input_shapes({n: q.Input(lengths, w) for n, w in widths.items()}, classes, features)


PARTS = """lens AS (SELECT case_id, count(*) AS len FROM ev GROUP BY case_id),
given AS (
  SELECT 'event' AS input, case_id, len FROM lens
  UNION ALL SELECT 'duration', case_id, len + CASE WHEN case_id % 40 = 1 THEN 1 ELSE 0 END FROM lens
  UNION ALL SELECT 'text', case_id, len FROM lens WHERE case_id % 50 <> 0),
most AS (SELECT case_id, max(len) AS most FROM given GROUP BY case_id)"""


def parted_inputs(spark, folder):
    """Three inputs from different tables: the second has one event more in some cases, the third lacks some."""
    log = event_log(spark, folder).select("case_id", "start_ts", "event_id")
    first = log.groupBy("case_id").agg(F.min("start_ts").alias("start_ts"), F.min("event_id").alias("event_id"))
    logs = {"event": log, "duration": log.unionByName(first.filter("case_id % 40 = 1")), "text": log.filter("case_id % 50 <> 0")}
    return {n: q.Input(q.log_lengths(part, EVENTS), 1) for n, part in logs.items()}


@query("input_shapes_differ", with_(EV, PARTS) + """
SELECT g.input, count(*) AS cases, max(g.len) AS steps, CAST(1 AS BIGINT) AS width,
  NOT EXISTS (SELECT 1 FROM given a JOIN most USING (case_id) WHERE a.len < most.most) AND
  (SELECT count(*) FROM given) = 3 * (SELECT count(*) FROM most) AS regular
FROM given g GROUP BY g.input""")
def input_shapes_differ(spark, folder):
    """Shapes of inputs that do not fit together."""
    return q.input_shapes(parted_inputs(spark, folder)).drop("classes", "case_features")


@query("input_agreement", with_(EV, PARTS) + """
SELECT i.input, count(g.len) AS cases, count(*) - count(g.len) AS missing, count(*) FILTER (g.len < most) AS shorter
FROM (SELECT DISTINCT input FROM given) i CROSS JOIN most m LEFT JOIN given g ON g.input = i.input AND g.case_id = m.case_id
GROUP BY i.input""")
def input_agreement(spark, folder):
    """Where they differ: cases an input lacks, and cases that are longer in another."""
    return q.input_agreement(parted_inputs(spark, folder))


REAL = """
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY %s) - 1 AS step, %s AS valid FROM %s"""


@query("step_mask", with_(EV) + REAL % ("start_ts, event_id", "amount <> -1 OR resource <> '<NO_DESC>'", "ev"))
def step_mask(spark, folder):
    """Real steps, valid where the amount or the resource is known; padding is invalid by rule."""
    known = {"amount": F.col("amount") != -1, "resource": F.col("resource") != "<NO_DESC>"}
    return q.real_step_mask(event_log(spark, folder), EVENTS, known).withColumnRenamed("case", "case_id")


@query("step_mask_text", with_(TURNS, WORDS) + REAL % (
    "turn", "EXISTS (SELECT 1 FROM words w WHERE w.case_id = turns.case_id AND w.turn = turns.turn)", "turns"))
def step_mask_text(spark, folder):
    known = {"text": word_number("text") > 0}
    return q.real_step_mask(turn_log(spark, folder), TURN_LOG, known).withColumnRenamed("case", "case_id")


@query("step_mask_inputs", with_(TURNS, WORDS, """marked AS (
  SELECT *, CASE WHEN turn % 3 = 0 THEN -1 ELSE length(text) END AS amount,
    CASE WHEN turn % 2 = 0 THEN '' ELSE text END AS part FROM turns)""") + REAL % (
    "turn", "amount <> -1 OR (part <> '' AND EXISTS (SELECT 1 FROM words w WHERE w.case_id = marked.case_id AND w.turn = marked.turn))",
    "marked"))
def step_mask_inputs(spark, folder):
    """A text and a number together: valid where the text has a word or the number is known."""
    log = turn_log(spark, folder).withColumn("amount", F.when(F.col("turn") % 3 == 0, -1).otherwise(F.length("text")))
    log = log.withColumn("part", F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")))
    known = {"number": F.col("amount") != -1, "text": word_number("part") > 0}
    return q.real_step_mask(log, TURN_LOG, known).withColumnRenamed("case", "case_id")


# -- long forms, at any width ----------------------------------------------------------------------


@query("encode_events_cells", with_(EV, vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>"), CELLS, """
placed AS (SELECT case_id, event_id, row_number() OVER (PARTITION BY case_id ORDER BY start_ts, event_id) - 1 AS step FROM ev)""") + """
SELECT case_id, step, slot, span, round(value, 6) AS value FROM cells_ JOIN placed USING (event_id)""")
def encode_events_cells(spark, folder):
    """The event vectors as (case, step, slot, span, value): no array, no padding, any number of categories."""
    log = event_log(spark, folder)
    cells = c.encoded_cells(log, ["event_id"], CATEGORIES, NUMBERS, True, True)
    steps = q.with_steps(log.select("case_id", "start_ts", "event_id"), EVENTS)
    return steps.join(cells, "event_id").select("case_id", "step", "slot", "span", F.round("value", 6).alias("value"))


@query("embedding_cells", with_(*BINNED, DURATION_KEYS, TOKENS, VOCABULARY) + """
SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY start_ts, event_id) - 1 AS step, slot,
  round(score, 6) AS value
FROM embedded JOIN vocab USING (key)""")
def embedding_cells(spark, folder):
    """The duration embedding as (case, step, slot, value), for a vocabulary of any size."""
    keyed = duration_keyed(spark, folder)
    rows = slotted(q.with_steps(embedded(keyed, EVENTS), EVENTS), vocabulary(keyed))
    return rows.select("case_id", "step", long(F.col("slot"), "slot"), F.round("score", 6).alias("value"))


@query("stacked_cells", with_(EV, stacked_sql("ev", "start_day", "start_ts, event_id"),
                              vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>"), CELLS) + """
SELECT case_id, step, CAST(place * (SELECT max(slot) + 1 FROM vectors) + slot AS BIGINT) AS slot, span, round(value, 6) AS value
FROM cells_ JOIN stacked USING (event_id)""")
def stacked_cells(spark, folder):
    """Simultaneous events side by side in long form, for any number of them."""
    log = event_log(spark, folder)
    cells = c.encoded_cells(log, ["event_id"], CATEGORIES, NUMBERS, True, True)
    width = c.category_slots(log, CATEGORIES).count() + len(NUMBERS)
    rows = q.stacked_cells(log.select("case_id", "activity", "start_ts", "start_day", "event_id"), EVENTS, cells, width, "event_id")
    return rows.select(F.col("case").alias("case_id"), "step", "slot", "span", F.round("value", 6).alias("value"))
