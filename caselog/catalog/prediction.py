"""Outcome prediction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.embedding import BINNED, DURATION_KEYS, TOKENS, VOCABULARY, duration_keyed
from caselog.catalog.encoding import CATEGORIES, NUMBERS, minmax_sql, vector_sql
from caselog.catalog.registry import query
from caselog.catalog.sql import CASES, EV, split_sql, with_
from caselog.operators import linear
from caselog.operators.cells import flat_cells
from caselog.operators.embedding import embedded
from caselog.operators.encode import fit_cells
from caselog.operators.evaluate import CLIP
from caselog.operators.sequence import with_steps
from caselog.plans import outcome
from caselog.sources.views import EVENTS, customer_cases, event_log

ROUNDS = 4
SETTING = linear.Setting(0.01, 0.0)
STRENGTHS, MIXINGS = (0.01, 0.1), (0.0, 0.5)


def prepared(spark, folder, with_embedding=False):
    events = embedded(duration_keyed(spark, folder), EVENTS) if with_embedding else event_log(spark, folder)
    return outcome.prepare(events, customer_cases(spark, folder), EVENTS, "result",
                           CATEGORIES, NUMBERS, ["nation"], ["balance"], with_embedding)


# -- flattening ---------------------------------------------------------------------------------


FLAT = """
SELECT case_id, slot, round(coalesce(avg(value) FILTER (valid), 0), 6) AS mean,
  round(coalesce(arg_max(value, (start_ts, event_id)) FILTER (valid), 0), 6) AS last, count(*) FILTER (valid) AS len
FROM rated GROUP BY case_id, slot"""


@query("flatten_sequences", with_(EV, vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>"), """
rated AS (
  SELECT event_id, case_id, slot, value, start_ts,
    bool_or(value <> -1) OVER (PARTITION BY event_id) AS valid
  FROM vectors JOIN ev USING (event_id))""") + FLAT)
def flatten_sequences(spark, folder):
    return flat_rows(event_log(spark, folder), CATEGORIES, NUMBERS)


@query("flatten_sequences_missing", with_(EV, """gaps AS (
  SELECT * REPLACE (CASE WHEN case_id % 7 = 0 THEN CAST(-1 AS DOUBLE) ELSE amount END AS amount) FROM ev)""",
                                          minmax_sql("gaps", ["event_id"], ["amount"], False, "vectors"), """
rated AS (
  SELECT event_id, case_id, slot, value, start_ts,
    bool_or(value <> -1) OVER (PARTITION BY event_id) AS valid
  FROM vectors JOIN gaps USING (event_id))""") + FLAT)
def flatten_sequences_missing(spark, folder):
    """Every seventh case has no valid event; it stays, with zeros and length 0."""
    gap = F.when(F.col("case_id") % 7 == 0, F.lit(-1.0)).otherwise(F.col("amount"))
    return flat_rows(event_log(spark, folder).withColumn("amount", gap), [], ["amount"])


def flat_rows(log, categories, numbers):
    """Flat cells; slots that are 0 throughout a case are shown as well."""
    events = with_steps(log, EVENTS).select(F.col("case_id").alias("case"), "step", *categories, *numbers)
    encoding = fit_cells(log, categories, numbers, True, True)
    keys = ["case", "step", "valid"]
    flat = flat_cells(events, encoding.cells(events.withColumn("valid", encoding.is_valid()), keys), encoding.is_valid())
    every = flat.cases.select("case", "len", F.explode(F.sequence(F.lit(0), F.lit(encoding.width - 1))).alias("slot"))
    rows = every.withColumn("slot", F.col("slot").cast("long")).join(flat.cells, ["case", "slot"], "left")
    return rows.select(F.col("case").alias("case_id"), "slot", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"),
                       F.round(F.coalesce("last", F.lit(0.0)), 6).alias("last"), "len")


# -- the model in SQL ----------------------------------------------------------------------------


LABELS = """labels AS (
  SELECT result, CAST(row_number() OVER (ORDER BY result) - 1 AS INTEGER) AS label_id FROM (SELECT DISTINCT result FROM cases)),
known AS (SELECT case_id, result, label_id FROM cases JOIN labels USING (result) WHERE case_id IN (SELECT case_id FROM ev))"""


def rows_sql(view: str, inputs: str, valid: str) -> str:
    """CTE `feats` (case_id, slot, value): the sparse rows of all known cases; `inputs` gives (event_id, slot, value) of all steps."""
    return f"""{vector_sql("cases", ["case_id"], ["nation"], ["balance"], median=True, name="cvec")},
{LABELS},
steps_ AS MATERIALIZED ({inputs}),
wide AS (SELECT (SELECT max(slot) + 1 FROM steps_) AS w, (SELECT max(slot) + 1 FROM cvec) AS c),
rated AS (SELECT *, {valid} AS valid FROM steps_ JOIN {view} USING (event_id)),
flat AS MATERIALIZED (
  SELECT case_id, slot, coalesce(avg(value) FILTER (valid), 0) AS mean,
    coalesce(arg_max(value, (start_ts, event_id)) FILTER (valid), 0) AS last, count(*) FILTER (valid) AS len
  FROM rated GROUP BY case_id, slot),
feats AS MATERIALIZED (
  SELECT case_id, slot, CAST(value AS DOUBLE) AS value FROM (
    SELECT case_id, slot, mean AS value FROM flat UNION ALL SELECT case_id, slot + w, last FROM flat, wide
    UNION ALL SELECT DISTINCT case_id, 2 * w, len FROM flat, wide
    UNION ALL SELECT case_id, 2 * w + 1 + slot, value FROM cvec, wide
    UNION ALL SELECT case_id, 2 * w + 1 + c, 1 FROM known, wide)
  WHERE value <> 0 AND case_id IN (SELECT case_id FROM known)),
slots_ AS (SELECT unnest(range(0, 2 * w + 2 + c)) AS slot FROM wide)"""


PLAIN_ROWS = [EV, CASES, vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>"), rows_sql(
    "ev", "SELECT event_id, slot, value FROM vectors", "bool_or(value <> -1) OVER (PARTITION BY event_id)")]
EMBEDDED_ROWS = [*BINNED, DURATION_KEYS, TOKENS, VOCABULARY, CASES,
                 vector_sql("ev", ["event_id"], CATEGORIES, NUMBERS, "<NO_DESC>"), rows_sql("ev", """
  SELECT event_id, slot, value FROM vectors
  UNION ALL SELECT event_id, slot + (SELECT max(slot) + 1 FROM vectors),
    CASE WHEN embedded.key = vocab.key THEN score ELSE 0 END FROM embedded, vocab""", "true")]


def probabilities_sql(rows: str, rounds: int, name: str = "scored") -> str:
    """CTE `name` (case_id, label_id, setting, p): what the last weights make of the cases of `rows`."""
    return f"""{name}_sums AS (
  SELECT case_id, w{rounds}.label_id, setting, sum(value / scale * w) AS score
  FROM feats JOIN (SELECT case_id FROM {rows}) USING (case_id) JOIN scales USING (slot) JOIN w{rounds} USING (slot) GROUP BY ALL),
{name}_top AS (SELECT *, max(score) OVER (PARTITION BY case_id, setting) AS top FROM {name}_sums),
{name} AS MATERIALIZED (
  SELECT case_id, label_id, setting, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY case_id, setting) AS p
  FROM {name}_top)"""


def model_sql(train: str, settings: list, rounds: int) -> str:
    """CTEs `scales` and `w0` to `w<rounds>` (slot, label_id, setting, w), fitted to the cases of `train`."""
    given = ", ".join(f"({i}, CAST({s.strength!r} AS DOUBLE), CAST({s.mixing!r} AS DOUBLE))" for i, s in enumerate(settings))
    parts = [f"""settings_ AS (SELECT * FROM (VALUES {given}) t(setting, strength, mixing)),
constant AS (SELECT max(slot) AS slot FROM slots_),
fitted AS MATERIALIZED (SELECT case_id, label_id AS truth FROM known WHERE case_id IN (SELECT case_id FROM {train})),
scales AS MATERIALIZED (
  SELECT slot, coalesce(max(abs(value)), 1) AS scale
  FROM slots_ LEFT JOIN (SELECT feats.* FROM feats JOIN fitted USING (case_id)) USING (slot) GROUP BY slot),
xs AS MATERIALIZED (
  SELECT case_id, truth, slot, value / scale AS x, sum(abs(value / scale)) OVER (PARTITION BY case_id) AS size
  FROM feats JOIN fitted USING (case_id) JOIN scales USING (slot)),
w0 AS MATERIALIZED (
  SELECT slot, label_id, setting, CASE WHEN slot = (SELECT slot FROM constant)
    THEN ln(greatest((SELECT count(*) FROM fitted WHERE truth = label_id), 0.5) / CAST((SELECT count(*) FROM fitted) AS DOUBLE))
    ELSE 0 END AS w
  FROM slots_, labels, settings_)"""]
    for r in range(1, rounds + 1):
        parts.append(f"""s{r} AS (SELECT case_id, label_id, setting, sum(x * w) AS score FROM xs JOIN w{r - 1} USING (slot) GROUP BY ALL),
t{r} AS (SELECT *, max(score) OVER (PARTITION BY case_id, setting) AS top FROM s{r}),
p{r} AS MATERIALIZED (
  SELECT case_id, label_id, setting, exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY case_id, setting) AS p FROM t{r}),
g{r} AS (
  SELECT slot, label_id, setting, sum(x * (CASE WHEN truth = label_id THEN 1 ELSE 0 END - p)) / (SELECT count(*) FROM fitted) AS pull,
    sum(abs(x) * size * p) / (SELECT count(*) FROM fitted) AS bend
  FROM xs JOIN p{r} USING (case_id) GROUP BY ALL),
a{r} AS (
  SELECT slot, label_id, setting, w, pull, CASE WHEN slot = (SELECT slot FROM constant) THEN 0 ELSE strength * (1 - mixing) END AS ridge,
    bend + CASE WHEN slot = (SELECT slot FROM constant) THEN 0 ELSE strength * (1 - mixing) END AS bend,
    CASE WHEN slot = (SELECT slot FROM constant) THEN 0 ELSE strength * mixing END AS edge
  FROM w{r - 1} LEFT JOIN g{r} USING (slot, label_id, setting) JOIN settings_ USING (setting)),
w{r} AS MATERIALIZED (
  SELECT slot, label_id, setting, CASE WHEN bend > 0
    THEN sign(w + (pull - ridge * w) / bend) * greatest(abs(w + (pull - ridge * w) / bend) - edge / bend, 0) ELSE w END AS w
  FROM a{r})""")
    return ",\n".join(parts)


OUTCOME = split_sql("known", "split_", 42)
WEIGHTS = """
SELECT result AS label, CAST(slot AS BIGINT) AS slot, round(w / scale, 4) + 0 AS weight
FROM w%d JOIN scales USING (slot) JOIN labels USING (label_id)""" % ROUNDS
TRAIN = "(SELECT case_id FROM split_ WHERE part = 'train')"
TEST = "(SELECT case_id FROM split_ WHERE part = 'test')"


def weight_rows(ready, model):
    return model.weights().join(ready.labels, "label_id").select(
        "label", "slot", (F.round("weight", 4) + 0.0).alias("weight"))


def fitted(ready):
    return linear.fit(ready.train, ready.slots, ready.classes, [SETTING], ROUNDS)


# -- queries --------------------------------------------------------------------------------------


@query("fit_outcome", with_(*PLAIN_ROWS, OUTCOME, model_sql(TRAIN, [SETTING], ROUNDS)) + WEIGHTS)
def fit_outcome(spark, folder):
    """Every weight of a model fitted to the training cases."""
    ready = prepared(spark, folder)
    return weight_rows(ready, fitted(ready))


@query("fit_outcome_embedded", with_(*EMBEDDED_ROWS, OUTCOME, model_sql(TRAIN, [SETTING], ROUNDS)) + WEIGHTS)
def fit_outcome_embedded(spark, folder):
    """The same with the duration embedding as a further input."""
    ready = prepared(spark, folder, True)
    return weight_rows(ready, fitted(ready))


@query("fit_outcome_loss", with_(*PLAIN_ROWS, OUTCOME, model_sql(TRAIN, [SETTING], ROUNDS), probabilities_sql("known", ROUNDS), f"""
shares AS (SELECT truth AS label_id, count(*) / CAST((SELECT count(*) FROM fitted) AS DOUBLE) AS share FROM fitted GROUP BY 1)""") + f"""
SELECT part, count(*) AS cases, round(avg(-ln(least(greatest(p, {CLIP!r}), 1 - {CLIP!r}))), 4) AS loss,
  round(avg(-ln(share)), 4) AS prior_loss
FROM scored JOIN known USING (case_id, label_id) JOIN shares USING (label_id) JOIN split_ USING (case_id) GROUP BY part""")
def fit_outcome_loss(spark, folder):
    """Log loss of the fitted model on both parts, beside that of the training part's class shares."""
    ready = prepared(spark, folder)
    scored = linear.probabilities(ready.cases, fitted(ready))
    share = F.greatest(F.least(F.get("probability", F.col("label_id")), F.lit(1 - CLIP)), F.lit(CLIP))
    total = ready.train.agg(F.count(F.lit(1)).cast("double")).scalar()
    shares = ready.train.groupBy("label_id").agg((F.count(F.lit(1)) / total).alias("share"))
    return scored.join(shares, "label_id").groupBy(F.col("split").alias("part")).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg(-F.log(share)), 4).alias("loss"),
        F.round(F.avg(-F.log("share")), 4).alias("prior_loss"))


GRID = linear.grid(STRENGTHS, MIXINGS)


@query("tune_outcome", with_(*PLAIN_ROWS, OUTCOME, "inner_ AS (SELECT * FROM split_ JOIN known USING (case_id) WHERE part = 'train')",
                             split_sql("inner_", "tuning", 43), model_sql("(SELECT case_id FROM tuning WHERE part = 'train')", GRID, ROUNDS),
                             "held AS (SELECT case_id FROM tuning WHERE part = 'test')", probabilities_sql("held", ROUNDS), f"""
guessed AS (
  SELECT case_id, setting, arg_min(label_id, (-p, label_id)) AS pred FROM scored GROUP BY ALL),
judged AS (SELECT s.setting, k.label_id AS truth, pred, -ln(least(greatest(p, {CLIP!r}), 1 - {CLIP!r})) AS loss
  FROM guessed JOIN known k USING (case_id) JOIN scored s ON s.case_id = guessed.case_id AND s.setting = guessed.setting AND s.label_id = k.label_id),
classes AS (
  SELECT setting, label_id, count(*) FILTER (truth = label_id) AS support, count(*) FILTER (pred = label_id) AS taken,
    count(*) FILTER (truth = label_id AND pred = label_id) AS hits
  FROM judged, labels GROUP BY ALL),
measured AS (
  SELECT setting, sum(hits) / sum(support) AS accuracy,
    sum(CASE WHEN support + taken > 0 THEN support * 2 * hits / (support + taken) ELSE 0 END) / sum(support) AS weighted_f1
  FROM classes GROUP BY setting)""") + """
SELECT CAST(setting + 1 AS INTEGER) AS trial, strength, mixing, round(accuracy, 4) AS accuracy, round(weighted_f1, 4) AS weighted_f1,
  round(loss, 4) AS loss
FROM measured JOIN settings_ USING (setting) JOIN (SELECT setting, avg(loss) AS loss FROM judged GROUP BY setting) USING (setting)""")
def tune_outcome(spark, folder):
    """All trials of a grid, fitted side by side to a part of the training cases, and their measures on the rest of them."""
    trials = outcome.tune(prepared(spark, folder), STRENGTHS, MIXINGS, ROUNDS)
    return trials.select("trial", "strength", "mixing", *[F.round(c, 4).alias(c) for c in ("accuracy", "weighted_f1", "loss")])


@query("score_outcome", with_(*PLAIN_ROWS, OUTCOME, model_sql(TRAIN, [SETTING], ROUNDS), f"tested AS {TEST}",
                              probabilities_sql("tested", ROUNDS), """
guessed AS (SELECT case_id, arg_min(label_id, (-p, label_id)) AS pred FROM scored GROUP BY case_id)""") + """
SELECT case_id, known.result AS truth, g.result AS pred, l.result AS label, round(p, 4) AS probability
FROM scored JOIN guessed USING (case_id) JOIN known USING (case_id) JOIN labels g ON g.label_id = pred
  JOIN labels l ON l.label_id = scored.label_id""")
def score_outcome(spark, folder):
    """Every class's probability for every test case, with truth and predicted class."""
    ready = prepared(spark, folder)
    rows = outcome.predictions(linear.probabilities(ready.test, fitted(ready)), ready.labels)
    cells = rows.select("case", "truth", "pred", F.posexplode("probability").alias("label_id", "p"))
    return cells.join(ready.labels, "label_id").select(
        F.col("case").alias("case_id"), "truth", "pred", "label", F.round("p", 4).alias("probability"))
