"""Reading, writing, projections and row-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.registry import query, r6
from caselog.catalog.sql import CASES, EV, LI, PRED, TURNS, WORDS, with_
from caselog.functions.columns import (
    argmax,
    bin_key,
    concat_present,
    missing_to_null,
    pair_text,
    pair_tokens,
    word_tokens,
)
from caselog.operators.evaluate import confusion_matrix, label_list
from caselog.plans.duration import with_minutes
from caselog.plans.features import with_placeholder
from caselog.session import scratch_table
from caselog.sources.tables import read_table, write_table
from caselog.sources.views import (
    customer_cases,
    event_log,
    line_log,
    order_predictions,
    turn_log,
)

EVENT_SCHEMA = "case_id bigint, event_id bigint, activity string, resource string, amount double, duration_min double"
CASE_SCHEMA = "case_id bigint, nation int, balance double, result string"


@query("read_event_log_csv", with_(EV) + """
SELECT case_id, event_id, activity, resource, round(amount, 6) AS amount, duration_min FROM ev""")
def read_event_log_csv(spark, folder):
    path = scratch_table(spark, "events.csv")
    write_table(event_log(spark, folder).select(
        "case_id", "event_id", "activity", "resource", "amount", "duration_min"), path)
    return read_table(spark, path, EVENT_SCHEMA).withColumn("amount", F.round("amount", 6))


@query("read_case_csv", with_(CASES) + "SELECT case_id, nation, round(balance, 6) AS balance, result FROM cases")
def read_case_csv(spark, folder):
    path = scratch_table(spark, "cases.csv")
    write_table(customer_cases(spark, folder), path)
    return read_table(spark, path, CASE_SCHEMA).withColumn("balance", F.round("balance", 6))


@query("project_log", with_(EV) + """
SELECT case_id, event_id, activity, round(duration_s, 6) AS duration_s FROM ev""")
def project_log(spark, folder):
    return event_log(spark, folder).select("case_id", "event_id", "activity", r6("duration_s", "duration_s"))


@query("duration_minutes", with_(EV) + "SELECT case_id, event_id, duration_min FROM ev")
def duration_minutes(spark, folder):
    log = event_log(spark, folder).select("case_id", "event_id", "duration_s")
    return with_minutes(log, "duration_s").drop("duration_s")


@query("constant_column", with_(EV) + "SELECT case_id, event_id, activity, resource, '<NO_DESC>' AS dummyf FROM ev")
def constant_column(spark, folder):
    return with_placeholder(event_log(spark, folder).select("case_id", "event_id", "activity", "resource"))


@query("concat_features", with_(EV) + """
SELECT case_id, event_id, concat_ws('_', CASE WHEN resource <> '<NO_DESC>' THEN resource END, activity) AS features,
  coalesce(CASE WHEN resource <> '<NO_DESC>' THEN resource END, '') AS resource_only
FROM ev""")
def concat_features(spark, folder):
    log = with_placeholder(event_log(spark, folder))
    return log.select("case_id", "event_id",
                      concat_present(["resource", "dummyf", "activity"]).alias("features"),
                      concat_present(["resource", "dummyf"]).alias("resource_only"))


@query("missing_to_null", with_(EV) + """
SELECT event_id, round(nullif(amount, -1), 6) AS amount FROM ev""")
def missing_values(spark, folder):
    return event_log(spark, folder).select("event_id", r6(missing_to_null("amount"), "amount"))


@query("bin_key_text", with_(LI) + """
SELECT case_id, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN qty / 2 = floor(qty / 2) THEN CAST(CAST(qty / 2 AS BIGINT) AS VARCHAR)
    ELSE CAST(qty / 2 AS VARCHAR) END AS key
FROM li""")
def bin_key_text(spark, folder):
    return line_log(spark, folder).select(
        "case_id", "l_linenumber", "l_partkey", "l_suppkey", bin_key(F.col("qty") / 2).alias("key"))


@query("pair_tokens", with_(EV, TURNS) + r"""
SELECT 'event' AS source, event_id AS row_id, 0 AS turn,
  unnest(regexp_extract_all(activity || '|' || resource, '[\p{L}\p{N}_]+\|[\p{L}\p{N}_]+')) AS token FROM ev
UNION ALL
SELECT 'turn', case_id, turn, unnest(regexp_extract_all(role || '|' || text, '[\p{L}\p{N}_]+\|[\p{L}\p{N}_]+'))
FROM turns""")
def pair_token_rows(spark, folder):
    events = event_log(spark, folder).select(
        F.lit("event").alias("source"), F.col("event_id").alias("row_id"), F.lit(0).cast("long").alias("turn"),
        F.explode(pair_tokens(pair_text("activity", "resource"))).alias("token"))
    turns = turn_log(spark, folder).select(
        F.lit("turn").alias("source"), F.col("case_id").alias("row_id"), "turn",
        F.explode(pair_tokens(pair_text("role", "text"))).alias("token"))
    return events.unionAll(turns)


@query("word_tokens", with_(TURNS, WORDS) + "SELECT case_id, turn, CAST(place AS BIGINT) AS place, word FROM words")
def word_token_rows(spark, folder):
    rows = turn_log(spark, folder).select("case_id", "turn", F.posexplode(word_tokens("text")).alias("place", "word"))
    return rows.withColumn("place", F.col("place").cast("long"))


def with_probability(predictions):
    """0.8 at the predicted label and 0.1 elsewhere; the truth as one-hot. Labels in order, as they occur."""
    labels = label_list(confusion_matrix(predictions))
    return predictions.withColumns({
        "probability": F.array(*[F.when(F.col("pred") == x, F.lit(0.8)).otherwise(F.lit(0.1)) for x in labels]),
        "truth_vec": F.array(*[F.when(F.col("truth") == x, F.lit(1.0)).otherwise(F.lit(0.0)) for x in labels]),
    })


def label_position(column):
    return f"(SELECT CAST(count(*) AS INTEGER) FROM (SELECT truth AS l FROM preds UNION SELECT pred FROM preds) WHERE l < {column})"


@query("argmax_pred", with_(PRED) + f"SELECT case_id, {label_position('pred')} AS pred_id FROM preds")
def argmax_pred(spark, folder):
    rows = with_probability(order_predictions(spark, folder))
    return rows.select("case_id", argmax("probability").alias("pred_id"))


@query("argmax_truth", with_(PRED) + f"SELECT case_id, {label_position('truth')} AS truth_id FROM preds")
def argmax_truth(spark, folder):
    rows = with_probability(order_predictions(spark, folder))
    return rows.select("case_id", argmax("truth_vec").alias("truth_id"))

