"""Pseudo-embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.registry import cells, query, r6
from caselog.catalog.sql import EV, two_phase as two_phase_sql, with_
from caselog.operators import embedding as e
from caselog.operators.sequence import with_steps
from caselog.plans.duration import two_phase
from caselog.plans.features import with_placeholder
from caselog.session import scratch_table
from caselog.sources.tables import read_table, write_table
from caselog.sources.views import EVENTS, event_log

FEATURES = ["resource", "dummyf"]


def binned(spark, folder):
    return two_phase(event_log(spark, folder), "duration_min").events


def duration_keyed(spark, folder):
    return e.duration_keyed(binned(spark, folder), EVENTS)


BINNED = [EV, two_phase_sql("ev", "duration_min", 5, 19)]

# Bins become text; pairs and their tokens follow.
DURATION_KEYS = """keyed AS (
  SELECT *, CASE WHEN bin = floor(bin) THEN CAST(CAST(bin AS BIGINT) AS VARCHAR) ELSE CAST(bin AS VARCHAR) END AS key
  FROM binned)"""
FEATURE_KEYS = """keyed AS (
  SELECT *, CASE WHEN resource <> '<NO_DESC>' THEN resource ELSE '' END AS key FROM ev)"""
TOKENS = r"""tokens AS (
  SELECT case_id, unnest(regexp_extract_all(activity || '|' || key, '[\p{L}\p{N}_]+\|[\p{L}\p{N}_]+')) AS token
  FROM keyed),
tf AS (SELECT case_id, token, count(*) AS tf FROM tokens GROUP BY 1, 2),
idf AS (
  SELECT token, count(*) AS df, (SELECT count(DISTINCT case_id) FROM keyed) AS cases,
    ln((1 + (SELECT count(DISTINCT case_id) FROM keyed)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf
  FROM tf GROUP BY token),
weights AS (
  SELECT case_id, token, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY case_id)) AS tfidf
  FROM tf JOIN idf USING (token)),
spread AS (
  SELECT token, CASE WHEN count(*) < any_value(cases) THEN 0 ELSE min(tfidf) END AS low, max(tfidf) AS high
  FROM weights JOIN idf USING (token) GROUP BY token),
scores AS (
  SELECT case_id, token, tfidf, (tfidf - low) / CASE WHEN high - low < 1e-14 THEN 1 ELSE high - low END AS score
  FROM weights JOIN spread USING (token)),
embedded AS (
  SELECT k.*, coalesce(s.score, 0) AS score
  FROM keyed k LEFT JOIN scores s ON k.case_id = s.case_id AND k.activity || '|' || k.key = s.token)"""
VOCABULARY = """vocab AS (
  SELECT key, row_number() OVER (ORDER BY key) - 1 AS slot FROM (SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL))"""
DURATION = with_(*BINNED, DURATION_KEYS, TOKENS)
FEATURE = with_(EV, FEATURE_KEYS, TOKENS)


@query("case_documents", with_(*BINNED, DURATION_KEYS) + """
SELECT case_id, part, string_agg(activity || '|' || key, ' ' ORDER BY start_ts, event_id) AS document
FROM (SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY start_ts, event_id) - 1) // 10000 AS part FROM keyed)
GROUP BY case_id, part""")
def case_documents(spark, folder):
    steps = with_steps(duration_keyed(spark, folder), EVENTS)
    parts = e.case_documents(steps, EVENTS, 10_000)
    return parts.select(F.col("case").alias("case_id"), "part", "document")


@query("term_freq", DURATION + "SELECT case_id, token, tf FROM tf")
def term_freq(spark, folder):
    terms = e.term_counts(duration_keyed(spark, folder), EVENTS)
    return terms.filter(F.col("token").isNotNull()).withColumnRenamed("case", "case_id")


@query("idf", DURATION + "SELECT token, df, cases, round(idf, 6) AS idf FROM idf")
def idf(spark, folder):
    return e.TokenTable(duration_keyed(spark, folder), EVENTS).idf().withColumn("idf", F.round("idf", 6))


@query("tfidf_l2", DURATION + "SELECT case_id, token, tf, round(tfidf, 6) AS tfidf FROM weights")
def tfidf_l2(spark, folder):
    weights = e.TokenTable(duration_keyed(spark, folder), EVENTS).weights()
    return weights.select(F.col("case").alias("case_id"), "token", "tf", r6("tfidf", "tfidf"))


@query("tfidf_minmax", DURATION + "SELECT case_id, token, round(score, 6) AS score FROM scores")
def tfidf_minmax(spark, folder):
    scores = e.TokenTable(duration_keyed(spark, folder), EVENTS).scores()
    return scores.select(F.col("case").alias("case_id"), "token", r6("score", "score"))


@query("duration_embedding", DURATION + "SELECT event_id, key, round(score, 6) AS score FROM embedded")
def duration_embedding(spark, folder):
    return e.duration_embedding(binned(spark, folder), EVENTS).select("event_id", "key", r6("score", "score"))


@query("embedding_roundtrip", DURATION + "SELECT case_id, event_id, key, round(score, 6) AS score FROM embedded")
def embedding_roundtrip(spark, folder):
    """Written in long form, read back: the hand-over between two jobs."""
    path = scratch_table(spark, "embedding")
    write_table(e.duration_embedding(binned(spark, folder), EVENTS).select("case_id", "event_id", "key", "score"), path)
    return read_table(spark, path).withColumn("score", F.round("score", 6))


@query("duration_embedding_plain", with_(EV, """keyed AS (
  SELECT *, CAST(CAST(duration_min AS BIGINT) AS VARCHAR) AS key FROM ev)""", TOKENS) + """
SELECT event_id, key, round(score, 6) AS score FROM embedded""")
def duration_embedding_plain(spark, folder):
    """Every whole minute is its own bin: a vocabulary that grows with the data."""
    log = event_log(spark, folder).withColumn("bin", F.col("duration_min"))
    return e.duration_embedding(log, EVENTS).select("event_id", "key", r6("score", "score"))


@query("feature_embedding", FEATURE + "SELECT event_id, key, round(score, 6) AS score FROM embedded")
def feature_embedding(spark, folder):
    log = with_placeholder(event_log(spark, folder))
    return e.feature_embedding(log, EVENTS, FEATURES).select("event_id", "key", r6("score", "score"))


@query("embedding_vocab", with_(*BINNED, DURATION_KEYS, VOCABULARY) + "SELECT key, slot FROM vocab")
def embedding_vocab(spark, folder):
    return e.vocabulary(duration_keyed(spark, folder))


@query("embedding_slots", with_(*BINNED, DURATION_KEYS, TOKENS, VOCABULARY) + """
SELECT event_id, slot, round(score, 6) AS score FROM embedded JOIN vocab USING (key)""")
def embedding_slots(spark, folder):
    keyed = duration_keyed(spark, folder)
    rows = e.slotted(e.embedded(keyed, EVENTS), e.vocabulary(keyed))
    return rows.select("event_id", "slot", r6("score", "score"))


WIDE_KEYS = ["", "r1", "r2", "r3", "r4", "r5", "r6"]


@query("embedding_wide", FEATURE + "SELECT event_id, " + ", ".join(
    f"round(CASE WHEN key = '{k}' THEN score ELSE 0 END, 6) AS key_{k}" for k in WIDE_KEYS) + " FROM embedded")
def embedding_wide(spark, folder):
    keyed = e.feature_keyed(with_placeholder(event_log(spark, folder)), EVENTS, FEATURES)
    rows = e.wide(e.embedded(keyed, EVENTS), e.vocabulary_list(keyed))
    return rows.select("event_id", *[r6(c, c) for c in rows.columns if c.startswith("key_")])


@query("embedding_dense", with_(*BINNED, DURATION_KEYS, TOKENS, VOCABULARY) + """
SELECT event_id, v.slot, round(CASE WHEN embedded.key = v.key THEN score ELSE 0 END, 6) AS value
FROM embedded, vocab v""")
def embedding_dense(spark, folder):
    keyed = duration_keyed(spark, folder)
    keys = e.vocabulary_list(keyed)
    return cells(e.embedded(keyed, EVENTS).withColumn("vec", e.dense(keys)), ["event_id"])
