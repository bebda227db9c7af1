"""Event-log and case views of the benchmark tables.

Every view is a projection: no filter, no shuffle, no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.constants import MISSING_TEXT
from caselog.functions.columns import whole_minutes
from caselog.log import EventLog

EVENTS = EventLog(case="case_id", activity="activity", order=("start_ts", "event_id"), start="start_day")
LINES = EventLog(case="case_id", activity="l_returnflag",
                 order=("start_ts", "l_linenumber", "l_partkey", "l_suppkey"), start="start_ts")
TURNS = EventLog(case="case_id", activity="role", order=("turn",))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """One case per user. Durations come from `value`; every 11th amount is missing (-1)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("case_id"), "event_id", F.col("ts").alias("start_ts"),
        F.to_date("ts").alias("start_day"), F.col("event_type").alias("activity"),
        F.when(k % 7 == 0, MISSING_TEXT).otherwise(F.concat(F.lit("r"), (k % 7).cast("string"))).alias("resource"),
        F.when(F.col("event_id") % 11 == 0, F.lit(-1.0)).otherwise(F.col("value")).alias("amount"),
        (F.col("value") * F.lit(600.0)).alias("duration_s"),
        whole_minutes(F.col("value") * F.lit(600.0)).alias("duration_min"),
    )


def line_log(spark: SparkSession, folder: str) -> DataFrame:
    """One case per order; quantities stand for durations, two of them full of zeros."""
    q = F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("start_ts"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus",
        "l_discount", "l_tax", q.alias("qty"),
        F.greatest(F.lit(0.0), q - 35).alias("over35"), F.greatest(F.lit(0.0), q - 45).alias("over45"),
    )


def turn_log(spark: SparkSession, folder: str) -> DataFrame:
    """One case per conversation."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("case_id"), "turn", "role", "text")


def customer_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Case table whose keys cover those of the event log; `result` is the label."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("result"))


def order_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, truth, pred): every other status is replaced by a made-up prediction."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("case_id"), F.col("o_orderstatus").alias("truth"),
        F.when(key % 4 == 0, "F").when(key % 4 == 1, "O").otherwise(F.col("o_orderstatus")).alias("pred"))


def daily_history(spark: SparkSession, folder: str) -> DataFrame:
    """(day, metric): mean event value per day, in the role of a metric per epoch."""
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("metric"))
