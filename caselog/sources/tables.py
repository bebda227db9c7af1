"""Reading and writing of event logs, case tables and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with header; the schema is given, so the file is read once."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=False)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, or CSV if the path ends in .csv (then with a schema)."""
    if path.rstrip("/").endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV needs a schema")
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).parquet(path) if schema is not None else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, escape='"')


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, or CSV if the path ends in .csv."""
    if path.rstrip("/").endswith(".csv"):
        write_csv(df, path)
    else:
        df.write.mode("errorifexists").parquet(path)
