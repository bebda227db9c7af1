"""A corpus from raw documents to token shards: toxicity, near duplicates, benchmark overlaps, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`. Each result is written as parquet and read
again, so the next stage works on all that was kept, and a lost executor repeats
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselog.llm import mixing, toxicity
from caselog.llm.decontaminate import decontaminated
from caselog.llm.near_dup import without_near_duplicates
from caselog.llm.queries import tokenizer_path
from caselog.llm.sampling import fold
from caselog.llm.tokens import read_tokens, write_tokens
from caselog.session import scratch_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at their language's threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels, fold(4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    return without_near_duplicates(docs)


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt to the sources by weight, in up to two epochs."""
    return mixing.mixture(docs, percent=100)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Re-Pair shards, and every document as it is read back from them."""
    return read_tokens(write_tokens(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_overlaps),
    ("mixing", mix_sources),
    ("tokens", write_token_shards),
]

#: A trained network and near-duplicate search are beyond SQL; a test runs the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_table(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
