"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselog.llm import line_spread, mixing, quality_fm, toxicity
from caselog.llm.alignment import aligned_documents
from caselog.llm.decontaminate import overlaps
from caselog.llm.near_dup import near_duplicates
from caselog.llm.packing import packed, piece_rows
from caselog.llm.passages import repeated_passages
from caselog.llm.quality_rules import fit_ratio, quality
from caselog.llm.sampling import fold
from caselog.llm.tables import sent_if_small
from caselog.llm.tokens import read_tokens, write_tokens
from caselog.llm.warc import read_records, write_archive
from caselog.llm.whitening import whitened_rows
from caselog.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary; the same file on all executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """The public sentencepiece model; the same file on all executors."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query()
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its near-duplicate component, on four-word shingles."""
    return near_duplicates(_table(spark, folder, "documents"), size=4).drop("text_hash")


@query()
def op3_repair_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as it is read back from the Re-Pair shards of all token ids."""
    return read_tokens(write_tokens(_table(spark, folder, "documents"), tokenizer_path()))


@query()
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its base counts and the verdict; trusted are the rows labelled good."""
    docs = _table(spark, folder, "documents")
    good = cut(_table(spark, folder, "labels").filter("quality = 1").select("doc_id").distinct(), "trusted")
    trusted = sent_if_small(good.withColumn("trusted", F.lit(True)), 24)
    ratio = fit_ratio(docs.select("doc_id", "text").join(trusted, "doc_id", "left"), F.col("trusted"))
    return quality(docs, ratio)


WARC_SQL = """
WITH payloads AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
           sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100
        THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
    FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM firsts
"""


@query(WARC_SQL)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it is read back from the WARC archives through their index."""
    records = read_records(write_archive(_table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every span that repeats an earlier occurrence, by its offsets."""
    return repeated_passages(_table(spark, folder, "documents")).drop("text_hash")


@query(line_spread.SQL)
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines shown by ten sources or more."""
    clean = line_spread.without_boilerplate(_table(spark, folder, "documents"), F.col("source"))
    return clean.select("doc_id", "n_lines", "n_removed",
                        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("clean_md5"))


@query()
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its quality score; every fifth hash of a doc_id is held out."""
    docs = _table(spark, folder, "documents")
    model = quality_fm.fit(docs, _table(spark, folder, "labels"), fold(5) != 0)
    return quality_fm.scores(docs, model, fold(5) == 0)


@query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its toxicity score; every fourth hash of a doc_id is held out."""
    docs = _table(spark, folder, "documents")
    net = toxicity.fit(docs, _table(spark, folder, "labels"), fold(4) != 2)
    return toxicity.scores(docs, net, fold(4) == 2).drop("text_hash")


@query(mixing.SQL)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the mixture, by epoch: half of all tokens, dealt by weight."""
    return mixing.mixed(_table(spark, folder, "documents")).drop("text_hash")


@query()
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable embedding on up to 16 whitened components."""
    return whitened_rows(_table(spark, folder, "embeddings"))


@query()
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the groups and links between the tokens of two tokenizers."""
    return aligned_documents(_table(spark, folder, "documents"), tokenizer_path(), piece_model_path())


@query()
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of a document in the packed sequences."""
    return piece_rows(packed(_table(spark, folder, "documents"), tokenizer_path()))
