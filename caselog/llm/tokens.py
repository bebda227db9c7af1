"""Token ids of a corpus in Re-Pair shards, and back.

Documents are sorted by range of doc_id, so the shards in order of partition and
number hold the documents in ascending order. Each partition writes one file with
the shards of its documents; a row of the stored index names file, place and size
of every shard, and only what the index names is read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.repair import Shard, pack
from caselog.llm.stores import own_file, read_ranges
from caselog.llm.tables import batch_of, give_back
from caselog.llm.units import byte_level, shared
from caselog.session import cut, scratch_table

SHARD_TOKENS = 1 << 21    # a shard is closed at the document that reaches this
ENCODE_BYTES = 1 << 20    # of texts encoded together
MOST_TASKS = 10_000       # of a read; shards beyond share a task
NO_ID = -(1 << 63)        # stands for a null doc_id in a file

_INDEX = "part long, shard long, file string, offset long, length long, n_docs long, n_tokens long"


@dataclass
class Store:
    """A written corpus: the folder of its files, and the stored index of its shards."""

    folder: str
    index: DataFrame


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> Store:
    """Encode every whole text, append `end_id`, and write the shards.

    `tokenizer` is the path of a tokenizer file, the same on all executors. A
    null text is encoded as an empty one and has the end id only. Documents are
    in ascending doc_id order, those without one first, repeated ones by their
    text. Other columns are ignored; an empty table writes no shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch_table(spark, "tokens")

    def run(batches):
        units = stream = name = None
        names: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = offset = number = 0
        part = TaskContext.get().partitionId()

        def close():
            nonlocal held, offset, number, stream, name
            if stream is None:
                stream, name = own_file(folder, ".rpair")
            count, doc_ids, ids = (np.concatenate(c) for c in (counts, names, tokens))
            for part_of in (names, tokens, counts):
                part_of.clear()
            give_back()  # what encoding has let go of is not held beside the grammar's arrays, nor those beside the next texts
            data = pack(doc_ids, ids, count)
            stream.write(data)
            give_back()
            row = batch_of(part=[part], shard=[number], file=[name], offset=[offset], length=[len(data)],
                           n_docs=[len(count)], n_tokens=[int(count.sum())])
            offset, number, held = offset + len(data), number + 1, 0
            return row

        rows = []
        for batch in batches:
            units = units or shared(byte_level, tokenizer, by_rank=False)
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, found, bounds in units.encode(batch.column("text"), ENCODE_BYTES):
                ids, count = np.insert(found, bounds[1:], end_id), np.diff(bounds) + 1
                ends, row, at = np.cumsum(count), 0, 0
                while row < len(count):
                    # Up to the document that fills the shard, or as far as the block goes.
                    last = min(int(np.searchsorted(ends, at + SHARD_TOKENS - held)) + 1, len(count))
                    names.append(doc_ids[first + row:first + last].copy())
                    tokens.append(ids[at:ends[last - 1]].copy())
                    counts.append(count[row:last])
                    held += len(tokens[-1])
                    row, at = last, int(ends[last - 1])
                    if held >= SHARD_TOKENS:
                        rows.append(close())
        if held:
            rows.append(close())
        if stream is not None:
            stream.close()  # before the index rows leave the task
        give_back()
        yield from rows

    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return Store(folder, cut(ordered.mapInArrow(run, _INDEX), "token_index"))


def read_tokens(store: Store, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    `start` counts the ids of all documents before it, `n_tokens` those of the
    document with the end id, and `ids_crc32` is taken over them as little-endian
    unsigned 32-bit integers. `with_ids` adds the ids as an array.
    """
    # One row per shard of about two million ids.
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    index = store.index.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    folder = store.folder

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data, = read_ranges(folder, row["file"], [(row["offset"], row["length"])])
                shard = Shard(data)
                ids = shard.all().astype("<u4", copy=False)
                counts = shard.counts.astype(np.int64)
                ends = np.cumsum(counts)
                raw = ids.view(np.uint8).data
                crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                found = {
                    "doc_id": pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID),
                    "start": pa.array(row["start"] + ends - counts), "n_tokens": pa.array(counts),
                    "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    found["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield batch_of(**found)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    spread = index.repartition(min(max(1, store.index.count()), MOST_TASKS), "file", "offset")
    return spread.select("file", "offset", "length", "start").mapInArrow(run, schema)


def read_document(store: Store, place: dict, number: int) -> np.ndarray:
    """The ids of one document of a shard (a row of the index), decoded alone."""
    data, = read_ranges(store.folder, place["file"], [(place["offset"], place["length"])])
    return Shard(data).document(number)
