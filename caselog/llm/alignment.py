"""Alignment of two tokenizers' tokens over the same bytes, in Arrow.

Both tokenizers' ids of a block of documents are flat columns with parent indices. Their
tokens' ends are running sums of byte lengths, taken per document. A full outer hash
join on (document, end) gives every place where a token of either side ends: one row is one
pair of tokens that share bytes (a link), and a row with both sides closes a group. Pairs of
ids are counted per block by `Table.group_by`; Spark adds the counts up, and joins
them back to the distinct pairs of each block, not to links: a pair comes up at most once a
block there, so no key is hot, and a block meets a bounded number of counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.tables import batch_of, give_back, sent_if_small
from caselog.llm.units import Units, byte_level, shared, word_pieces
from caselog.session import cut

BLOCK_BYTES = 1 << 20    # texts aligned together; a single longer text makes a longer block

_DOC = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>")
_ALIGNED = f"block long, {_DOC}, pair_a array<int>, pair_b array<int>, pair_n array<long>"


class _Side:
    """One tokenizer: ids of texts, and the bytes and decimal form of each id."""

    def __init__(self, units: Units):
        self.units = units
        tokens = units.tokens()
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.text = pa.array([str(k) for k in range(len(tokens))])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the bounds of each text's."""
        found = list(self.units.encode(column))
        ids = [i for _, i, _ in found] or [np.zeros(0, dtype="<u4")]
        ends = np.cumsum([0, *map(len, ids)])
        bounds = [b[1:] + e for (_, _, b), e in zip(found, ends, strict=False)]
        return np.concatenate(ids), np.concatenate([np.zeros(1, dtype=np.int64), *bounds])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids in a row."""
        size = self.length[ids]
        ends = np.cumsum(size)
        place = np.repeat(self.begin[ids] - (ends - size), size)
        place += np.arange(len(place))
        return self.bytes[place]


def _kept(ids: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the kept rows; the others have none."""
    size = np.diff(bounds)
    return ids[np.repeat(keep, size)], np.append(0, np.cumsum(np.where(keep, size, 0)))


def _faithful(side: _Side, ids: np.ndarray, bounds: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows whose tokens give exactly the row's bytes `data[at[r]:at[r + 1]]`."""
    rows = len(at) - 1
    size = np.append(0, np.cumsum(side.length[ids]))[bounds]
    same = np.diff(size) == np.diff(at)
    if not same.all():
        ids, bounds = _kept(ids, bounds, same)
        data = data[np.repeat(same, np.diff(at))]
        at = np.append(0, np.cumsum(np.where(same, np.diff(at), 0)))
    wrong = np.flatnonzero(side.joined(ids) != data)
    same[np.searchsorted(at, wrong, side="right") - 1] = False
    return same if rows else np.zeros(0, dtype=bool)


def _ends(side: _Side, ids: np.ndarray, bounds: np.ndarray, name: str) -> pa.Table:
    """(doc, end, number): one row per token; `end` counts the document's bytes up to it."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int32)))
    doc = pc.list_parent_indices(lists)
    total = np.cumsum(side.length[pc.list_flatten(lists).to_numpy()])
    before = np.append(0, total)[bounds[:-1]]
    return pa.table({"doc": doc, "end": total - before[doc.to_numpy()], name: np.arange(len(ids), dtype=np.int64)})


def _joined(bounds: np.ndarray, values: pa.Array, sign: str) -> pa.Array:
    """The strings of each run `bounds[k]:bounds[k + 1]` with `sign` between them."""
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values.cast(pa.large_string()))
    return pc.binary_join(lists, pa.scalar(sign, pa.large_string()))


def align(texts: pa.Array, a: _Side, b: _Side) -> dict:
    """Counts, digests and links of a block of texts; null and empty ones have no tokens."""
    rows = len(texts)
    spaced = pc.if_else(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0),
                        pc.binary_join_element_wise(pa.scalar(" "), pc.fill_null(texts, ""), pa.scalar("")), pa.scalar(""))
    spaced = spaced.cast(pa.large_string())
    at = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset:spaced.offset + rows + 1]
    raw = spaced.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    at = at - at[0]
    (ids_a, of_a), (ids_b, of_b) = a.ids(spaced), b.ids(spaced)
    keep = _faithful(a, ids_a, of_a, data, at) & _faithful(b, ids_b, of_b, data, at)
    (ids_a, of_a), (ids_b, of_b) = _kept(ids_a, of_a, keep), _kept(ids_b, of_b, keep)
    # Every place where a token ends, once; tokens of a side are numbered in order of place.
    places = _ends(a, ids_a, of_a, "a").join(_ends(b, ids_b, of_b, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
    places = places.sort_by([("doc", "ascending"), ("end", "ascending")])
    both = pc.and_(pc.is_valid(places["a"]), pc.is_valid(places["b"])).combine_chunks().to_numpy(zero_copy_only=False)
    doc = places["doc"].combine_chunks().to_numpy().astype(np.int64)
    # The token that holds a place is the next of its side to end there or later.
    link_a = ids_a[pc.fill_null_backward(places["a"].combine_chunks()).to_numpy()]
    link_b = ids_b[pc.fill_null_backward(places["b"].combine_chunks()).to_numpy()]
    shut = places.filter(pa.array(both))
    pairs = pa.table({"pair": (link_a.astype(np.int64) << 32) | link_b}).group_by(
        "pair", use_threads=False).aggregate([("pair", "count")])
    names = pairs["pair"].combine_chunks()
    codes = pc.index_in(pa.array((link_a.astype(np.int64) << 32) | link_b), names)
    of_group = np.append(0, np.cumsum(np.bincount(doc[both], minlength=rows)))
    of_link = np.append(0, np.cumsum(np.bincount(doc, minlength=rows)))

    def grouped(side: _Side, ids: np.ndarray, column: str) -> pa.Array:
        bounds = np.append(0, shut[column].combine_chunks().to_numpy() + 1)
        return _joined(bounds, side.text.take(pa.array(ids)), ",")

    groups = pc.binary_join_element_wise(grouped(a, ids_a, "a"), grouped(b, ids_b, "b"), pa.scalar("|", pa.large_string()))
    digests = _joined(of_group, groups, ";")
    named = names.to_numpy()
    return {
        "n_a": np.diff(of_a), "n_b": np.diff(of_b), "n_groups": np.diff(of_group), "n_links": np.diff(of_link),
        "groups_sha256": pa.array([hashlib.sha256(d.as_buffer()).hexdigest() if n else "" for d, n in
                                   zip(digests, np.diff(of_group).tolist(), strict=True)], pa.string()),
        "codes": (of_link, codes),
        "pair_a": (named >> 32).astype(np.int32), "pair_b": (named & 0xFFFFFFFF).astype(np.int32),
        "pair_n": pairs["pair_count"].combine_chunks().to_numpy(),
    }


def _blocks(batch: pa.RecordBatch):
    """Runs of rows of bounded text."""
    size = np.nan_to_num(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), nan=0)
    total, begin = np.cumsum(size), 0
    while begin < len(size):
        done = total[begin - 1] if begin else 0
        last = max(begin + 1, int(np.searchsorted(total, done + BLOCK_BYTES, side="right")))
        yield batch.slice(begin, last - begin)
        begin = last


def aligned_blocks(docs: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """Stored rows of each block: one per document with its links as `codes` of the block's pairs,
    and one (whose `pair_a` is not null) with the pairs and their counts there."""

    def run(batches):
        a = _Side(shared(byte_level, byte_tokenizer, plain=True))
        b = _Side(shared(word_pieces, piece_model))
        number = TaskContext.get().partitionId() << 32
        schema = None
        for batch in batches:
            for part in _blocks(batch):
                found = align(part.column("text"), a, b)
                rows = len(part)
                bounds, codes = found.pop("codes")
                pairs = {k: found.pop(k) for k in ("pair_a", "pair_b", "pair_n")}
                lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in pairs.items()}
                made = batch_of(
                    block=np.full(rows, number), doc_id=part.column("doc_id"), **found,
                    codes=pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), codes.cast(pa.int32())),
                    **{k: pa.nulls(rows, v.type) for k, v in lists.items()})
                schema = schema or made.schema
                yield made
                yield batch_of(block=pa.array([number]), **{n: pa.nulls(1, schema.field(n).type) for n in schema.names[1:-3]}, **lists)
                number += 1
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(plain.mapInArrow(run, _ALIGNED), "aligned")


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, code, a, b) of the pairs of each block, and (a, b, n, best) over the whole corpus.

    `best` tells whether no pair of the same `b` has a larger count.
    """
    zipped = F.posexplode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("code", "p")
    rows = aligned.filter("pair_a is not null").select("block", zipped).select(
        "block", "code", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("n"))
    counts = cut(rows.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    # One row per id of the second vocabulary.
    top = cut(counts.groupBy("b").agg(F.max("n").alias("most")), "top")
    return rows.drop("n"), counts.join(sent_if_small(top, 16), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def aligned_documents(docs: DataFrame, byte_tokenizer: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    A blank and the text are encoded by the tokenizer file `byte_tokenizer` (a), the text,
    before which the model puts a blank, by the sentencepiece model `piece_model` (b);
    special tokens inside a text are plain text. Groups are cut where tokens of both sides
    end; links are all pairs of tokens that share a byte. `n_best` counts the links whose pair
    of ids has the largest number of links, in the whole corpus, among the pairs of its b (ties
    included), `count_sum` adds up the links' numbers.

    Null and empty texts, and those that either side does not give back byte by byte,
    have no tokens: zeros and an empty digest. Documents without a doc_id and repeated rows are
    documents like any other. Other columns are ignored. An empty table gives no rows.
    """
    aligned = aligned_blocks(docs, byte_tokenizer, piece_model)
    pairs, counts = pair_counts(aligned)
    known = pairs.join(counts, ["a", "b"]).select(F.col("block").alias("of"), "code", "n", "best")
    names = [c.split()[0] for c in _DOC.split(", ")]

    def look_up(documents: pa.Table, found: pa.Table) -> pa.Table:
        size = found.num_rows
        code = found["code"].to_numpy()
        n, best = np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=np.int64)
        n[code + 1] = found["n"].to_numpy()
        best[code + 1] = found["best"].to_numpy(zero_copy_only=False)
        lists = documents["codes"].combine_chunks()
        codes = lists.flatten().to_numpy() + 1
        bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        sums = {"n_best": best, "count_sum": n}
        out = {k: documents[k] for k in names if k not in ("codes", "groups_sha256")}
        for k, values in sums.items():
            total = np.append(0, np.cumsum(values[codes]))[bounds]
            out[k] = pa.array(np.diff(total))
        return pa.table(out | {"groups_sha256": documents["groups_sha256"]})

    rows = aligned.filter("pair_a is null").select("block", *names)
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")
    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(look_up, schema)
