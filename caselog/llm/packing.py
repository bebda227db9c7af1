"""Packing of documents into sequences of a fixed window, in order, by dynamic programming.

Documents are sorted by range of doc_id and encoded; the ids of a partition are one
stream, taken in chains that end with a document. A chain is cut into sequences at
chosen places: ends of documents, ends of sentences, and, where neither is near, places
inside a sentence. Each sequence costs its padding and a small constant, and each
cut a penalty by its kind (a truncated document). The cheapest set of cuts is found in one
walk over the places: with all places at most a window behind, cost(j) = cut(j) + window -
at(j) + min(cost(i) + at(i)), a minimum over a sliding range, kept by a monotone queue. A
sequence whose length is a power of two has no padding; these few places are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.tables import BATCH_ROWS, batch_of, give_back
from caselog.llm.units import byte_level, shared

CHAIN_TOKENS = 1 << 20   # a chain ends with the document that reaches this
OUT_SEQUENCES = 256      # of a batch that leaves Python

# In tokens of padding.
SEQUENCE_COST = 4        # of each sequence
SENTENCE_COST = 8        # of a cut between sentences of a document
WORD_COST = 32           # of a cut inside a sentence
STEP = 64                # longer stretches without a place have one at each multiple

PIECE = "struct<doc_id:long,start:long,length:long,doc_tokens:long>"


def places(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, opens: np.ndarray, window: int):
    """Where a stream may be cut, and what each cut costs.

    `ends` are the ends of its documents; `stops` and `opens` tell of each id
    whether it may close a sentence, and whether it may stand after such a close. The
    last two windows may be cut anywhere, so that a chain need not end in padding.
    """
    total = len(ids)
    kind = np.zeros(total + 1, dtype=np.int8)
    if total > 1:
        closing = stops[ids[:-1]]
        kind[1:-1][(closing == 2) | ((closing == 1) & opens[ids[1:]])] = 2
    kind[max(1, total - 2 * window):][kind[max(1, total - 2 * window):] == 0] = 1
    kind[ends] = 3
    kind[0] = 3
    at = np.flatnonzero(kind)
    gap = np.diff(at)
    more = np.maximum((gap - 1) // STEP, 0)
    if more.any():
        wide = np.repeat(at[:-1], more)
        order = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        kind[wide + order * STEP] = 1
        at = np.flatnonzero(kind)
    return at, np.array([0, WORD_COST, SENTENCE_COST, 0])[kind[at]]


def cheapest_cuts(at: np.ndarray, cost: np.ndarray, window: int) -> list[int]:
    """The places, first and last included, that cut `at[0]..at[-1]` at least cost.

    Neighbouring places are at most a window apart. Of equal choices the longer
    sequence is taken.
    """
    n = len(at)
    # Pairs of places a power of two apart, in order of the later one.
    pairs, size = [], 1
    while size <= window:
        if size < window or size & (size - 1) == 0:
            found = np.minimum(np.searchsorted(at, at - size), n - 1)
            later = np.flatnonzero(at[found] == at - size)
            pairs.append(np.stack([later, found[later]]))
        size *= 2
    later, earlier = np.concatenate(pairs, axis=1)
    order = np.argsort(later, kind="stable")
    later, earlier = [*later[order].tolist(), n], earlier[order].tolist()
    places, price = at.tolist(), (cost + SEQUENCE_COST).tolist()
    best, came, key = [0] * n, [0] * n, [0] * n   # key: best + place
    queue, head, last = [0] * n, 0, 0             # places by rising key, of which queue[head:last] can be reached
    pair, due = 0, later[0]
    for j in range(1, n):
        value = key[j - 1]
        while last > head and key[queue[last - 1]] > value:
            last -= 1
        queue[last] = j - 1
        last += 1
        here = places[j]
        reach = here - window
        while places[queue[head]] < reach:
            head += 1
        first = queue[head]
        least = key[first] - reach
        while due == j:
            i = earlier[pair]
            if best[i] < least:
                least, first = best[i], i
            pair += 1
            due = later[pair]
        best[j] = least = least + price[j]
        came[j] = first
        key[j] = least + here
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [places[k] for k in reversed(cuts)]


def sentence_marks(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each id: 2 if a sentence ends with it, 1 if one ends when the next opens; and whether it opens one."""
    stops = [2 if t.endswith(b"\n") else 1 if t.endswith((b".", b"!", b"?")) else 0 for t in tokens]
    return np.array(stops, dtype=np.int8), np.array([t[:1].isspace() for t in tokens])


def _sequences(ids: np.ndarray, cuts: np.ndarray, docs: pa.Array, ends: np.ndarray, first: int):
    """Batches of sequences, numbered from `first`, of one chain."""
    starts = np.append(0, ends[:-1])
    edges = np.union1d(cuts, ends)
    edges = edges[edges > 0]
    begin = np.append(0, edges[:-1])
    doc = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    bound = np.searchsorted(sequence, np.arange(len(cuts)))
    size = np.diff(cuts)
    raw = ids.astype("<u4").tobytes()
    for at in range(0, len(size), OUT_SEQUENCES):
        last = min(at + OUT_SEQUENCES, len(size))
        p = slice(bound[at], bound[last])
        pieces = pa.StructArray.from_arrays(
            [docs.take(pa.array(doc[p])), pa.array(begin[p] - starts[doc[p]]),
             pa.array(edges[p] - begin[p]), pa.array(ends[doc[p]] - starts[doc[p]])],
            names=["doc_id", "start", "length", "doc_tokens"])
        yield batch_of(
            sequence_id=first + np.arange(at, last), n_tokens=size[at:last],
            ids=pa.array([raw[4 * a:4 * b] for a, b in zip(cuts[at:last].tolist(), cuts[at + 1:last + 1].tolist(), strict=True)],
                         pa.binary()),
            pieces=pa.ListArray.from_arrays(pa.array((bound[at:last + 1] - bound[at]).astype(np.int32)), pieces))


def packed(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """sequence_id, n_tokens, ids, pieces: the documents packed in order of doc_id.

    `ids` are little-endian unsigned 32-bit numbers; `pieces` lists what stands in
    the sequence, gapless and in order: doc_id, its first id there (`start`), their
    number (`length`) and that of the whole document with its end id
    (`doc_tokens`). A document's pieces follow each other through sequences with
    rising, but not always neighbouring, sequence_id; each of its ids is in one piece. `tokenizer` is
    the path of a tokenizer file, the same on all executors.

    A null or empty text is its end id only. Documents without a doc_id come first and
    keep the null; documents of one doc_id are ordered by a hash of their text, repeated rows
    are documents of their own. Other columns are ignored. An empty table gives no sequence.
    """

    def run(batches):
        units = shared(byte_level, tokenizer)
        stops, opens = sentence_marks(units.tokens())
        number = TaskContext.get().partitionId() << 32
        keys: list[pa.Array] = []
        streams: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def close():
            nonlocal held, number
            ids, ends = np.concatenate(streams), np.cumsum(np.concatenate(sizes))
            names = pa.concat_arrays(keys)
            cuts = np.array(cheapest_cuts(*places(ids, ends, stops, opens, window), window))
            for part in (keys, streams, sizes):
                part.clear()
            held = 0
            yield from _sequences(ids, cuts, names, ends, number)
            number += len(cuts) - 1

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for first, ids, bounds in units.encode(part.column("text")):
                    rows = len(bounds) - 1
                    stream = np.insert(ids, bounds[1:], end_id)   # after each document
                    ends = bounds[1:] + np.arange(1, rows + 1)
                    # A chain ends with the document that reaches its size.
                    begin = 0
                    while begin < rows:
                        done = int(ends[begin - 1]) if begin else 0
                        last = min(int(np.searchsorted(ends, done + CHAIN_TOKENS - held)) + 1, rows)
                        keys.append(part.column("doc_id").slice(first + begin, last - begin))
                        streams.append(stream[done:ends[last - 1]])
                        sizes.append(np.diff(ends[begin:last], prepend=done))
                        held += int(ends[last - 1]) - done
                        begin = last
                        if held >= CHAIN_TOKENS:
                            yield from close()
        if held:
            yield from close()
        give_back()

    tie = F.xxhash64("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = plain.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return ordered.mapInArrow(run, f"sequence_id long, n_tokens long, ids binary, pieces array<{PIECE}>")


def piece_rows(sequences: DataFrame) -> DataFrame:
    """A row per piece of `packed` sequences: where it stands, and the crc32 of its ids."""
    before = F.expr("transform(pieces, (p, k) -> named_struct('piece', p, 'offset', "
                    "aggregate(slice(pieces, 1, k), 0L, (n, q) -> n + q.length)))")
    rows = sequences.select("sequence_id", "ids", F.explode(before).alias("p")).select(
        "sequence_id", "ids", "p.offset", "p.piece.*")
    own = F.expr("substring(ids, int(4 * offset) + 1, int(4 * length))")
    return rows.select("doc_id", "start", "length", F.crc32(own).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
