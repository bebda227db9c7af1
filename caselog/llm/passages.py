"""Substring deduplication: repeated lines and repeated runs of words.

A unit is a line with a word, whatever its length, or a run of `STRETCH` words at any
place. Passages are pasted into the middle of lines as well, where no whole line
repeats, so lines alone would miss them. Longer lines and passages consist of such runs.

Only runs that can repeat are hashed in full. Of every `STEP` neighbouring seeds of
`SEED` words that with the smallest hash is chosen (winnowing); a run of `STRETCH` words
holds `STEP` seeds, so equal runs choose equal seeds whatever stands around them, and a
run whose chosen seed is the only one of its kind repeats nowhere. All other runs are
compared, so spans reach to both ends of what is shared.

Units are normalised (A-Z lower-cased, blanks made equal) and hashed to 128 bits (for
a run: 64 of its chosen seed, by which all its copies meet, and 64 of the whole run),
the digests are grouped over the whole corpus, and every occurrence but that in the
earliest document is marked by its offsets in the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caselog.llm.arrays import Block, blocks, mix
from caselog.llm.tables import HOT_SHARE, batch_of, map_columns, same
from caselog.session import cut

STRETCH = 20
STEP = 12
SEED = STRETCH - STEP + 1
SALTS = 64  # parts of a hot seed's rows

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_OTHER = np.uint64(0xA0761D6478BD642F)


class _Runs:
    """Digests of runs of words, from running sums."""

    def __init__(self, words: np.ndarray):
        power = np.full(len(words) + 1, _BASE, dtype=np.uint64)
        back = np.full(len(words) + 1, _INVERSE, dtype=np.uint64)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        self.back = np.multiply.accumulate(back)
        self.sums = []
        for values in (words, mix(words ^ _OTHER)):
            total = np.zeros(len(words) + 1, dtype=np.uint64)
            np.cumsum(values * power[:-1], out=total[1:])
            self.sums.append(total)

    def digest(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words first..last-1, by order and number."""
        length = (last - first).astype(np.uint64) * _OTHER
        return tuple(mix((total[last] - total[first]) * self.back[first] + length) for total in self.sums)


class _Seeds:
    """The runs of `STRETCH` words of a block, and the chosen seed of each."""

    def __init__(self, block: Block, runs: _Runs, n_words: int):
        self.hashes = runs.digest(np.arange(max(n_words - SEED + 1, 0)), np.arange(SEED, max(n_words, SEED - 1) + 1))[0]
        sizes = np.maximum(np.diff(block.bound) - STRETCH + 1, 0)
        #: First word and row of every run that lies within a row.
        self.row = np.repeat(np.arange(block.rows), sizes)
        self.run = np.arange(len(self.row)) + np.repeat(block.bound[:-1] - np.cumsum(sizes) + sizes, sizes)
        self.seed = self.run
        if len(self.run):
            near = np.lib.stride_tricks.sliding_window_view(self.hashes, STEP)
            self.seed = self.run + np.argmin(near, axis=1)[self.run]

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of each chosen seed, once."""
        place, at = np.unique(self.seed, return_index=True)
        return self.row[at], place


def _repeats(row: np.ndarray, first: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether an equal unit stands earlier in the same row."""
    order = np.lexsort((first, h2, h1, row))
    repeat = np.zeros(len(order), dtype=bool)
    a, b = order[1:], order[:-1]
    repeat[a] = (row[a] == row[b]) & (h1[a] == h1[b]) & (h2[a] == h2[b])
    return repeat


def _with_hash(docs: DataFrame) -> dict:
    return {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text"), "text_hash": F.xxhash64("text")}


def _unit_batch(batch: pa.RecordBatch, block: Block, row, first, last, h1, h2, **more) -> pa.RecordBatch:
    heads = block.characters()
    begin = heads[block.at[row]]
    place = pa.array(row + block.first)
    return batch_of(
        doc_id=batch.column("doc_id").take(place), text_hash=batch.column("text_hash").take(place),
        h1=h1.view(np.int64), h2=h2.view(np.int64), start=(heads[block.start[first]] - begin).astype(np.int32),
        end=(heads[block.end[last - 1]] - begin).astype(np.int32), **more)


_UNIT = "doc_id long, text_hash long, h1 long, h2 long, start int, end int, repeat boolean"


def _line_rows(docs: DataFrame) -> DataFrame:
    """All lines with a word."""
    def work(batch: pa.RecordBatch):
        for block in blocks(batch.column("text")):
            if not len(block.start):
                continue
            breaks = np.searchsorted(block.start, np.flatnonzero(block.data == 0x0A))
            edges = np.unique(np.concatenate([block.bound, breaks]))
            first, last = edges[:-1], edges[1:]
            row = np.searchsorted(block.bound, first, side="right") - 1
            with np.errstate(over="ignore"):
                h1, h2 = _Runs(block.hashes()).digest(first, last)
            yield _unit_batch(batch, block, row, first, last, h1, h2, repeat=_repeats(row, first, h1, h2))

    return map_columns(docs, _with_hash(docs), _UNIT, work)


def _seed_rows(docs: DataFrame, hot: np.ndarray | None = None) -> DataFrame:
    """Chosen seeds: the hash alone, or with `hot` hashes also text, place and part."""
    def work(batch: pa.RecordBatch):
        for block in blocks(batch.column("text")):
            with np.errstate(over="ignore"):
                seeds = _Seeds(block, _Runs(block.hashes()), len(block.start))
            row, place = seeds.chosen()
            h = seeds.hashes[place].view(np.int64)
            if hot is None:
                yield batch_of(h=h)
                continue
            at = pa.array(row + block.first)
            yield batch_of(
                doc_id=batch.column("doc_id").take(at), text_hash=batch.column("text_hash").take(at), h=h,
                place=(place - block.bound[row]).astype(np.int32),
                part=np.where(np.isin(h, hot), (place + batch.num_rows * row) % SALTS, 0).astype(np.int32))

    if hot is None:
        return map_columns(docs, {"text": F.col("text")}, "h long", work)
    return map_columns(docs, _with_hash(docs), "doc_id long, text_hash long, h long, place int, part int", work)


def _run_rows(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """The runs of `STRETCH` words whose chosen seed is one of the text's `places`."""
    def work(batch: pa.RecordBatch):
        places = batch.column("places")
        size = places.value_lengths().to_numpy(zero_copy_only=False)
        place, ends = places.flatten().to_numpy(), np.append(0, np.cumsum(size))
        for block in blocks(batch.column("text")):
            with np.errstate(over="ignore"):
                runs = _Runs(block.hashes())
                seeds = _Seeds(block, runs, len(block.start))
                again = np.zeros(len(block.start), dtype=bool)
                low, high = block.first, block.first + block.rows
                again[place[ends[low]:ends[high]] + np.repeat(block.bound[:-1], size[low:high])] = True
                here = np.flatnonzero(again[seeds.seed])
                row, first = seeds.row[here], seeds.run[here]
                seed = seeds.seed[here]
                h1, h2 = seeds.hashes[seed], runs.digest(first, first + STRETCH)[1]
            yield _unit_batch(
                batch, block, row, first, first + STRETCH, h1, h2, repeat=_repeats(row, first, h1, h2),
                place=(seed - block.bound[row]).astype(np.int32), hot=np.isin(h1.view(np.int64), hot))

    return map_columns(
        texts, {c: F.col(c) for c in ("doc_id", "text", "text_hash", "places")}, f"{_UNIT}, place int, hot boolean", work)


def _repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs that may repeat: stored ones of hot seeds, and the others, of which no group is large."""
    again = cut(_seed_rows(docs).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "seeds")
    total = again.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * HOT_SHARE > total
    hot = np.array([r["h"] for r in again.filter(large).collect()], dtype=np.int64)  # fewer than `HOT_SHARE`
    parts = again.select("h", F.explode(F.sequence(F.lit(0), F.when(large, SALTS - 1).otherwise(0))).alias("part"))
    per = _seed_rows(docs, hot).join(parts, ["h", "part"], "left_semi").groupBy("doc_id", "text_hash").agg(
        F.collect_list("place").alias("places"))
    texts = docs.select(*[c.alias(n) for n, c in _with_hash(docs).items()])
    keys = ["doc_id", "text_hash"]
    runs = cut(_run_rows(texts.join(per, same(texts, per, keys)).select(
        texts["doc_id"], texts["text"], texts["text_hash"], "places"), hot), "runs")
    return runs.filter("hot").drop("place", "hot"), runs.filter("not hot").drop("hot")


_LATER = "repeat or not doc_id <=> kept_doc_id"
_PART = ["doc_id", "text_hash", "start", "end", "kept_doc_id"]


def _marked(rows: DataFrame) -> DataFrame:
    """The stored units that stand in an earlier document or earlier in their own, overlapping ones of
    a hot group as one span; groups of any size.

    Units of a group with over a thousandth of all rows are marked where they are, and neighbours that
    the same document keeps leave the task as one row: a copy of a long text is a few rows, not one for each of
    its words. There are fewer than a thousand such groups. The others meet by their digest.
    """
    total = rows.count()
    groups = cut(rows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    large = F.col("n") * HOT_SHARE > total
    hot = groups.filter(large).select("h1", "h2", "kept_doc_id").toArrow()
    rest = groups.filter(~large)
    cold = rows.join(F.broadcast(groups.filter(large).select("h1", "h2")), ["h1", "h2"], "left_anti")
    marked = cold.join(rest, ["h1", "h2"]).filter(_LATER).select(*_PART)
    if not hot.num_rows:
        return marked
    names, kept = _digests(hot["h1"], hot["h2"]), hot["kept_doc_id"].combine_chunks()
    keeps = kept.fill_null(0).to_numpy(zero_copy_only=False)
    nobody = kept.is_null().to_numpy(zero_copy_only=False)

    def work(batch: pa.RecordBatch):
        at = pa.compute.index_in(_digests(batch.column("h1"), batch.column("h2")), names)
        batch = batch.filter(at.is_valid())
        at = at.drop_null().to_numpy()
        doc = batch.column("doc_id")
        missing, ids = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(zero_copy_only=False)
        own = np.where(missing | nobody[at], missing & nobody[at], ids == keeps[at])
        later = batch.column("repeat").to_numpy(zero_copy_only=False) | ~own
        batch, at, missing, ids = batch.filter(pa.array(later)), at[later], missing[later], ids[later]
        if not len(at):
            return
        start, end, text = (batch.column(c).to_numpy() for c in ("start", "end", "text_hash"))
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = ((ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1]) | (text[1:] != text[:-1]) | (keeps[at[1:]] != keeps[at[:-1]])
                     | (nobody[at[1:]] != nobody[at[:-1]]) | (start[1:] > end[:-1]) | (start[1:] < start[:-1]))
        first = np.flatnonzero(opens)
        place = pa.array(first)
        yield batch_of(
            doc_id=batch.column("doc_id").take(place), text_hash=batch.column("text_hash").take(place), start=start[first],
            end=np.maximum.reduceat(end, first), kept_doc_id=kept.take(pa.array(at[first])))

    columns = {c: F.col(c) for c in ("doc_id", "text_hash", "h1", "h2", "start", "end", "repeat")}
    return marked.unionByName(map_columns(
        rows, columns, "doc_id long, text_hash long, start int, end int, kept_doc_id long", work))


def _digests(h1, h2) -> pa.Array:
    """Both halves as one value of 16 bytes."""
    both = np.stack([h1.to_numpy(), h2.to_numpy()], axis=1)
    return pa.Array.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(np.ascontiguousarray(both))])


def _marked_by_seed(runs: DataFrame) -> DataFrame:
    """The same for runs of seeds that are not hot, dealt out once: the runs of one chosen seed, which all hold it, are one part."""
    kept = F.min("doc_id").over(Window.partitionBy("h1", "h2"))
    return runs.repartition("h1").withColumn("kept_doc_id", kept).filter(_LATER).groupBy(
        "h1", "doc_id", "text_hash", "place").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("kept_doc_id").alias("kept_doc_id")).select(*_PART)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end, n_chars, kept_doc_id of every span to be removed.

    `start` and `end` are code points of the original text; overlapping units are
    one span. The occurrence kept is that of the smallest doc_id and there the first;
    `kept_doc_id` is the smallest document that keeps a unit of the span. A text
    that repeats a unit within itself keeps the first.

    Rows that share a doc_id count as one document and keep the same units; repeated
    rows give their spans once. Rows without a doc_id come after all others and
    count as one document. Null, empty and blank texts have no units. Other columns are ignored. An empty table gives no rows.
    """
    lines = cut(_line_rows(docs), "lines")
    hot, others = _repeated_runs(docs)
    marked = _marked(lines).unionByName(_marked(hot)).unionByName(_marked_by_seed(others))
    # One text's spans come together; they are bounded by its length.
    text = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    opened = marked.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    spans = opened.withColumn("span", F.sum("opens").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("doc_id", "text_hash", "span").agg(
        F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"),
        F.min("kept_doc_id").alias("kept_doc_id"),
    ).select("doc_id", "text_hash", "start", "end", (F.col("end") - F.col("start")).alias("n_chars"), "kept_doc_id")


def without_passages(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated spans cut out of `text`, and `kept_spans`.

    `kept_spans` lists (start, end) in the original text of the parts that are
    left; they stand one after the other in `text`. A text that loses nothing
    has one span, a null text none. Other columns stay as they are, but a column
    `kept_spans` of `docs` gives way to this one.
    """
    docs = docs.drop("kept_spans")
    spans = cut(repeated_passages(docs), "spans")
    per = cut(spans.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__cuts"), "cuts")
    mine = docs.join(per, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    mine = mine.withColumn("kept_spans", F.expr(
        "if(text is null, null, filter(transform(sequence(0, size(coalesce(__cuts, array()))), k -> named_struct("
        "'start', coalesce(get(__cuts, k - 1).end, 0L), 'end', coalesce(get(__cuts, k).start, cast(length(text) as bigint)))),"
        " s -> s.end > s.start))"))
    text = F.expr("array_join(transform(kept_spans, s -> substring(text, int(s.start) + 1, int(s.end - s.start))), '')")
    return mine.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], "kept_spans")

