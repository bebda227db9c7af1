"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each of `PERMUTATIONS` hash functions gives two signature values, the smallest
and the largest hash of a document's shingles, so 64 evaluations per shingle
give 128 values. Both agree between two sets with the probability of their
Jaccard similarity, and the variance of the estimate is below that of 128
minima. Four values of one kind make a band, 32 bands in all: sets of
similarity 0.8 meet in none with probability 5e-8.

Documents with equal sets are one class from the start. In every band bucket
the members are tied to the smallest one; these links, linear in the members,
are confirmed on the full sets and joined to components. Where the members tied
to one leader are then in different components, they are tied to a second, more
central member, and the pairs that could still be linked are found by what they
share outside the leader's surroundings and confirmed too, so that no link is
lost to the choice of the leader.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrays import blocks, chain, mix
from caselog.llm.components import components
from caselog.llm.tables import HOT_SHARE, batch_of, map_columns, sent_if_small, with_group
from caselog.session import cut

PERMUTATIONS = 64
ROWS_PER_BAND = 4
COMMON = 32       # members that make a shingle part of their leader's hub

_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_FACTOR, _SHIFT = _SEEDS[:PERMUTATIONS] | np.uint64(1), _SEEDS[PERMUTATIONS:]


def shingle_sets(column: pa.Array, size: int):
    """For each row its sorted distinct shingle hashes; rows without words give none."""
    for block in blocks(column):
        words = block.hashes()
        width = max(len(words) - size + 1, 0)
        grams = chain(*[words[i:i + width] for i in range(size)]) if width else words[:0]
        for row in range(block.rows):
            low, high = block.bound[row], block.bound[row + 1]
            if high - low >= size:
                yield np.unique(grams[low:high - size + 1])
            elif high > low:
                yield chain(*words[low:high], int(high - low)).reshape(1)
            else:
                yield words[:0]


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest hash under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        hashed = _FACTOR[:, None] * (shingles[None, at:at + 512] ^ _SHIFT[:, None])
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return low >> np.uint64(16), high >> np.uint64(16)


def _bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Keys of all bands, (documents, bands)."""
    values = np.concatenate([low, high], axis=1).reshape(len(low), -1, ROWS_PER_BAND)
    number = np.arange(values.shape[1], dtype=np.uint64)[None, :]
    return chain(number, *[values[:, :, k] for k in range(ROWS_PER_BAND)])


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text hash, set size, 128-bit set digest and band keys of every row."""

    def work(batch: pa.RecordBatch):
        with np.errstate(over="ignore"):
            counts, digests, kept, low, high = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), size):
                counts.append(len(s))
                digests.append((mix(s).sum(dtype=np.uint64), mix(s ^ _SHIFT[0]).sum(dtype=np.uint64)))
                kept.append(len(s) > 0)
                if len(s):
                    a, b = min_max(s)
                    low.append(a)
                    high.append(b)
            digest = np.array(digests, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            keys = _bands(np.array(low), np.array(high)).view(np.int64) if low else np.zeros((0, 0), np.int64)
        ends = np.concatenate([[0], np.cumsum(np.array(kept) * keys.shape[1])]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
        yield batch_of(doc_id=batch.column("doc_id"), text_hash=batch.column("text_hash"),
                       n_shingles=pa.array(counts, pa.int64()), d1=digest[:, 0].copy(),
                       d2=digest[:, 1].copy(), bands=bands)

    return map_columns(
        docs, {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text"), "text_hash": F.xxhash64("text")},
        "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>", work)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept: one row per row of `docs`.

    Words are runs of bytes outside blanks, A-Z lower-cased; a set holds the
    distinct `size`-word shingles of the whole text, of a shorter text its
    whole sequence as one. Two documents are linked if 100 * common shingles >=
    `percent` * all shingles of both. `component_id` is the smallest doc_id
    reachable and `kept` says that it is the row's own.

    Null, empty and blank texts have an empty set and no links. Rows without a
    doc_id are in no component (null) and are kept. Repeated rows are returned
    as often as they occur, with the same result. A doc_id with several texts
    counts as one document in links between different sets. Other columns of
    `docs` are ignored. An empty table gives no rows.
    """
    rows = cut(signatures(docs, size), "signatures")
    filled = rows.filter("doc_id is not null and n_shingles > 0")
    # The band keys follow from the set, so they may join the grouping key.
    classes = cut(filled.groupBy("d1", "d2", "n_shingles", "bands").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    members = cut(classes.select("node", F.explode("bands").alias("bucket")), "members")
    alone = sent_if_small(_found(docs, members, size, percent), 48)
    label = classes.select("d1", "d2", "copies", "node").join(alone, "node", "left").select(
        "d1", "d2", "copies", F.coalesce("component", "node").alias("component"))
    return _labelled(rows, cut(label, "labels"))


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Every row with the component of its class; hot classes do not meet in one task."""
    total = rows.count()
    hot = F.broadcast(label.filter(F.col("copies") * HOT_SHARE > total).select(  # fewer than HOT_SHARE rows
        F.col("d1").alias("h1"), F.col("d2").alias("h2"), F.col("component").alias("hot_component")))
    none = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    spread = rows.join(hot, (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")), "left").withColumn(
        "k1", F.when(none | F.col("hot_component").isNotNull(), F.col("text_hash") + F.col("doc_id")).otherwise(
            F.col("d1"))).withColumn("k2", F.when(none | F.col("hot_component").isNotNull(), F.lit(None)).otherwise(
                F.col("d2")))
    rest = label.filter(F.col("copies") * HOT_SHARE <= total).select(
        F.col("d1").alias("k1"), F.col("d2").alias("k2"), "component")
    joined = spread.join(rest, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.coalesce("hot_component", "component"))
    return joined.select("doc_id", "text_hash", "n_shingles", own.cast("long").alias("component_id")).withColumn(
        "kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _found(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component), stored: every linked node with the smallest node it can reach."""
    buckets = cut(members.groupBy("bucket").agg(
        F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    stars = cut(with_group(members, buckets, ["bucket"], members.count()).filter("node <> a").select(
        "a", F.col("node").alias("b")).distinct(), "stars")
    tested = _confirmed(docs, stars, size, percent)
    found = cut(components(tested.filter("linked").select("a", "b")), "found")
    inside, rare = _around_hubs(tested, found)
    central = _confirmed(docs, _central_pairs(inside, tested), size, percent)
    found = _extended(found, central)
    known = tested.select("a", "b").unionByName(central.select("a", "b"))
    missed = _missed_pairs(inside, rare, found, known, percent)
    return _extended(found, _confirmed(docs, missed, size, percent))


def _extended(found: DataFrame, checked: DataFrame) -> DataFrame:
    """The stored components `found` with the linked pairs of `checked` added.

    A node tied to its component reaches what its links reached, so the links
    that are already in are not gone through again.
    """
    links = checked.filter("linked").select("a", "b")
    if not links.count():
        return found
    ties = found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return cut(components(ties.unionByName(links)), "found")


def _around_hubs(tested: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of leaders whose members are in several components.

    A leader's hub is its set and the shingles outside it that `COMMON` members or
    more have. The first table has each member's n = |set|, m = |set & hub|,
    component, and the largest component under the leader; the second the
    shingles outside the hub, each of fewer than `COMMON` members.
    """
    under = tested.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("n_b").alias("n"),
                          F.col("common").alias("m"), "outside")
    labelled = under.join(sent_if_small(found, 48), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    per = labelled.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = cut(per.groupBy("leader").agg(
        F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(
            "leader", F.col("top.component").alias("largest")), "mixed")
    inside = cut(labelled.join(mixed, "leader"), "inside")
    outside = cut(inside.select("leader", "node", F.explode("outside").alias("h")), "outside")
    often = cut(outside.groupBy("leader", "h").agg(F.count(F.lit(1)).alias("n")), "often")
    counted = cut(with_group(outside, often, ["leader", "h"], outside.count()), "counted")
    more = counted.filter(F.col("n") >= COMMON).groupBy("leader", "node").agg(F.count(F.lit(1)).alias("more"))
    hubs = cut(inside.drop("outside").join(more, ["leader", "node"], "left").withColumn(
        "m", F.col("m") + F.coalesce("more", F.lit(0))).drop("more"), "hubs")
    return hubs, counted.filter(F.col("n") < COMMON).select("leader", "node", "h")


def _central_pairs(inside: DataFrame, tested: DataFrame) -> DataFrame:
    """Untested pairs of a leader's most central member, the nearest to the hub, with members of other components."""
    central = cut(inside.filter("component = largest").groupBy("leader").agg(
        F.max(F.struct((2 * F.col("m") - F.col("n")).alias("near"), "node")).alias("top")).select(
            "leader", F.col("top.node").alias("central")), "central")
    pairs = inside.filter("component <> largest").join(central, "leader").select(
        F.least("central", "node").alias("a"), F.greatest("central", "node").alias("b")).distinct()
    return cut(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "central_pairs")


def _missed_pairs(inside: DataFrame, rare: DataFrame, found: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Untested pairs (a, b) under one leader that may be linked and would join two components.

    x is a member outside the largest component under a leader, y any member of
    another component, and H the leader's hub. Their common shingles lie in H or
    outside it, so there are at most min(|x & H|, |y & H|) + |common outside H|
    of them, and a link needs percent / (100 + percent) * (|x| + |y|). Either x and
    y share shingles outside H, found by a join on these, each of which has few
    members, or the first part suffices, which holds for few sizes of y only,
    found by a join on the size. All other pairs are ruled out without being
    formed.
    """
    labels = sent_if_small(found, 48)
    now = cut(inside.drop("component").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).join(
            found.select(F.col("node").alias("largest"), F.col("component").alias("__top")), "largest", "left").withColumn(
                "largest", F.coalesce("__top", "largest")).drop("__top"), "members_now")

    def side(rows: DataFrame, mark: str, *more: str) -> DataFrame:
        names = {"node": mark, "n": f"n{mark}", "m": f"m{mark}", "component": f"c{mark}"}
        return rows.select("leader", *more, *[F.col(c).alias(n) for c, n in names.items()])

    minor = now.filter("component <> largest")
    fits = f"cx <> cy and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)"
    enough = f"{100 + percent} * (least(mx, my) + shared) >= {percent} * (nx + ny)"
    left = side(minor.join(rare, ["leader", "node"]), "x", "h")
    right = side(now.join(rare, ["leader", "node"]), "y", "h")
    sharing = left.join(right, ["leader", "h"]).filter(fits).groupBy("leader", "x", "y").agg(
        F.count(F.lit(1)).alias("shared"),
        *[F.first(c).alias(c) for c in ("mx", "my", "nx", "ny")]).filter(enough).select("x", "y")
    lowest = F.ceil(F.col("n") * percent / 100)
    highest = F.floor(F.col("m") * (100 + percent) / percent - F.col("n"))
    small_y = side(minor.withColumn("size", F.explode(F.when(lowest <= highest, F.sequence(lowest, highest)))), "x", "size")
    fitting = small_y.join(side(now.withColumn("size", F.col("n")), "y", "size"), ["leader", "size"]).withColumn(
        "shared", F.lit(0)).filter(f"{fits} and {enough}").select("x", "y")
    pairs = sharing.unionByName(fitting).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return cut(pairs.join(known, ["a", "b"], "left_anti"), "missed")


def _confirmed(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The stored pairs (a, b) with both set sizes, the common shingles, and b's outside a."""
    nodes = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(
        pairs.select(F.col("b").alias("doc_id"))).distinct(), "nodes")
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        sent_if_small(nodes, 24), "doc_id", "left_semi"), "texts")
    both = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a"))

    def work(batch: pa.RecordBatch):
        rows = []
        with np.errstate(over="ignore"):
            for s, t in zip(shingle_sets(batch.column("text_a"), size), shingle_sets(batch.column("text_b"), size),
                            strict=True):
                rest = np.setdiff1d(t, s, assume_unique=True)
                common = len(t) - len(rest)
                linked = common > 0 and 100 * common >= percent * (len(s) + len(rest))
                rows.append((linked, len(t), common, rest.view(np.int64)))
        linked, n_b, common, outside = zip(*rows, strict=True) if rows else ((), (), (), ())
        ends = np.cumsum([0, *map(len, outside)]).astype(np.int32)
        flat = np.concatenate(outside) if rows else np.zeros(0, np.int64)
        yield batch_of(a=batch.column("a"), b=batch.column("b"), linked=pa.array(linked, pa.bool_()),
                       n_b=pa.array(n_b, pa.int64()), common=pa.array(common, pa.int64()),
                       outside=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    checked = map_columns(both, {c: F.col(c) for c in ("a", "b", "text_a", "text_b")},
                          "a long, b long, linked boolean, n_b long, common long, outside array<long>", work)
    return cut(checked, "checked")


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that are kept: one document of each group.

    All rows without a doc_id stay, and so do all rows that repeat the kept one.
    """
    gone = cut(near_duplicates(docs, size, percent).filter("not kept").select("doc_id", "text_hash").distinct(), "gone")
    small = sent_if_small(gone, 32)
    mine = docs.withColumn("__text_hash", F.xxhash64("text"))
    return mine.join(small, (mine["doc_id"] == small["doc_id"]) & (mine["__text_hash"] == small["text_hash"]),
                     "left_anti").select(*docs.columns)

