"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers, so sums over any number of rows are exact. Vectors are
grouped to distinct ones once; from there the matrix X of centred distinct vectors is only
read by products: Xv, and X'u, each one pass whose tasks add up small matrices. The method
runs on blocks of vectors (as many as components asked for, so an eigenvalue that occurs
that often is found that often): X V_k = U_{k-1} S_{k-1}' + U_k A_k and X'U_k = V_k A_k' + V_{k+1} S_k.

The long left vectors are never stored. U = X W, with small coefficients W, is formed again
from each batch of rows, and inner products with all former left vectors are summed over
the rows themselves. Every new block, left and right, is orthogonalised against all former
ones twice. The singular value decomposition of the small block-bidiagonal matrix
gives components and deviations; it ends when the wanted ones leave no rest or V spans all dimensions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.llm.tables import batch_of, map_columns
from caselog.session import cut

SCALE = 64
SHIFT = 1_000_000
LIMBS = 3                # a whole number is summed in parts of 21 bits, so that sums are exact
LIMB_BITS = 21
LARGEST = 1 << 62        # entries beyond this are none
SUM_TASKS = 16           # that add up the tasks' matrices before the driver does
TOLERANCE = 1e-14
FLAT = 1e-8              # deviations under this share of the largest are none


@dataclass(frozen=True)
class Whitening:
    """`components` has one column per component; `sums` are those of x over the `n` distinct vectors."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dims(self) -> int:
        return len(self.sums)


def _entries(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are usable, and floor(64 * entry) of those."""
    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
    right = length == dims
    values = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values.reshape(-1, dims) * SCALE)
        sound = (np.abs(scaled) < LARGEST).all(axis=1)  # false for what is not a number
    usable = right.copy()
    usable[right] = sound
    return usable, scaled[sound].astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of packed whole numbers."""
    data = np.frombuffer(column.buffers()[2], dtype="<i8") if len(column) else np.zeros(0, dtype="<i8")
    first = column.offset * dims
    return data[first:first + len(column) * dims].reshape(-1, dims)


def whole_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key, x) of the usable rows; `x` packs floor(64 * entry) as 64-bit numbers."""

    def work(batch: pa.RecordBatch):
        usable, x = _entries(batch.column("vector"), dims)
        packed = pa.Array.from_buffers(pa.binary(), len(x), [
            None, pa.py_buffer((np.arange(len(x) + 1) * (8 * dims)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
        yield batch_of(key=batch.column("key").filter(pa.array(usable)), x=packed)

    return map_columns(df, {"key": F.col(key), "vector": F.col(vector).cast("array<double>")},
                       f"key {df.schema[key].dataType.simpleString()}, x binary", work)


def dimensions(df: DataFrame, vector: str) -> int:
    """The most frequent length of a vector, the larger one of equals; 0 without vectors."""
    sizes = df.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max(F.struct("n", "d")).alias("top")).first()
    return row["top"]["d"] if row["top"] else 0


def _summed(rows: DataFrame, dims: int, work, kind: str) -> np.ndarray:
    """`work` of each batch of the packed matrix, a flat array, added up over all rows."""

    def add(batches, form):
        total = None
        for batch in batches:
            found = form(batch)
            total = found if total is None else total + found
        if total is not None:
            yield batch_of(total=pa.array([total.tobytes()], pa.binary()))

    def added(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.frombuffer(x.as_buffer(), dtype=kind) for x in batch.column("total"))

    tasks = rows.select("x").mapInArrow(partial(add, form=lambda b: work(_matrix(b.column("x"), dims))), "total binary")
    few = tasks.repartition(SUM_TASKS).mapInArrow(partial(add, form=added), "total binary")
    return sum(np.frombuffer(r["total"], dtype=kind) for r in few.collect())


def _limbs(x: np.ndarray) -> np.ndarray:
    """Sums of the parts of whole numbers, and the number of rows."""
    parts = [(x >> (LIMB_BITS * k)) if k == LIMBS - 1 else (x >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1)
             for k in range(LIMBS)]
    return np.append(np.concatenate([p.sum(axis=0) for p in parts]), len(x))


@dataclass
class _Products:
    """Passes over the centred matrix; every result is a small one."""

    rows: DataFrame
    mean: np.ndarray

    def _run(self, form, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
        mean = self.mean

        def work(x: np.ndarray) -> np.ndarray:
            return np.concatenate([m.ravel() for m in form(x - mean)])

        total = _summed(self.rows, len(mean), work, "<f8")
        ends = np.cumsum([a * b for a, b in shapes])
        return [p.reshape(s) for p, s in zip(np.split(total, ends[:-1]), shapes, strict=True)]

    def inner(self, before: np.ndarray, block: np.ndarray) -> np.ndarray:
        """(X before)'(X block)."""
        [found] = self._run(lambda x: [(x @ before).T @ (x @ block)], [(before.shape[1], block.shape[1])])
        return found

    def inner_and_gram(self, before: np.ndarray, block: np.ndarray) -> list[np.ndarray]:
        """The same, and (X block)'(X block)."""
        k, b = before.shape[1], block.shape[1]

        def form(x):
            q = x @ block
            return [(x @ before).T @ q, q.T @ q]

        return self._run(form, [(k, b), (b, b)])

    def inner_gram_and_back(self, before: np.ndarray, block: np.ndarray) -> list[np.ndarray]:
        """The same, and X'(X block)."""
        (d, b), k = block.shape, before.shape[1]

        def form(x):
            q = x @ block
            return [(x @ before).T @ q, q.T @ q, x.T @ q]

        return self._run(form, [(k, b), (b, b), (d, b)])

    def squares(self) -> float:
        [[[found]]] = self._run(lambda x: [np.array([[np.einsum("ij,ij->", x, x)]])], [(1, 1)])
        return float(found)


def _root(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(L, M) with Q = U L and U = Q M orthonormal, for Q'Q = gram; directions shorter than `least` are left out."""
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    keep = value > max(least, 0.0) ** 2
    length = np.sqrt(value[keep])
    return length[:, None] * vector[:, keep].T, vector[:, keep] / length


def _rest(block: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what `block` adds to the orthonormal `right`."""
    if right.shape[1] == len(right):
        return block[:, :0]
    size = None
    for _ in range(2):
        block = block - right @ (right.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        size = s if size is None else size
        block = u[:, size > least][:, :len(right) - right.shape[1]]
        size = size[size > least][:block.shape[1]]
    return block


def _bidiagonalise(products: _Products, dims: int, count: int, seed: int):
    """Deviations times sqrt(n), and components, of the `count` largest."""
    width = min(count, dims)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    right, left = block[:, :0], block[:, :0]     # V, and W with U = X W
    back = block[:, :0]                          # X'U
    band = np.zeros((0, 0))
    scale = 0.0
    while True:
        inner = np.zeros((left.shape[1], block.shape[1]))
        coefficients = block
        if left.shape[1]:
            inner = products.inner(left, block)
            coefficients = block - left @ inner
        again, gram = products.inner_and_gram(left, coefficients)
        coefficients, inner = coefficients - left @ again, inner + again
        gram = gram - again.T @ again
        scale = max(scale, math.sqrt(max(np.diag(gram).max(initial=0.0), 0.0)))
        if scale == 0.0:
            return np.zeros(0), block[:, :0]
        lower, made = _root(gram, FLAT * scale)
        coefficients = coefficients @ made
        again, gram, forth = products.inner_gram_and_back(left, coefficients)
        second, made = _root(gram - again.T @ again, 0.5)
        coefficients = (coefficients - left @ again) @ made
        forth = (forth - back @ again) @ made
        inner, lower = inner + again @ lower, second @ lower
        known = np.zeros((band.shape[0] + len(lower), band.shape[1] + block.shape[1]))
        known[:band.shape[0], :band.shape[1]] = band
        known[:band.shape[0], band.shape[1]:] = inner
        known[band.shape[0]:, band.shape[1]:] = lower
        band = known
        right, left, back = np.hstack([right, block]), np.hstack([left, coefficients]), np.hstack([back, forth])
        block = _rest(forth, right, TOLERANCE * scale)
        u, deviation, v = np.linalg.svd(band, full_matrices=False)
        # What X'U_k holds beyond V, seen by each left vector, is the error of its pair.
        error = np.linalg.norm((block.T @ forth) @ u[len(u) - forth.shape[1]:, :count], axis=0)
        if not block.shape[1] or (len(deviation) >= count and (error <= TOLERANCE * scale).all()):
            return deviation[:count], (right @ v.T)[:, :count]


def fit_whitening(vectors: DataFrame, dims: int, components: int = 16, seed: int = 11) -> Whitening:
    """Fit on the distinct `x` of `vectors`, as `whole_vectors` gives them.

    Components are numbered by falling eigenvalue; the largest entry of each is
    positive. Directions whose deviation is under 1e-8 of the largest have no
    component, so equal vectors, a single one, or none give no component.
    """
    rows = cut(vectors.select("x").distinct(), "distinct")
    counted = _summed(rows, dims, _limbs, "<i8") if dims else 0
    if not np.any(counted):
        return Whitening(0, (0,) * dims, np.zeros((dims, 0)), np.zeros(0), np.zeros(0), 0.0)
    n = int(counted[-1])
    parts = counted[:-1].reshape(LIMBS, dims)
    centre = [sum(int(p) << (LIMB_BITS * k) for k, p in enumerate(column)) for column in parts.T]
    products = _Products(rows, np.array([s / n for s in centre]))
    size, right = _bidiagonalise(products, dims, components, seed)
    size, right = size[size > 0], right[:, :int((size > 0).sum())]
    right = right * np.sign(right[np.abs(right).argmax(axis=0), np.arange(right.shape[1])])
    value = size ** 2 / n
    error, total = 0.0, 1.0
    if len(value):
        total = products.squares() / n
        unit = right / np.sqrt(value)
        _, gram = products.inner_and_gram(unit[:, :0], unit)
        error = float(np.abs(gram / n - np.eye(len(value))).max())
    return Whitening(n, tuple(s + n * SHIFT for s in centre), right, value, value / total, error)


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation, whitened) of every row of `vectors`, repeated ones too.

    `deviation` is the sum over the dimensions of (n * x - S) squared, exact;
    null where it exceeds a long. `whitened` holds one value per component.
    """
    n, dims = model.n, model.dims
    centre = [s - n * SHIFT for s in model.sums]
    mean = np.array([s / n for s in centre]) if n else np.zeros(dims)
    unit = model.components / np.sqrt(model.eigenvalues)
    largest = max(map(abs, centre), default=0)

    def work(batch: pa.RecordBatch):
        x = _matrix(batch.column("x"), dims)
        if not len(x):
            return
        bound = int(np.abs(x).max()) * n + largest
        if bound ** 2 * dims < 1 << 63:
            deviation = pa.array(((n * x - np.array(centre)) ** 2).sum(axis=1), pa.int64())
        else:
            exact = ((x.astype(object) * n - np.array(centre, dtype=object)) ** 2).sum(axis=1)
            deviation = pa.array([int(v) if v < 1 << 63 else None for v in exact], pa.int64())
        values = (x - mean) @ unit
        ends = np.arange(len(x) + 1) * values.shape[1]
        yield batch_of(key=batch.column("key"), deviation=deviation,
                       whitened=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.ravel())))

    kind = vectors.schema["key"].dataType.simpleString()
    return map_columns(vectors, {"key": F.col("key"), "x": F.col("x")},
                       f"key {kind}, deviation long, whitened array<double>", work)


def whitened_rows(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per usable row and component.

    Rows whose vector is null, empty, of another length than most, or holds an entry
    that is null, not finite, or too large for a long are left out. Repeated rows, and rows
    without a key, are rows like any other. Other columns are ignored. An empty
    table gives no rows, nor does one whose vectors are all equal.
    """
    dims = dimensions(df, vector)
    if not dims:
        return df.sparkSession.createDataFrame([], f"{key} {df.schema[key].dataType.simpleString()}, component int, "
            "n long, deviation long, whitened double, explained double, identity_error double")
    vectors = cut(whole_vectors(df, key, vector, dims), "vectors")
    model = fit_whitening(vectors, dims, components)
    share = F.lit(model.explained.tolist()) if len(model.explained) else F.expr("cast(array() as array<double>)")
    rows = whitened(vectors, model).select("key", "deviation", F.posexplode("whitened").alias("place", "value"))
    return rows.select(
        F.col("key").alias(key), (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
        "deviation", F.col("value").alias("whitened"), F.get(share, F.col("place")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
