import math

import numpy as np
import pytest

from caselog.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, key string, x string, component string, whitened string, n string"


def frame(spark, rows):
    made = [(i, None if v is None else [None if e is None else float(e) for e in v], "a", "b", "c", "d", "e") for i, v in rows]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


def brute(rows, count=16):
    """Components by a full eigendecomposition of the covariance of the distinct vectors."""
    known = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v] for _, v in known], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums).astype(float) / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    keep = min(count, int((value > 1e-13 * value[0]).sum())) if value[0] > 0 else 0
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    projected = ((x * n - sums).astype(float) / n) @ vector[:, :keep] / np.sqrt(value[:keep])
    return [i for i, _ in known], n, deviation, projected, value[:keep] / value.sum()


def compare(spark, rows):
    ids, n, deviation, projected, share = brute(rows)
    found = w.whitened_rows(frame(spark, rows)).collect()
    assert len(found) == len(ids) * len(share)
    assert {r.n for r in found} <= {n}
    assert all(r.identity_error < 1e-9 for r in found)
    by_row = {}
    for r in found:
        by_row.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append((r.whitened, r.explained))
    sign = np.zeros(len(share))
    for i, d, values in zip(ids, deviation, projected, strict=True):
        for k, value in enumerate(values):
            got, explained = by_row[i, int(d)][k + 1][0]
            assert abs(abs(got) - abs(value)) < 1e-8 and abs(explained - share[k]) < 1e-9
            if abs(value) > 1e-3:
                assert sign[k] in (0, np.sign(got * value))  # either sign, the same for all rows
                sign[k] = np.sign(got * value)
    return found


def random_rows(seed, n, dims, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(dims) * np.linspace(spread, 1, dims)).tolist()) for i in range(n)]


def test_against_eigendecomposition(spark):
    compare(spark, random_rows(1, 300, 40))


def test_few_dimensions_and_repeated_rows(spark):
    rows = random_rows(2, 60, 5, 30.0)
    compare(spark, rows + rows[:20] + [(None, rows[0][1])] + [(1000 + i, rows[1][1]) for i in range(40)])


def test_rank_below_the_number_of_components(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, (3, 24))
    found = compare(spark, [(i, (rng.integers(-9, 9, 3) @ base / 64).tolist()) for i in range(80)])
    assert {r.component for r in found} == {1, 2, 3}


def test_edges(spark, testdata):
    good = random_rows(4, 50, 8)
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [math.nan] + [1.0] * 7),
           (905, [math.inf] + [1.0] * 7), (906, [3e38] * 8)]
    ids = {r.vec_id for r in w.whitened_rows(frame(spark, good + bad)).collect()}
    assert ids == {i for i, _ in good}
    compare(spark, good)


def test_nothing_to_whiten(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        found = w.whitened_rows(frame(spark, rows))
        assert found.columns == names and found.collect() == []


def test_equal_eigenvalues_are_all_found(spark):
    """Twenty directions of the same spread."""
    rows = []
    for k in range(20):
        for sign in (1, -1):
            rows.append((len(rows), [sign * (k == j) for j in range(20)]))
    found = w.whitened_rows(frame(spark, rows)).collect()
    assert {r.component for r in found} == set(range(1, 17))
    assert all(abs(r.explained - 1 / 20) < 1e-12 and r.identity_error < 1e-9 for r in found)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(0, [2.0 ** 40, 0.0]), (1, [-(2.0 ** 40), 1.0]), (2, [0.0, 5.0])]
    found = w.whitened_rows(frame(spark, rows)).collect()
    assert {r.vec_id: r.deviation for r in found}[0] is None


@pytest.mark.parametrize("start", [0, 3])
def test_early_end_gives_the_same(spark, start):
    """A wide matrix: the band ends before it spans all dimensions."""
    rng = np.random.default_rng(start)
    scale = np.r_[np.full(4, 40.0), np.full(116, 0.2)]
    rows = [(i, (rng.standard_normal(120) * scale).tolist()) for i in range(400)]
    df = frame(spark, rows)
    vectors = w.whole_vectors(df, "vec_id", "embedding", 120)
    model = w.fit_whitening(vectors, 120, 4)
    x = np.array([np.floor(64 * np.array(v, dtype=np.float32).astype(float)) for _, v in rows])
    value = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:4]
    assert np.allclose(model.eigenvalues, value, rtol=1e-10) and model.identity_error < 1e-9
