from decimal import Decimal

import numpy as np
import pytest

from tidewell.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, id string, n string, whitened string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def brute(vectors):
    """Exact deviations by whole numbers, components by a dense eigensolver of the covariance."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    gap = [[n * int(a) - int(s) for a, s in zip(row, sums)] for row in x]
    exact = [sum(a * a for a in row) for row in gap]
    centred = np.array(gap, dtype=float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)
    return exact, e[order], centred @ v[:, order], e.sum()


def gathered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, {})[r.component] = r
    return out


@pytest.mark.parametrize("dims, rows", [(5, 200), (40, 300)])
def test_against_dense_eigenvectors(spark, conf, dims, rows):
    conf(spark__sql__files__maxPartitionBytes="4k")
    rng = np.random.default_rng(dims)
    vectors = (rng.standard_normal((rows, dims)) * np.linspace(0.5, 3, dims)).astype(np.float32).tolist()
    found = gathered(whitening.by_component(table(spark, vectors).repartition(7)))
    exact, e, projected, trace = brute(vectors)
    assert len(found) == rows and set(found[0]) == set(range(1, min(dims, 32) + 1))
    for c in found[0]:
        mine = np.array([found[i][c].whitened for i in range(rows)])
        want = projected[:, c - 1] / np.sqrt(e[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert abs(found[0][c].explained - e[c - 1] / trace) < 1e-12
    assert [found[i][1].deviation for i in range(rows)] == exact
    assert {r.n for r in found[3].values()} == {rows} and found[0][1].identity_error < 1e-9


def test_what_takes_no_part(spark):
    rng = np.random.default_rng(2)
    good = rng.standard_normal((30, 4)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1.0, 2.0], [1e30, 0.0, 0.0, 0.0]]
    ids = [*range(29), 28, *range(100, 107)]  # a repeated id
    found = whitening.by_component(table(spark, good + bad, ids)).collect()
    assert len(found) == 30 * 4 and {r.n for r in found} == {30} and {r.id for r in found} == set(range(29))


def test_repeated_rows_null_ids_and_flat_directions(spark):
    vectors = [[1.0, 2.0, 5.0]] * 40 + [[2.0, 4.0, 5.0]] * 20
    found = whitening.by_component(table(spark, vectors, [None] * 3 + list(range(57)))).collect()
    assert len(found) == 180
    first = [r for r in found if r.component == 1]
    assert all(r.whitened is not None for r in first) and abs(first[0].explained - 1) < 1e-12
    assert all(r.whitened is None for r in found if r.component > 1) and found[0].identity_error < 1e-9
    assert {round(r.whitened, 6) for r in first} in ({round(-0.5**0.5, 6), round(2**0.5, 6)}, {round(0.5**0.5, 6), round(-(2**0.5), 6)})


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[1.0, 2.0]]])
def test_little_or_nothing(spark, vectors):
    found = whitening.by_component(table(spark, vectors)).collect()
    if vectors and vectors[0]:
        assert [(r.component, r.n, r.deviation, r.whitened) for r in found] == [(1, 1, 0, None), (2, 1, 0, None)]
    else:
        assert found == []


def test_deviations_beyond_64_bits_stay_exact():
    x = np.array([[1_000_000, 0], [-(1 << 30), 5]], dtype=np.int64)
    totals, n = np.array([7, -9], dtype=np.int64), 1 << 40
    want = [Decimal(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, totals))) for row in x]
    assert list(whitening.deviations(x, n, totals)) == want


def shapes():
    rng = np.random.default_rng(1)
    turn = [np.linalg.qr(rng.standard_normal((50, 50)))[0] for _ in range(2)]
    yield rng.standard_normal((500, 64))
    yield rng.standard_normal((9, 1))
    yield np.zeros((4, 6))
    yield rng.standard_normal((500, 10)) @ rng.standard_normal((10, 40))
    yield np.eye(20) * 3.0
    yield turn[0] @ np.diag(1 + 1e-13 * np.arange(50)) @ turn[1]
    yield rng.standard_normal((3, 8))
    yield np.diag(np.ones(30)) + np.diag(np.full(29, 1e-9), 1)  # values closer than their couplings tell apart
    yield np.diag(abs(np.arange(-10, 11)) + 1.0) + np.diag(np.full(20, 0.02), 1)  # pairs of nearly equal values


@pytest.mark.parametrize("a", list(shapes()), ids=lambda a: str(a.shape))
def test_spectrum(a):
    d = a.shape[1]
    r = np.linalg.qr(np.vstack([a, np.zeros((d, d))]), mode="r")
    squares, v = whitening.spectrum(r)
    size = max(np.linalg.norm(r), 1e-300)
    assert np.abs(np.sqrt(squares) - np.linalg.svd(r, compute_uv=False)).max() <= 1e-13 * size
    assert np.abs(v.T @ v - np.eye(d)).max() < 1e-10
    assert np.abs(r.T @ (r @ v) - v * squares).max() <= 1e-12 * size * size


def test_small_values_keep_their_digits():
    """dqds on a bidiagonal matrix, against its squares in higher precision: 1e-20 of the largest and still right."""
    diagonal, above = np.logspace(0, -20, 12), np.logspace(-1, -21, 12)[1:]
    found = np.sqrt(whitening.squared_singular_values(diagonal, above))
    product = 1.0
    for value in diagonal:
        product *= value
    assert abs(np.prod(found / diagonal) - 1) < 1e-12 and found[-1] < 1e-19  # the determinant to full relative precision


def test_inverse_iteration_solves():
    rng = np.random.default_rng(5)
    diagonal, above = rng.uniform(1, 2, 12), rng.uniform(0.1, 1, 11)
    b = np.diag(diagonal) + np.diag(above, 1)
    right = rng.standard_normal(12)
    for s in (0.3, 1.7, 4.0):
        found = whitening.Twisted(diagonal, above).solve(s, right)
        assert np.allclose((b.T @ b - s * np.eye(12)) @ found, right, atol=1e-8)
