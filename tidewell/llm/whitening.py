"""Whitening of embeddings by a bidiagonal qd solver.

A vector's entry c becomes the whole number x = floor(`SCALE` c) + `OFFSET`, so counts, sums and distances from the mean are exact. The fit list is all
vectors that take part; a covariance is that of the fit list, divisor n, of centred rows.

1. Sums: each task sums its vectors, Spark adds up the sums by dimension.
2. Blockwise QR: each task centres blocks of rows and folds them into one triangle R (QR of the triangle on top of the block); `FAN` tasks' triangles at a time are
   folded in tasks again until at most `FAN` are left, which the driver folds. R'R is n times the covariance, which
   is never formed: singular values of R keep their accuracy.
3. Householder reflections make R bidiagonal (U'RQ = B).
4. dqds, the differential quotient-difference algorithm with shifts, finds the squared singular values of B to high relative accuracy.
5. For each, a twisted factorisation of B'B - s^2 I (from the top to the twist, from the bottom to the twist, at the place where the two agree best) gives the
   singular vector; where values lie close together the vectors are made orthogonal within their cluster, by inverse iteration with the same factorisation if they
   are too alike. Q carries them back: the components.
6. Whitening: centred rows times the components, over the square roots of the eigenvalues. Their covariance is measured by another
   pass over all rows.

The driver holds `FAN` triangles and the components: the square of the vectors' length, whatever their number. Tasks hold one triangle and one Arrow batch.

Defined results: vectors that are null or hold null or non-finite entries, or entries beyond +-`LARGEST`, are dropped, as are those of another length than the most common one (of equally
common ones the greater); components whose eigenvalue is below `LEAST` of the trace have no direction of their own: their `whitened` is null, they are left out of the
identity error; repeated rows count and stay, rows with a null id too; equal eigenvalues have any orthogonal components; an empty table, or one of empty vectors, gives an empty result;
columns besides id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
FAN, BLOCK, LEAST, LARGEST = 16, 1024, 1e-12, float(1 << 24)
EPS = float(np.finfo(float).eps)


class Whitening(NamedTuple):
    """What a fit found: `components` are columns, numbered by falling eigenvalue (`variances`)."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    components: np.ndarray
    trace: float

    def divisors(self) -> np.ndarray:
        """Square roots of the eigenvalues; not a number where there is no variance."""
        real = self.variances > LEAST * self.trace
        return np.sqrt(np.where(real, self.variances, np.nan))


# --- singular values and vectors of a triangle ---


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor Q of U'RQ = B, by Householder reflections."""
    a = np.array(r, dtype=float)
    d = a.shape[1]
    q = np.eye(d)
    for k in range(d):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(v, 2.0 * (v @ a[k:, k:]))
        if k < d - 2:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2.0 * v)
            q[:, k + 1 :] -= np.outer(q[:, k + 1 :] @ v, 2.0 * v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector v whose reflection I - 2vv' takes x to a multiple of the first axis (0: none is needed)."""
    size = np.linalg.norm(x)
    v = x.astype(float).copy()
    if size == 0 or np.linalg.norm(x[1:]) == 0:
        return np.zeros_like(v)
    v[0] += math.copysign(size, v[0])
    return v / np.linalg.norm(v)


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of a bidiagonal matrix's singular values, falling, by dqds."""
    q, e = (diagonal * diagonal).tolist(), (above * above).tolist()
    out, shift, tau = [], 0.0, 0.0
    while q:
        m = len(q)
        if m == 1 or e[-1] <= EPS * EPS * (shift + q[-1]):
            out.append(shift + q.pop())
            e = e[:-1]
            tau = 0.0
            continue
        while (found := _sweep(q, e, tau)) is None:  # the shift was beyond the smallest value
            tau = 0.25 * tau if tau > 1e-3 * min(q) else 0.0
        q, e, least = found
        shift += tau
        # The least remainder bounds the smallest value left from above, and once the end is nearly free, from below but for the coupling.
        tau = max(0.75 * least, q[-1] - math.sqrt(e[-1] * q[-1])) if e[-1] < 1e-2 * q[-1] else 0.75 * least
        tau = min(tau, least)
    return np.array(sorted(out, reverse=True))


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float] | None:
    """A differential quotient-difference step with shift `tau`, and its least remainder; None if a value is below the shift."""
    new_q, new_e = [], []
    d = least = q[0] - tau
    for own, following in zip(e, q[1:]):
        if d < 0:
            return None
        total = d + own
        new_q.append(total)
        if total > 0:
            ratio = following / total
            new_e.append(own * ratio)
            d = d * ratio - tau
        else:  # nothing couples them
            new_e.append(0.0)
            d = following - tau
        least = min(least, d)
    if d < 0:
        return None
    return [*new_q, d], new_e, least


class Twisted:
    """Twisted factorisations of B'B - s I, for one bidiagonal matrix and any s."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray):
        self.q = (diagonal * diagonal).tolist()
        self.l = [float(b / a) for a, b in zip(diagonal, above)]  # B'B = L diag(q) L', with this below the diagonal
        self.tiny = 1e-290 + EPS * EPS * max(self.q)

    def factor(self, s: float) -> tuple[list[float], list[float], list[float], list[float], int]:
        """Top-down multipliers and pivots, bottom-up ones, and the twist where the pivot is least."""
        q, low, m, tiny = self.q, self.l, len(self.q), self.tiny
        upper, pivots_up, stationary = [], [], [-s]
        for k in range(m - 1):
            pivot = q[k] + stationary[k]
            pivot = pivot if abs(pivot) > tiny else -tiny
            upper.append(low[k] * q[k] / pivot)
            pivots_up.append(pivot)
            stationary.append(upper[k] * low[k] * stationary[k] - s)
        lower, pivots_down, progressive = [0.0] * (m - 1), [0.0] * m, [0.0] * m
        progressive[-1] = q[-1] - s
        for k in range(m - 2, -1, -1):
            pivot = q[k] * low[k] * low[k] + progressive[k + 1]
            pivot = pivot if abs(pivot) > tiny else -tiny
            pivots_down[k + 1] = pivot
            lower[k] = low[k] * q[k] / pivot
            progressive[k] = progressive[k + 1] * q[k] / pivot - s
        gammas = [abs(a + b + s) for a, b in zip(stationary, progressive)]
        twist = min(range(m), key=gammas.__getitem__)
        return upper, pivots_up, lower, pivots_down, twist

    def vector(self, s: float) -> np.ndarray:
        upper, _, lower, _, twist = self.factor(s)
        z = np.zeros(len(self.q))
        z[twist] = 1.0
        for k in range(twist - 1, -1, -1):
            z[k] = -upper[k] * z[k + 1]
        for k in range(twist, len(z) - 1):
            z[k + 1] = -lower[k] * z[k]
        return z / np.linalg.norm(z)

    def solve(self, s: float, right: np.ndarray) -> np.ndarray:
        """(B'B - s I)^-1 right, with pivots kept off zero: a step of inverse iteration."""
        upper, pivots_up, lower, pivots_down, twist = self.factor(s)
        m, y = len(self.q), right.astype(float).copy()
        for k in range(twist):
            y[k + 1] -= upper[k] * y[k]
        for k in range(m - 2, twist - 1, -1):
            y[k] -= lower[k] * y[k + 1]
        gamma = self.q[twist] - s
        if twist:
            gamma += self.l[twist - 1] ** 2 * self.q[twist - 1] - upper[twist - 1] ** 2 * pivots_up[twist - 1]
        if twist < m - 1:
            gamma -= lower[twist] ** 2 * pivots_down[twist + 1]
        pivots = np.array([*pivots_up[:twist], gamma if abs(gamma) > self.tiny else self.tiny, *pivots_down[twist + 1 :]])
        y /= pivots
        for k in range(twist - 1, -1, -1):
            y[k] -= upper[k] * y[k + 1]
        for k in range(twist, m - 1):
            y[k + 1] -= lower[k] * y[k]
        return y


def spectrum(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a triangle, falling, and its right singular vectors as columns."""
    diagonal, above, q = bidiagonal(r)
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if size == 0:
        return np.zeros(len(diagonal)), np.eye(len(diagonal))
    diagonal, above = diagonal / size, above / size
    diagonal = np.where(np.abs(diagonal) < 1e-100, 1e-100, diagonal)  # far below rounding; keeps quotients finite
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * 1e-2) + 1), len(diagonal)]
    values, vectors = [], []
    for a, b in zip(cuts, cuts[1:]):
        found = squared_singular_values(diagonal[a:b], above[a : b - 1])
        part = np.zeros((len(diagonal), b - a))
        part[a:b] = _vectors(Twisted(diagonal[a:b], above[a : b - 1]), found)
        values.append(found)
        vectors.append(part)
    values, vectors = np.concatenate(values), np.concatenate(vectors, axis=1)
    falling = np.argsort(-values, kind="stable")
    return values[falling] * size * size, q @ vectors[:, falling]


def _vectors(twisted: Twisted, values: np.ndarray, close: float = 1e-3) -> np.ndarray:
    out = np.zeros((len(values), len(values)))
    first, rng = 0, np.random.default_rng(0)
    for k, s in enumerate(values.tolist()):
        if k and values[k - 1] - s > close * values[0]:
            first = k
        z, near = twisted.vector(s), out[:, first:k]
        left = _apart(z, near)
        if np.linalg.norm(left) < 0.5:  # as good as a vector of the cluster found before
            left = _apart(rng.standard_normal(len(values)), near)
            for _ in range(4):
                left = _apart(twisted.solve(s, left / np.linalg.norm(left)), near)
                left /= np.linalg.norm(left)
        out[:, k] = left / np.linalg.norm(left)
    return out


def _apart(z: np.ndarray, near: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = z - near @ (near.T @ z)
    return z


# --- on the cluster ---


def whole(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`id`, `vec` (doubles) of the vectors that take part, all equally long and not empty."""
    vec = F.col("vec")
    fine = vec.isNotNull() & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)) & (F.size(vec) > 0)
    found = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(fine)
    usual = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.where(F.size("vec") == (usual["n"] if usual else 0))


def units(column) -> np.ndarray:
    """Whole numbers of an Arrow column of equally long vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + OFFSET).reshape(len(column), -1)


def fit(vectors: DataFrame) -> Whitening | None:
    """Whitening of all `vectors` (rows of `whole`); None if there are none."""
    import pyarrow as pa

    def add(batches: Iterator) -> Iterator:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(0))
                n, sums = n + len(x), x.sum(axis=0) + (0 if sums is None else sums)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    sums = vectors.select("vec").mapInArrow(add, "n long, sums array<long>")
    each = sums.select("n", F.posexplode("sums").alias("at", "x")).groupBy("at")
    added = each.agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.count(F.lit(1)).alias("tasks")).orderBy("at").collect()
    if not added:
        return None
    n, totals = added[0].n, np.array([r.x for r in added], dtype=np.int64)

    def fold(batches: Iterator) -> Iterator:
        r = np.zeros((0, len(totals)))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = np.linalg.qr(np.vstack([r, centred(units(batch.column(0).slice(at, BLOCK)), n, totals)]), mode="r")
        yield from _sent(r)

    def refold(batches: Iterator) -> Iterator:
        r = np.zeros((0, len(totals)))
        for batch in batches:
            for raw in batch.column(0):
                r = np.linalg.qr(np.vstack([r, _triangle(raw.as_py(), len(totals))]), mode="r")
        yield from _sent(r)

    def _sent(r: np.ndarray) -> Iterator:
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])

    folded = vectors.select("vec").mapInArrow(fold, "r binary")
    triangles = added[0].tasks
    while triangles > FAN:
        triangles = -(-triangles // FAN)
        folded = folded.repartition(triangles).mapInArrow(refold, "r binary")
    r = np.vstack([_triangle(row.r, len(totals)) for row in folded.collect()])
    r = np.linalg.qr(np.vstack([r, np.zeros((len(totals), len(totals)))]), mode="r")
    squares, components = spectrum(r)
    return Whitening(n, totals, squares / n, components, float((r * r).sum()) / n)


def _triangle(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=float).reshape(-1, width)


def far(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """n x - S, exact; beyond 64 bits as Python's integers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most * n < 1 << 62:
        return x * n - totals
    return x.astype(object) * n - totals.astype(object)


def centred(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """x - S/n: the difference is exact, the division rounds once."""
    return far(x, n, totals).astype(float) / n


def deviations(x: np.ndarray, n: int, totals: np.ndarray) -> list[Decimal] | np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact at any size."""
    gap = far(x, n, totals)
    most = int(np.abs(gap).max(initial=0))
    if most * most * gap.shape[1] < 1 << 63:
        return (gap * gap).sum(axis=1).astype(np.int64)
    gap = gap.astype(object)
    return [Decimal(int(v)) for v in (gap * gap).sum(axis=1)]


def project(vectors: DataFrame, found: Whitening, components: int = COMPONENTS) -> DataFrame:
    """`id`, `deviation` (decimal), `whitened` (array, null where there is no variance) for each of `vectors`."""
    import pyarrow as pa

    small_batches(vectors.sparkSession)
    directions = found.components[:, :components] / found.divisors()[:components]
    n, totals = found.n, found.sums

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column("vec"))
                own = pa.array(np.ascontiguousarray(centred(x, n, totals) @ directions).ravel(), from_pandas=True)
                ends = pa.array(np.arange(len(x) + 1) * directions.shape[1], pa.int32())
                exact = pa.array(deviations(x, n, totals)).cast(pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch.column("id"), exact, pa.ListArray.from_arrays(ends, own)], names=["id", "deviation", "whitened"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(projected: DataFrame, found: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the components with variance."""
    import pyarrow as pa

    real = np.flatnonzero(~np.isnan(found.divisors()[:components]))
    width = min(components, len(found.sums))
    if not len(real):
        return 0.0

    def gram(batches: Iterator) -> Iterator:
        total = np.zeros((len(real) + 1, len(real) + 1))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[:, real]
                y = np.hstack([y, np.ones((len(y), 1))])
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    sent = projected.select("whitened").mapInArrow(gram, "sums array<double>").select(F.posexplode("sums").alias("at", "x"))
    total = np.array([r.x for r in sent.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()]).reshape(len(real) + 1, -1)
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    return float(np.abs(total[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(real))).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float]:
    """`id`, `deviation`, `whitened` for each vector that takes part, what the fit found, and the identity error."""
    small_batches(rows.sparkSession)
    vectors = whole(rows, id_col, vector_col)
    found = fit(vectors)
    if found is None:
        kind = vectors.schema["id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"id {kind}, deviation decimal(38,0), whitened array<double>"), None, 0.0
    projected = project(vectors, found, components)
    return projected, found, identity_error(projected, found, components)


def by_component(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """`id`, `component` (from 1), `n`, `deviation`, `whitened`, `explained`, `identity_error`: a row for each vector and component.

    `deviation` is a long here: one beyond 64 bits is an error, while `whiten` gives any as a decimal."""
    projected, found, error = whiten(rows, id_col, vector_col, components)
    n = found.n if found else 0
    shares = (found.variances[:components] / found.trace).tolist() if found and found.trace > 0 else [0.0] * components
    spread = projected.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select(
        "id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
