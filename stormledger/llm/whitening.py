"""Embedding whitening from a compensated covariance.

The fit list holds each distinct vector once, as integers. Its sums and, in a second pass, the outer products of the
centred vectors are accumulated as pairs of doubles (high and low part) by error-free transformations: a task adds up its
vectors, gives one row for each row of its matrix, and tasks merge these rows, high and low parts alike, so that the matrix
does not depend on how rows are dealt. The covariance is solved on the driver (a matrix of dims x dims): Householder
reduction to a tridiagonal one, then divide and conquer by rank-one updates with deflation.

Rows whose vector is null or holds a null or non-finite entry are dropped, and so are vectors of no entries or of another
length than the most frequent one (the longer one of two as frequent). Entries beyond a long saturate. Repeated vectors count
once in the fit and each in the result. A component without variance (an eigenvalue of rounding size) has null whitened
values; a deviation beyond a long is null. An empty table gives an empty result. A task holds a few matrices of dims x dims.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_fields, written

SCALE, COMPONENTS = 256, 4
#: Vectors whose outer products are formed at once: CHUNK x dims x (dims + 1) / 2 doubles.
CHUNK = 64
EPS = float(np.finfo(float).eps)
PAIRS = "i int, n long, hi array<double>, lo array<double>"


# Pairs of doubles


def two_sum(a, b):
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """a as a sum of two numbers of 26 bits at most."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_product(a, b):
    """a * b and its rounding error, exactly (without over- or underflow)."""
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a, b):
    """The sum of two pairs."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(hi, lo):
    """The sum over the first axis, halving it."""
    while len(hi) > 1:
        half = len(hi) // 2
        rest = (hi[2 * half :], lo[2 * half :])
        hi, lo = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = np.concatenate([hi, rest[0]]), np.concatenate([lo, rest[1]])
    return hi[0], lo[0]


def as_pair(x):
    """Integers or doubles as a pair, exactly."""
    if x.dtype.kind == "f":
        return x, np.zeros_like(x)
    return two_sum((x >> 32).astype(float) * 4294967296.0, (x & 0xFFFFFFFF).astype(float))


def matrix_of(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# The covariance as a Spark job


def merged(parts: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """The parts of each row i, added up where they meet; one row for each i comes to the driver."""

    def run(batches):
        sums = {}
        for batch in batches:
            for i, n, hi, lo in zip(*(c.to_pylist() for c in batch.columns)):
                part = (np.array(hi), np.array(lo))
                sums[i] = (sums[i][0] + n, add(sums[i][1], part)) if i in sums else (n, part)
        rows = [(i, n, p[0].tolist(), p[1].tolist()) for i, (n, p) in sorted(sums.items())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["i", "n", "hi", "lo"])

    return {r.i: (r.n, np.array(r.hi), np.array(r.lo)) for r in parts.repartition("i").mapInArrow(run, PAIRS).collect()}


def part_rows(n: int, hi: np.ndarray, lo: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(hi)), pa.int32()), pa.array([n] * len(hi), pa.int64()), pa.array(hi.tolist(), pa.list_(pa.float64())), pa.array(lo.tolist(), pa.list_(pa.float64()))],
        names=["i", "n", "hi", "lo"],
    )


def sums_of(vectors: DataFrame) -> tuple[int, list[Fraction]]:
    """How many vectors (a column of equally long arrays) there are, and the exact sum in each dimension, if it fits 106 bits."""

    def run(batches):
        n, sums = 0, None
        for batch in batches:
            x = matrix_of(batch.column(0))
            if len(x):
                part = total(*as_pair(x))
                n, sums = n + len(x), part if sums is None else add(sums, part)
        if n:
            yield part_rows(n, sums[0][None], sums[1][None])

    got = merged(vectors.mapInArrow(run, PAIRS)).get(0)
    return (0, []) if got is None else (got[0], [Fraction(h) + Fraction(x) for h, x in zip(got[1], got[2])])


def mean_pair(n: int, sums: list[Fraction]) -> tuple[np.ndarray, np.ndarray]:
    hi = [float(s / n) for s in sums]
    return np.array(hi), np.array([float(s / n - Fraction(h)) for s, h in zip(sums, hi)])


def covariance(vectors: DataFrame, n: int, sums: list[Fraction]) -> np.ndarray:
    """The covariance (divisor n) of the vectors with these sums: products of centred vectors, as pairs throughout."""
    dims, mean = len(sums), mean_pair(n, sums)
    left, right = np.triu_indices(dims)

    def run(batches):
        count, acc = 0, None
        for batch in batches:
            every = matrix_of(batch.column(0))
            for k in range(0, len(every), CHUNK):
                hi, lo = add(as_pair(every[k : k + CHUNK]), (-mean[0], -mean[1]))
                p, e = two_product(hi[:, left], hi[:, right])
                part = total(*two_sum(p, e + (hi[:, left] * lo[:, right] + lo[:, left] * hi[:, right])))
                count, acc = count + len(hi), part if acc is None else add(acc, part)
        if count:
            full = np.zeros((2, dims, dims))
            for side, half in zip(full, acc):
                side[left, right] = side[right, left] = half
            yield part_rows(count, *full)

    rows = merged(vectors.mapInArrow(run, PAIRS))
    return np.array([(rows[i][1] + rows[i][2]) / n for i in range(dims)])


# The eigen-solve


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """d, e and orthogonal q of a symmetric a: q.T @ a @ q has the diagonal d and e beside it."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        most = np.abs(v).max()
        if most == 0:
            continue
        v /= most  # its squares would underflow otherwise
        v[0] += np.linalg.norm(v) if v[0] >= 0 else -np.linalg.norm(v)
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k:]
        rest -= 2 * np.outer(v, v @ rest)
        side = a[k:, k + 1 :]
        side -= 2 * np.outer(side @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho z z^T, for rising d that differ, z without zeros and rho > 0.

    A root is sought as its distance from the nearer pole, by halving over the bit patterns of doubles, so it has all its
    digits however near it lies; the vectors come from the z that has these roots exactly, so they are orthogonal.
    """
    n, zz = len(d), z * z
    gap = np.append(d[1:] - d[:-1], rho * zz.sum())
    near = np.arange(n)
    middle = (d - d[:, None]) - gap[:, None] / 2  # entry i, j: d_j less the middle of interval i
    right = (1 + rho * (zz / middle).sum(1) < 0) & (near < n - 1)
    origin, sign = d[near + right], np.where(right, -1.0, 1.0)
    poles = d - origin[:, None]
    low, high = np.zeros(n, np.int64), np.where(near < n - 1, gap / 2, gap * (1 + 4 * EPS)).view(np.int64).copy()
    for _ in range(64):
        half = low + (high - low) // 2
        shift = np.maximum(half, 1).view(float)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            f = 1 + rho * (zz / (poles - (sign * shift)[:, None])).sum(1)
        farther = np.where(right, f > 0, f < 0)
        low, high = np.where(farther, half, low), np.where(farther, high, half)
    mu = sign * np.maximum(high, 1).view(float)
    apart = poles - mu[:, None]  # entry j, i: d_i less root j
    between = d - d[:, None]
    np.fill_diagonal(between, 1.0)
    ratio = -apart.T / np.where(np.eye(n, dtype=bool), 1.0, between)  # entry i, j: (root j - d_i) / (d_j - d_i)
    exact = np.sign(z) * np.sqrt(np.abs(ratio.prod(1)))
    vectors = exact / apart
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    return origin + mu, vectors.T


def rank_one(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of q (diag(d) + rho z z^T) q^T; entries that the update doesn't reach, and equal ones, are left out of it."""
    if rho < 0:
        values, vectors = rank_one(-d, z, -rho, q)
        return -values, vectors
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order].copy(), q[:, order].copy()
    limit = 8 * EPS * max(np.abs(d).max(), np.abs(z).max())
    kept: list[int] = []
    for j in range(len(d)):
        if rho * abs(z[j]) <= limit:
            continue
        if kept:
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((d[j] - d[i]) * c * s) <= limit:  # turned so that j has all the weight
                z[i], z[j] = 0.0, r
                q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                kept.pop()
        kept.append(j)
    if kept and rho > 0:
        values, vectors = secular(d[kept], z[kept], rho)
        d[kept], q[:, kept] = values, q[:, kept] @ vectors
    return d, q


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the symmetric tridiagonal matrix: two halves and a rank-one update that joins them."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = e[m - 1]
    one, two = d[:m].copy(), d[m:].copy()
    one[-1] -= rho
    two[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(one, e[: m - 1]), divide_and_conquer(two, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    return rank_one(np.concatenate([d1, d2]), np.concatenate([q1[-1], q2[0]]), float(rho), q)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and unit eigenvectors in columns, the greatest entry of each positive."""
    size = np.abs(a).max() if a.size else 0.0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / size)
    values, vectors = divide_and_conquer(d, e)
    order = np.argsort(-values, kind="stable")
    vectors = q @ vectors[:, order]
    top = vectors[np.abs(vectors).argmax(0), np.arange(len(a))]
    return values[order] * size, vectors * np.where(top < 0, -1.0, 1.0)


# The operator


class Whitening(NamedTuple):
    """n vectors with exact sums; falling eigenvalues and unit vectors (columns) of their covariance, and its trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def scales(self, components: int) -> np.ndarray:
        """1 / sqrt(e) of the leading components, nan where e is of rounding size."""
        e = self.values[:components]
        return np.where(e > len(self.values) * EPS * self.trace, 1 / np.sqrt(np.where(e > 0, e, 1.0)), np.nan)


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """rows with __x, floor(scale * entry) of their vector as longs; rows without a usable vector go."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    # a branch, since a filter beside the transformation would not keep it from the bad rows
    x = F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))
    good = rows.withColumn("__x", x).where("__x is not null")
    most = good.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.where(F.size("__x") == (most.d if most else 0))


def fit(vectors: DataFrame) -> tuple[DataFrame, Whitening | None]:
    """The distinct vectors (a written table with the one column __x) and their whitening; None of no vector."""
    distinct = written(vectors.select("__x").distinct(), "fit-list")
    n, sums = sums_of(distinct)
    if not n:
        return distinct, None
    v = covariance(distinct, n, sums)
    values, axes = eigen(v)
    return distinct, Whitening(n, [int(s) for s in sums], values, axes, float(np.trace(v)))


def projected(rows: DataFrame, by: Whitening, components: int = COMPONENTS) -> DataFrame:
    """rows (with __x) and `deviation`, the sum of squares of n * x - S, and `whitened`, an array of the leading components."""
    n, scales = by.n, by.scales(components)
    axes, sums = by.vectors[:, :components] * scales, np.array(by.sums, object)
    at = rows.columns.index("__x")
    keep = [f for f in rows.schema.fields if f.name not in ("deviation", "whitened")]
    far = max(map(abs, by.sums))

    def run(batches):
        for batch in batches:
            x = matrix_of(batch.column(at))
            if not len(x):
                continue
            wide = max(-int(x.min()), int(x.max()), 0) * n + far
            if wide * wide * x.shape[1] < 1 << 63:
                centred = x * n - sums.astype(np.int64)
                deviation = (centred * centred).sum(1).tolist()
            else:  # exact in Python's integers
                centred = x.astype(object) * n - sums
                deviation = [s if s < 1 << 63 else None for s in (centred * centred).sum(1)]
            y = (centred / n).astype(float) @ axes
            columns = [c for c, f in zip(batch.columns, batch.schema) if f.name not in ("deviation", "whitened")]
            cells = [[None if v != v else v for v in r] for r in y.tolist()]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(deviation, pa.int64()), pa.array(cells, pa.list_(pa.float64()))], names=[*[f.name for f in keep], "deviation", "whitened"])

    return rows.mapInArrow(run, with_fields(keep, "deviation long, whitened array<double>"))


def identity_error(distinct: DataFrame, by: Whitening, components: int = COMPONENTS) -> float | None:
    """The greatest entry of the whitened fit list's covariance less the identity, over the components that have variance."""
    good = int(np.isfinite(by.scales(components)).sum())
    if not good:
        return None
    y = projected(distinct, by, good).select("whitened")
    n, sums = sums_of(y)
    return float(np.abs(covariance(y, n, sums) - np.eye(good)).max())


def whitened(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """keep, component (from 1), n, deviation, whitened, explained and identity_error of each row with a vector and each leading component."""
    own = ("__x", "component", "n", "deviation", "whitened", "explained", "identity_error")
    keep = tuple(c for c in keep if c not in own)
    vectors = integer_vectors(rows.select(*keep, *([vector] if vector not in keep else [])), vector).select(*keep, "__x")
    distinct, by = fit(vectors)
    if by is None:
        by = Whitening(1, [0], np.zeros(1), np.ones((1, 1)), 0.0)  # of no rows
        error = None
    else:
        error = identity_error(distinct, by, components)
    shares = [float(e / by.trace) if by.trace > 0 else None for e in by.values[:components]]
    flat = projected(vectors, by, components).select(*keep, "deviation", F.posexplode("whitened").alias("component", "whitened"))
    explained = F.element_at(F.lit(shares).cast("array<double>"), F.col("component") + 1)
    return flat.select(*keep, (F.col("component") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
