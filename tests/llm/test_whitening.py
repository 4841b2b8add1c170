import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormledger.llm import whitening
from stormledger.llm.queries import QUERIES


def plain(vectors, scale=256):
    """n, sums and the exact covariance (as fractions, rounded once) of the distinct vectors."""
    xs = sorted({tuple(math.floor(scale * float(np.float64(c))) for c in v) for v in vectors})
    n, dims = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(dims)]
    centred = [[n * x[i] - sums[i] for i in range(dims)] for x in xs]
    v = [[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(dims)] for i in range(dims)]
    return n, sums, np.array(v)


def test_query_against_exact_sums_and_a_library_solver(spark, sf):
    got = QUERIES["op12_embedding_whitening"](spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    n, sums, v = plain([r.embedding for r in good])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(good) and set(got.n) == {n}
    x = {r.vec_id: [math.floor(256 * c) for c in r.embedding] for r in good}
    assert all(d == sum((n * c - s) ** 2 for c, s in zip(x[i], sums)) for i, d in zip(got.vec_id, got.deviation))
    for k in range(1, 5):
        part = got[got.component == k].set_index("vec_id")
        want = np.array([(np.array(x[i]) - np.array(sums) / n) @ axes[:, k - 1] / math.sqrt(values[k - 1]) for i in part.index])
        have = part.whitened.to_numpy()
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8
        assert abs(part.explained.iloc[0] / (values[k - 1] / values.sum()) - 1) < 1e-10
    assert got.identity_error.max() == got.identity_error.min() < 1e-10


def test_sums_of_pairs_are_exact():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-20, 20, 500), rng.normal(size=500) * 10.0 ** rng.integers(-20, 20, 500)
    for f, exact in ((whitening.two_sum, lambda x, y: x + y), (whitening.two_product, lambda x, y: x * y)):
        hi, lo = f(a, b)
        assert all(Fraction(h) + Fraction(e) == exact(Fraction(x), Fraction(y)) for h, e, x, y in zip(hi, lo, a, b))
    x = np.array([2**63 - 1, -(2**63), 2**53 + 1, -1, 0])
    assert [int(Fraction(h) + Fraction(e)) for h, e in zip(*whitening.as_pair(x))] == x.tolist()
    hi, lo = whitening.total(*whitening.as_pair(np.array([[1e16], [1.0], [-1e16], [1.0], [1e-9]])))
    assert (hi[0], round(lo[0], 9)) == (2.000000001, 0)


def test_covariance_keeps_what_plain_sums_lose(spark):
    """A small variance around a mean of 10^9, where the difference of moments has no digit left."""
    rows = [([1_000_000_000_000 + k % 3, -5 * 10**11 + k % 2],) for k in range(600)]
    df = spark.createDataFrame(rows, "v array<long>").repartition(7)
    n, sums = whitening.sums_of(df)
    v = whitening.covariance(df, n, sums)
    assert sums == [sum(r[0][i] for r in rows) for i in (0, 1)]
    assert np.allclose(v, [[2 / 3, 0], [0, 0.25]], rtol=1e-15, atol=1e-16)
    assert (v == whitening.covariance(df.repartition(3), n, sums)).all()


@pytest.mark.parametrize("kind", ["random", "equal", "diagonal", "ones", "clustered", "graded", "block", "size2", "wilkinson"])
def test_eigen_against_a_library_solver(kind):
    rng = np.random.default_rng(7)
    n = 2 if kind == "size2" else 33
    base = rng.normal(size=(n, n))
    q = np.linalg.qr(base)[0]
    near = np.concatenate([np.ones(n // 2), 1 + 1e-14 * np.arange(n - n // 2)])
    a = {"random": base @ base.T, "size2": base @ base.T, "equal": 3.0 * np.eye(n), "diagonal": np.diag(np.arange(n) - 4.0), "ones": np.ones((n, n)), "clustered": q * near @ q.T, "graded": q * 10.0 ** -np.arange(n) @ q.T, "block": np.kron(np.eye(n // 3), np.ones((3, 3))), "wilkinson": np.diag(np.abs(np.arange(n) - n // 2).astype(float)) + np.eye(n, k=1) + np.eye(n, k=-1)}[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.eigen(a)
    size = np.abs(a).sum(1).max()
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, 1.0]), (2, None), (3, [0.5, None]), (4, [nan, 1.0]), (5, [-inf, 1.0]), (6, []), (7, [0.5, 1.0]), (7, [0.5, 1.0]), (None, [-0.001, 2.0]), (9, [1.0]), (10, [3e38, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    for name in ("n", "whitened", "component", "deviation", "i", "hi", "x"):
        df = df.withColumn(name, F.lit("clash"))
    got = whitening.whitened(df, keep=("vec_id", "i", "n", "hi")).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, k) for i in (1, 7, 7, 0, 10) for k in (1, 2))
    assert {r.n for r in got} == {3} and all(r.i == "clash" for r in got)
    assert {r.deviation is None for r in got if r.vec_id == 10} == {True}
    for part in (df.where("false"), df.where("vec_id in (2, 6)")):
        empty = whitening.whitened(part)
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whitened(df.where("vec_id in (1, 7)")).collect()
    assert len(same) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = whitening.whitened(spark.createDataFrame([(k, [0.1 * k, 0.2 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line if r.whitened is None} <= {2, 3} and {r.component for r in line} == {1, 2, 3}
