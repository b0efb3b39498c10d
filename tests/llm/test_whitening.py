"""Spectral divide and conquer against a dense solver, and whitened vectors against exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from fabriloom.llm import whitening


def matrices():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 20, 64):
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for values in (rng.standard_normal(n), np.ones(n), np.zeros(n), 10.0 ** -np.arange(n), np.repeat([3.0, 1.0], [n - n // 2, n // 2]), np.r_[np.zeros(n // 2), np.arange(1, n - n // 2 + 1)], np.arange(n) - n // 2.0):
            a = q * values @ q.T
            yield (a + a.T) / 2
        yield np.diag(rng.integers(-2, 3, n).astype(float))


def test_eigenvectors():
    for a in matrices():
        n, size = len(a), max(np.linalg.norm(a), 1e-300)
        e, v = whitening.eigenvectors(a.copy())
        assert np.abs(v.T @ v - np.eye(n)).max() < 1e-13 * max(n, 4)
        assert np.abs(a @ v - v * e).max() / size < 1e-14 * max(n, 8) ** 1.5
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() / size < 1e-14 * max(n, 8)


def test_polar():
    rng = np.random.default_rng(2)
    for a in (rng.standard_normal((9, 9)), np.diag([1.0, -1e-9, 1e-14, 5]), np.diag([1.0, -2, 3])):
        u = whitening.polar(a)
        left, _, right = np.linalg.svd(a)
        assert np.abs(u - left @ right).max() < 1e-6 and np.abs(u.T @ u - np.eye(len(a))).max() < 1e-13


def query(spark, tmp_path, rows, more=""):
    spark.createDataFrame(rows, f"vec_id long, embedding array<float>{more}").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op12_whitening(spark, str(tmp_path))


def test_against_exact_arithmetic(spark, tmp_path):
    rng = np.random.default_rng(8)
    d = 5
    good = [(int(i // 2), [float(c) for c in np.float32(rng.standard_normal(d) * [4, 3, 2, 1, 0.5])]) for i in range(120)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, math.nan, 1.0, 1.0, 1.0]), (903, [math.inf] * d), (904, []), (905, [1.0, 2.0])]
    got = query(spark, tmp_path, [(*r, 1, 2) for r in good + bad], ", component int, n long").collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    dev = [sum((n * int(c) - t) ** 2 for c, t in zip(row, s)) for row in x]
    y = np.array([[float(Fraction(n * int(c) - t, n)) for c, t in zip(row, s)] for row in x])
    cov = y.T @ y / n
    e, v = (m[..., ::-1] for m in np.linalg.eigh(cov))
    w = y @ v / np.sqrt(e)
    assert len(got) == n * d and {r["n"] for r in got} == {n}
    sign = {}
    for k in range(d):
        mine = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1)
        sign[k] = np.sign(sum(a[2] * b for a, b in zip(mine, [w[i][k] for i in sorted(range(n), key=lambda i: (good[i][0], dev[i]))])))
        want = sorted((good[i][0], dev[i], float(sign[k] * w[i][k])) for i in range(n))
        assert [m[:2] for m in mine] == [m[:2] for m in want]
        assert np.allclose([m[2] for m in mine], [m[2] for m in want], atol=1e-9)
        assert math.isclose(next(r["explained"] for r in got if r["component"] == k + 1), e[k] / np.trace(cov), rel_tol=1e-10)
    assert max(r["identity_error"] for r in got) < 1e-10


def test_odd_tables(spark, tmp_path):
    assert query(spark, tmp_path, []).count() == 0 and query(spark, tmp_path, [(1, None), (2, [])]).count() == 0
    # vectors all alike, and one that never varies in a dimension: nothing to scale by
    assert {(r["whitened"], r["deviation"]) for r in query(spark, tmp_path, [(i, [0.5, 0.25]) for i in range(4)]).collect()} == {(None, 0)}
    rows = query(spark, tmp_path, [(i, [float(i), 3.0]) for i in range(5)]).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows)
    # entries so large that deviations leave 64 bits, and more dimensions than components
    assert {r["deviation"] for r in query(spark, tmp_path, [(i, [i * 1e18]) for i in range(3)]).collect()} >= {None}
    wide = query(spark, tmp_path, [(i, [math.sin(i * k + k) for k in range(40)]) for i in range(90)])
    assert wide.count() == 90 * 32 and wide.first()["identity_error"] < 1e-8


def test_deviation_paths():
    x = np.array([[1 << 40, 5], [3, -(1 << 40)]])
    sums = [int(t) for t in x.sum(axis=0)]
    exact = [sum((2 * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, sums, 2) == [v if v < 1 << 63 else None for v in exact]
    small = x % 1000
    assert whitening.deviations(small, [int(t) for t in small.sum(axis=0)], 2) == [sum((2 * int(c) - int(s)) ** 2 for c, s in zip(row, small.sum(axis=0))) for row in small]


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_rows_than_dimensions(spark, tmp_path, n):
    rows = query(spark, tmp_path, [(i, [float((i + 1) * (k + 1) % 7) for k in range(6)]) for i in range(n)]).collect()
    assert len(rows) == 6 * n and sum(r["whitened"] is not None for r in rows) <= n * (n - 1)
