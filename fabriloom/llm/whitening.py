"""Whitening of embeddings: covariance over all vectors, its eigenvectors by spectral divide and conquer, and the
projection of every vector.

Sums and products are gathered in Spark, a matrix for each task, added up row by row; the driver sees the covariance (the
square of a vector's length) and nothing that grows with the vectors. The covariance is split by QDWH: the polar factor of
the shifted matrix gives the projector on the eigenvalues above the shift, its range and complement two smaller
matrices, and so on down to single eigenvectors or clusters of equal eigenvalues. The projection goes to the tasks as a
broadcast of that size.

Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those not as long as most are
(of equally common lengths the longest counts). Entries beyond 2^56 count as that. Components of no variance (up to
rounding) have null whitened values, as they can't be scaled; a deviation beyond 64 bits is null. An empty table gives no
rows. Repeated ids are rows of their own."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from fabriloom.llm.textops import column

SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 62
EPS = np.finfo(np.float64).eps
#: Rows that a task multiplies at a time.
BLOCK = 2048


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by dynamically weighted Halley steps (QDWH): by QR while the matrix is
    badly conditioned, by Cholesky afterwards. It converges in a handful of steps whatever the condition."""
    n = len(a)
    x = a / np.linalg.norm(a)
    tail = np.linalg.qr(x, mode="r")
    with np.errstate(all="ignore"):
        try:
            low = 1 / np.linalg.norm(np.linalg.inv(tail))
        except np.linalg.LinAlgError:
            low = 0.0
    low = min(1.0, max(low if np.isfinite(low) else 0.0, EPS / 8))
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))[0]
            after = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            root = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            after = wb / wc * x + (wa - wb / wc) * np.linalg.solve(root.T, np.linalg.solve(root, x.T)).T
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(after - x), after
        if moved < np.cbrt(EPS) and 1 - low < 10 * EPS:
            break
    return x


def split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of a symmetric matrix above and below a shift. None if it is a multiple
    of the identity, up to the rounding of a matrix of norm size. The middle of the diagonal is tried first; its mean, which
    always lies between the eigenvalues, comes next, and shifts nearby if one meets an eigenvalue."""
    n, mean = len(a), np.trace(a) / len(a)
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * size:
        return None
    best = None
    for shift in (float(np.median(np.diag(a))), mean, *(mean + f * spread / n for f in (0.11, -0.13, 0.29, -0.31, 0.53, -0.57))):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        u = polar((moved + moved.T) / 2)
        p = ((u + u.T) / 2 + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        start = p[:, np.argsort(-np.linalg.norm(p, axis=0), kind="stable")]
        mixed = start @ np.random.default_rng(n).standard_normal((n, k))
        upper = np.linalg.qr(p @ np.linalg.qr(mixed)[0])[0]
        basis = np.linalg.qr(upper, mode="complete")[0]
        one, two = basis[:, :k], basis[:, k:]
        left = np.linalg.norm(two.T @ a @ one)
        if best is None or left < best[0]:
            best = left, one, two
        if left <= 8 * n * EPS * size:
            break
    if best is None:
        raise ArithmeticError("no shift splits this matrix")
    return best[1], best[2]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix. Of equal eigenvalues any basis of their
    space is given. A vector's largest entry is positive."""
    n, size = len(a), float(np.linalg.norm(a))
    found, todo = [], [np.eye(n)] if n else []
    while todo:
        basis = todo.pop()
        own = basis.T @ a @ basis
        halves = split((own + own.T) / 2, size) if basis.shape[1] > 1 and size else None
        if halves is None:
            found.append(basis)
        else:
            todo += [np.linalg.qr(basis @ h)[0] for h in halves]
    vectors = np.hstack(found) if found else np.zeros((0, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors, values = vectors[:, order], values[order]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] if n else np.zeros(0)
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def whole(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    """The batch's vectors (all of length d) as whole numbers floor(64 c) + 1000000."""
    values = column(batch, name).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * values), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def usable(table: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector counts, and the vectors' length (0: none)."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    good = table.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    most = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (good.where(F.size(v) == most["d"]), most["d"]) if most else (good, 0)


@dataclass
class Whitening:
    """What whitens vectors: n, the exact sums of each dimension, eigenvalues and eigenvectors (falling), the trace, and the
    largest entry by which the covariance of the whitened vectors is off the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = float("nan")

    def scaled(self, k: int) -> np.ndarray:
        """The first k components, divided by the root of their variance; those of none by nothing, as NaN."""
        e = self.values[:k]
        real = e > len(self.values) * EPS * max(float(self.values[0]), 0.0)
        return self.vectors[:, :k] / np.where(real, np.sqrt(np.where(real, e, 1.0)), np.nan)


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums/n, with the whole part taken off exactly first."""
    parts = [divmod(s, n) for s in sums]
    return (x - np.array([q for q, _ in parts], np.int64)) - np.array([r / n for _, r in parts])


def _added(rows: DataFrame, matrices) -> np.ndarray:
    """The sum of the square matrices that matrices() makes of each task's batches; Spark adds them up row by row."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum(np.stack(table.column("values").combine_chunks().to_numpy(zero_copy_only=False)), axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "values": pa.array([total], pa.list_(pa.float64()))})

    def each(batches):
        own = matrices(batches)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(list(own), pa.list_(pa.float64()))], names=["i", "values"])

    schema = "i int, values array<double>"
    got = rows.mapInArrow(each, schema).groupBy("i").applyInArrow(add, schema).orderBy("i").collect()
    return np.array([r["values"] for r in got])


def fit(rows: DataFrame, vector: str, d: int, keep: int) -> Whitening:
    """The whitening of rows, whose vectors all have length d: exact sums, then products of the centred numbers, then the
    covariance of the whitened ones, which is centred as its parts are."""
    only = rows.select(vector)

    def sums(batches):
        total, n = np.zeros(d, object), 0
        for batch in batches:
            x = whole(batch, vector, d)
            for lo in range(0, len(x), BLOCK):
                part = x[lo : lo + BLOCK]
                safe = len(part) and np.abs(part).max() < (1 << 62) // BLOCK
                total, n = total + part.sum(axis=0, dtype=np.int64 if safe else object).astype(object), n + len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array([str(t) for t in total]), pa.array([n] * d, pa.int64())], names=["i", "total", "n"])

    got = only.mapInArrow(sums, "i int, total string, n long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, s = got[0]["n"], [int(r["s"]) for r in got]

    def products(turn):
        def run(batches):
            total = None
            for batch in batches:
                x = whole(batch, vector, d)
                for lo in range(0, len(x), BLOCK):
                    y = turn(centred(x[lo : lo + BLOCK], s, n))
                    total = y.T @ y if total is None else total + y.T @ y
            return total

        return run

    cov = _added(only, products(lambda y: y)) / n
    values, vectors = eigenvectors(cov)
    out = Whitening(n, s, values, vectors, float(np.trace(cov)))
    w = out.scaled(min(keep, d))
    w = w[:, ~np.isnan(w[0])]
    if w.shape[1]:
        out.error = float(np.abs(_added(only, products(lambda y: y @ w)) / n - np.eye(w.shape[1])).max())
    return out


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2, exactly; null beyond 64 bits."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        off = n * x - np.array(sums, np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 62:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, key: str, vector: str, model: Whitening, keep: int) -> DataFrame:
    """(key, deviation, values): each row's first keep whitened numbers."""
    w, s, n = model.scaled(keep), model.sums, model.n
    d = len(s)

    def run(batches):
        for batch in batches:
            x = whole(batch, vector, d)
            for lo in range(0, len(x), BLOCK):
                part = x[lo : lo + BLOCK]
                flat = (centred(part, s, n) @ w).ravel()
                ends = pa.array(np.arange(0, len(flat) + 1, w.shape[1], dtype=np.int32))
                values = pa.ListArray.from_arrays(ends, pa.array(flat, pa.float64(), mask=np.isnan(flat)))
                yield pa.RecordBatch.from_arrays([column(batch, key).slice(lo, len(part)), pa.array(deviations(part, s, n), pa.int64()), values], names=[key, "deviation", "values"])

    kind = StructType([rows.schema[key], StructField("deviation", LongType()), StructField("values", ArrayType(DoubleType()))])
    return rows.select(key, vector).mapInArrow(run, kind)


def op12_whitening(spark: SparkSession, sf_dir: str, keep: int = 32) -> DataFrame:
    rows, d = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "embedding")
    if not d:
        return rows.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error"))).limit(0)
    k = min(keep, d)
    model = fit(rows, "embedding", d, k)
    shares = F.array(*(F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values[:k]))
    each = whitened(rows, "vec_id", "embedding", model, k).select("vec_id", "deviation", F.posexplode("values").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(model.error).alias("identity_error"))


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12_whitening that SQL can express, for every row and component."""
    return op12_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")
