"""Embedding whitening by QDWH spectral divide-and-conquer.

The covariance of all vectors is split by polar decompositions: for a shift s inside its spectrum, the orthogonal
polar factor U of V - sI is its matrix sign, so (U + I) / 2 projects on the invariant subspace of the eigenvalues above
s.  Orthonormal bases of that subspace and of its complement turn V into two smaller independent blocks, which are
split in turn until each is a multiple of the identity.  The polar factor comes from the QDWH iteration (dynamically
weighted Halley steps: QR-based while the matrix is far from orthogonal, Cholesky-based after that).

Spark's part: one pass over all vectors for counts and exact sums, one for centred second moments (a partial matrix per
task, added up by entry), one that projects every vector on the broadcast components.  What the driver holds has the
size of the covariance, dimension x dimension, whatever the number of rows; that is also what is broadcast.

Vectors are scaled to integers x = floor(1024 c) + 100000 first, so sums and deviations are exact.

Defined cases: vectors that are null or empty or hold null or non-finite entries are left out; vectors of another length
than the most common one (of equally common ones the longest) live in another space and are left out too, as are those
with an entry beyond 2^40, whose scaled values have no exact double; an empty table gives no rows; repeated rows and null
ids stay rows; a component without variance (an eigenvalue of rounding size, as with one row or equal rows) has null
``whitened``; ``identity_error`` covers the components that have variance and is null where none has; a deviation beyond
64 bits is exact here (decimal) and null in the query's long column.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import saved
from paysieve.llm.vectors import usable

SCALE, OFFSET, MOST = 1024.0, 100_000, float(1 << 40)
COMPONENTS = 8
EXACT = "decimal(38,0)"


# ---- QDWH and spectral divide-and-conquer (dimension x dimension, on the driver)


def polar_factor(a: np.ndarray, steps: int = 12) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    n, eye, eps = len(a), np.eye(len(a)), np.finfo("f8").eps
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the spectral norm
    low = eps  # lower bound of the singular values; smaller ones belong to a shift that is an eigenvalue
    for _ in range(steps):
        # Weights of the best rational approximation to the sign on [low, 1].
        d = (4 * (1 - low * low) / low ** 4) ** (1 / 3)
        root = np.sqrt(1 + d)
        h = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * root))) / 2
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            new = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(eye + c * (x.T @ x))
            half = np.linalg.solve(w, x.T)
            new = b / c * x + (h - b / c) * np.linalg.solve(w.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        moved, x = np.linalg.norm(new - x), new
        if moved < n * eps and 1 - low < 10 * eps:
            break
    return x


def _bases(block: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, or None where it does not split."""
    n = len(block)
    projector = (polar_factor(block - shift * np.eye(n)) + np.eye(n)) / 2
    rank = np.trace(projector)
    k = int(round(rank))
    if not 0 < k < n or abs(rank - k) > 0.25:
        return None
    upper = rng.normal(size=(n, k))
    lower = rng.normal(size=(n, n - k))
    for _ in range(2):
        upper = np.linalg.qr(projector @ upper)[0]
    for _ in range(2):
        lower = lower - projector @ lower
        lower = np.linalg.qr(lower - upper @ (upper.T @ lower))[0]
    return upper, lower


def eigen_split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    rng, n = np.random.default_rng(11), len(v)
    size = np.linalg.norm(v)
    small = 4 * np.finfo("f8").eps * size
    found = []
    todo = [np.eye(n)]
    while todo:
        basis = todo.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        k, middle = len(block), np.trace(block) / len(block)
        if k == 1 or np.linalg.norm(block - middle * np.eye(k)) <= small * k:
            found.append(basis)
            continue
        # Shifts between the diagonal entries, from the median outwards; the diagonal always straddles the spectrum.
        diagonal = np.sort(np.diag(block))
        tries = [np.median(diagonal), middle, *np.random.default_rng(k).uniform(diagonal[0], diagonal[-1], 4)]
        spread = np.linalg.norm(block - middle * np.eye(k))
        tries += [middle + spread * t for t in (0.0, 0.3, -0.3, 0.1, -0.1, 0.6, -0.6, 0.03, -0.03)]
        parts = None
        for shift in tries:
            parts = _bases(block, shift, rng)
            if parts and np.linalg.norm(parts[1].T @ block @ parts[0]) <= 100 * small * k:
                break
            parts = None
        if parts is None:
            raise ArithmeticError(f"no shift splits a block of {k} dimensions")
        todo += [basis @ parts[0], basis @ parts[1]]
    vectors = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return values[order], vectors


# ---- passes over the vectors


def _scaled(batch: pa.RecordBatch, dim: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integers floor(1024 c), without the offset, by vector length."""
    for rows, m in usable(batch.column("v")):
        if dim in (None, m.shape[1]):
            inside = (np.abs(m) < MOST).all(axis=1)
            yield rows[inside], np.floor(SCALE * m[inside]).astype("i8")


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for b in batches:
        for rows, x in _scaled(b):
            if len(rows):
                own = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                own[0] += len(rows)
                # High and low halves add up without overflow.
                total = [(h << 24) + low for h, low in zip((x >> 24).sum(axis=0).tolist(), (x & 0xFFFFFF).sum(axis=0).tolist(), strict=True)]
                own[1] = [a + t for a, t in zip(own[1], total, strict=True)]
    rows = [(dim, n, j, str(s)) for dim, (n, sums) in found.items() for j, s in enumerate(sums)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["dim", "n", "j", "s"])


def _counts_and_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors of the chosen length and their exact sums of floor(1024 c) by dimension."""
    parts = rows.mapInArrow(_sum_batches, "dim long, n long, j long, s string")
    sums = saved(parts.groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(EXACT)).alias("s")))
    best = sums.groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if best is None:
        return 0, []
    return best.n, [int(r.s) for r in sums.where(F.col("dim") == best.dim).orderBy("j").collect()]


def _deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S/n per entry: integers minus the whole part of the mean, minus its fraction rest / n."""
    return (x - whole) - rest / n


def _moments(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    dim, whole = len(sums), np.array([s // n for s in sums], "i8")
    rest = np.array([s % n for s in sums], "f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((dim, dim)), False
        for b in batches:
            for _, x in _scaled(b, dim):
                d, seen = _deviations(x, whole, rest, n), True
                total += d.T @ d
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "value"])

    parts = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(dim * dim)
    for r in parts:
        out[r["at"]] = r.value
    out = out.reshape(dim, dim) / n
    return (out + out.T) / 2


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector: vec_id, n, deviation (exact decimal) and arrays by component: whitened, explained; identity_error.

    ``vectors`` has vec_id and embedding.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    n, sums = _counts_and_sums(rows)
    if not n:
        return spark.createDataFrame([], f"vec_id long, n long, deviation {EXACT}, whitened array<double>, explained array<double>, identity_error double")
    cov = _moments(rows, n, sums)
    dim, trace = len(sums), float(np.trace(cov))
    values, axes = eigen_split(cov)
    k = min(components, dim)
    alive = values[:k] > max(dim * np.finfo("f8").eps * values[0], 0.0)
    divisor = np.where(alive, np.sqrt(np.where(alive, values[:k], 1.0)), np.nan)
    whole, rest = [s // n for s in sums], [s % n for s in sums]
    shared = spark.sparkContext.broadcast((axes[:, :k] / divisor, np.array(whole, "i8"), rest))  # dimension x components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, base, left = shared.value
        fraction = np.array(left, "f8")
        for b in batches:
            for at, x in _scaled(b, dim):
                if not len(at):
                    continue
                w = _deviations(x, base, fraction, n) @ basis
                u = x - base
                if np.abs(u).max() < 1 << 20 and n < 1 << 36:
                    squares, cross = (u * u).sum(axis=1), (u * np.array(left, "i8")).sum(axis=1)
                else:  # beyond 64 bits: whole numbers of any size
                    u = u.astype(object)
                    squares, cross = (u * u).sum(axis=1), (u * np.array(left, object)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(at)), pa.array([str(s) for s in squares]), pa.array([str(c) for c in cross]),
                     pa.array([[None if np.isnan(e) else float(e) for e in row] for row in w], pa.list_(pa.float64()))],
                    names=["vec_id", "squares", "crossed", "whitened"])

    out = rows.mapInArrow(run, "vec_id long, squares string, crossed string, whitened array<double>")
    # (n u - r)^2 summed = n^2 sum u^2 - 2 n sum u r + sum r^2
    exact = lambda v: F.lit(Decimal(v)).cast(EXACT)
    deviation = exact(n * n) * F.col("squares").cast(EXACT) - exact(2 * n) * F.col("crossed").cast(EXACT) + exact(sum(r * r for r in rest))
    out = saved(out.select("vec_id", deviation.cast(EXACT).alias("deviation"), "whitened"))
    error = identity_error(out, [i for i in range(k) if alive[i]], n)
    explained = F.array(*[F.lit(float(values[i] / trace) if trace > 0 else None).cast("double") for i in range(k)])
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(rows: DataFrame, alive: list[int], n: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, measured on all rows."""
    if not alive:
        return None
    part = rows.select(*[F.col("whitened")[i].alias(f"w{i}") for i in alive])
    means = part.agg(*[F.avg(f"w{i}") for i in alive]).first()
    centred = {i: F.col(f"w{i}") - F.lit(m) for i, m in zip(alive, means, strict=True)}
    pairs = [(i, j) for i in alive for j in alive if i <= j]
    cov = part.agg(*[F.sum(centred[i] * centred[j]) / n for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
