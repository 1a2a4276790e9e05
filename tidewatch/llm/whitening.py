"""Whitening of embeddings by a digit-slice GEMM.

A vector's entries c become integers x = floor(scale * c). The fit list is each different x vector once. Its sums are
taken as integers, x is shifted by the whole part of the means, and the shifted integers are cut into signed limbs of LIMB bits. A product of
two limb matrices of BLOCK rows stays below 2**53, so float64 BLAS gives it exactly; the limb products are added as integers
in each task, added again over all tasks by Spark, and put together as big integers on the driver. The covariance is
therefore exact, whatever the partitions are. Only such sums, as many as the covariance has entries, reach the driver.

The components are its unit eigenvectors, found in double precision and refined in extended precision by Jacobi rotations.

Left out: rows whose vector is null, empty, holds null, NaN or infinite entries or entries beyond 2**53, and vectors of
another length than the commonest (of equally common ones the shorter). A null vec_id is kept. Repeated rows are returned each, but
are one entry of the fit list. Components without variance (below 1e-16 of all variance) are left out, so equal vectors, and an empty table, give no rows.
A deviation beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize

SCALE = 256
COMPONENTS = 4
#: Limbs are in [-2**19, 2**19): products of BLOCK rows of them are below 2**50, exact in float64.
LIMB = 20
BLOCK = 4096
#: Blocks whose products are added in 64 bits before they are given to Spark.
BLOCKS_PER_SUM = 1024
#: Entries of this size or more count as not finite; x then has 61 bits.
LARGEST = 2.0**53
_EXTENDED = np.longdouble


def integer_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, an array of longs, of the rows that take part."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    known = known.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST * SCALE / scale)))
    length = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return known.where(F.size("v") == (length["d"] if length else 0)).select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def limbs(z: np.ndarray) -> list[np.ndarray]:
    """z, 64-bit integers, as float64 limbs, least first: z = sum of limb k times 2**(LIMB k)."""
    half, out = 1 << (LIMB - 1), []
    while z.any():
        low = ((z + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        z = (z - low) >> LIMB
    return out


def limb_products(z: np.ndarray) -> dict[int, np.ndarray]:
    """The exact products of at most BLOCK rows by the sum k of their limbs' places: z.T @ z is the sum of product k times 2**(LIMB k)."""
    parts = limbs(z)
    out: dict[int, np.ndarray] = {}
    for i, a in enumerate(parts):
        for j in range(i, len(parts)):
            p = (a.T @ parts[j]).astype(np.int64)
            out[i + j] = out.get(i + j, 0) + (p if i == j else p + p.T)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each dimension the sums of the upper and lower halves of x."""
    high = low = 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            high, low = high + (x >> 31).sum(axis=0), low + (x & 0x7FFFFFFF).sum(axis=0)
    if not isinstance(high, int):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])


def integer_sums(fit: DataFrame) -> list[int]:
    """The sum of x over the fit list in each dimension."""
    part = fit.select("x").mapInArrow(_sums, "i int, high long, low long").groupBy("i").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    return [(int(r["high"]) << 31) + int(r["low"]) for r in part.orderBy("i").collect()]


def exact_gram(fit: DataFrame, shift: list[int]) -> np.ndarray:
    """The sum of (x - shift)(x - shift)' over the fit list, as Python integers."""
    d, by = len(shift), np.array(shift, dtype=np.int64)
    upper = np.triu_indices(d)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        blocks = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, p in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(np.full(len(upper[0]), k), pa.int32()), pa.array(p[upper])], ["i", "j", "k", "v"])

        for batch in batches:
            z = _matrix(batch.column(0)) - by if batch.num_rows else np.zeros((0, d), np.int64)
            for start in range(0, len(z), BLOCK):
                for k, p in limb_products(z[start : start + BLOCK]).items():
                    sums[k] = sums.get(k, 0) + p
                blocks += 1
                if blocks % BLOCKS_PER_SUM == 0:
                    yield from flush()
                    sums = {}
        yield from flush()

    part = fit.select("x").mapInArrow(slices, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    gram = np.zeros((d, d), dtype=object)
    for r in part.collect():
        gram[r["i"], r["j"]] += int(r["v"]) << (LIMB * r["k"])
    return np.triu(gram) + np.triu(gram, 1).T


def _extended(numerator: int, denominator: int) -> np.longdouble:
    """The quotient in extended precision."""
    near = numerator / denominator
    return _EXTENDED(near) + _EXTENDED(float(Fraction(numerator, denominator) - Fraction(near)))


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix in extended precision.

    Double precision first; then that basis is made orthonormal and what is left off the diagonal is rotated away, which
    also gets eigenvalues right that are many orders smaller than the largest.
    """
    u = np.linalg.eigh(v.astype(np.float64))[1].astype(_EXTENDED)
    for _ in range(2):
        u = u @ (3 * np.eye(len(v), dtype=_EXTENDED) - u.T @ u) / 2
    s = u.T @ v @ u
    s = (s + s.T) / 2
    for _ in range(30):
        size = np.sqrt(np.abs(np.diag(s)))
        wrong = np.argwhere(np.triu(np.abs(s) > 1e-18 * np.outer(size, size) + 1e-22 * np.abs(np.diag(s)).max(), 1))
        if not len(wrong):
            break
        for p, q in wrong:
            if s[p, q] == 0:
                continue
            tau = (s[q, q] - s[p, p]) / (2 * s[p, q])
            t = (1 if tau >= 0 else -1) / (abs(tau) + np.sqrt(1 + tau * tau))
            c = 1 / np.sqrt(1 + t * t)
            turn = np.array([[c, t * c], [-t * c, c]], dtype=_EXTENDED)
            pair = [p, q]
            s[:, pair] = s[:, pair] @ turn
            s[pair, :] = turn.T @ s[pair, :]
            u[:, pair] = u[:, pair] @ turn
    order = np.argsort(-np.diag(s), kind="stable")
    return np.diag(s)[order], u[:, order]


@dataclass
class Whitening:
    """A fitted whitening: n vectors with sums n * shift + rest, and the leading components, the largest first."""

    n: int
    shift: list[int]
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, on each component, over its standard deviation."""
        z = (x - np.array(self.shift, dtype=np.int64)).astype(_EXTENDED) - np.array([_extended(r, self.n) for r in self.rest])
        return (z @ self.vectors / np.sqrt(self.values)).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)**2 over the dimensions, null beyond 64 bits."""
        z = x - np.array(self.shift, dtype=np.int64)
        most = self.n * (int(np.abs(z).max()) if z.size else 0) + max(map(abs, self.rest), default=0)
        if most * most * len(self.shift) < 1 << 63:
            return ((self.n * z - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        wide = self.n * z.astype(object) - np.array(self.rest, dtype=object)
        return [s if s < 1 << 63 else None for s in (wide * wide).sum(axis=1).tolist()]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The leading components of the fit list's x, each row of which counts once; fewer where there is less variance."""
    n, sums = fit.count(), integer_sums(fit)
    d = len(sums)
    shift = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, shift, strict=True)]
    gram = exact_gram(fit, shift) if d else np.zeros((0, 0), dtype=object)
    # the covariance times n squared, whole numbers
    whole = n * gram - np.outer(np.array(rest, dtype=object), np.array(rest, dtype=object)) if d else gram
    trace = sum(whole[i, i] for i in range(d))
    if not trace:
        return Whitening(n, shift, rest, np.zeros(0, _EXTENDED), np.zeros((d, 0), _EXTENDED), np.zeros(0))
    v = np.empty((d, d), dtype=_EXTENDED)
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = _extended(whole[i, j], n * n)
    values, vectors = eigen(v)
    total = _extended(trace, n * n)
    kept = int((values[:components] > 1e-16 * total).sum())
    return Whitening(n, shift, rest, values[:kept], vectors[:, :kept], (values[:kept] / total).astype(np.float64))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened values less the identity.

    Each task gives count, mean and centred products, which are merged pairwise.
    """
    c = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_moments(model.project(_matrix(b.column(0)))) for b in batches if b.num_rows]
        if parts:
            n, mean, scatter = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([scatter.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "scatter"])

    got = fit.select("x").mapInArrow(moments, "n long, mean array<double>, scatter array<double>").collect()
    if not c or not got:
        return 0.0
    n, _, scatter = _merge([(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(c, c)) for r in got])
    return float(np.abs(scatter / n - np.eye(c)).max())


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    n, mean, scatter = parts[0]
    for m, other, more in parts[1:]:
        step = other - mean
        scatter = scatter + more + np.outer(step, step) * (n * m / (n + m))
        mean = mean + step * (m / (n + m))
        n += m
    return n, mean, scatter


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each component."""
    rows = integer_vectors(vectors, column, scale)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, components)
    error = identity_error(fit, model)
    c, n, explained = len(model.values), model.n, model.explained
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            if not k or not c:
                continue
            x = _matrix(batch.column(1))
            each = np.repeat(np.arange(k), c)
            columns = [
                batch.column(0).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), k)),
                pa.array(np.full(k * c, n)),
                pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(explained, k)),
                pa.array(np.full(k * c, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(project, schema)
