"""Whitening against fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import whitening as W

COLUMNS = "vec_id long, embedding array<double>, label int, x int, n int, i int, component string"


def frame(spark, vectors, dtype="double"):
    rows = [(i, v, 1, 2, 3, 4, "c") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, COLUMNS.replace("double", dtype)).repartition(5)


def plain(vectors):
    """Rows (vec_id, deviation) and the exact covariance of the different x vectors, by fractions."""
    kept = {i: [math.floor(256 * float(c)) for c in v] for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = [list(t) for t in {tuple(x) for x in kept.values()}]
    n, d = len(fit), len(fit[0])
    total = [sum(x[k] for x in fit) for k in range(d)]
    mean = [Fraction(t, n) for t in total]
    cov = [[sum((x[a] - mean[a]) * (x[b] - mean[b]) for x in fit) / n for b in range(d)] for a in range(d)]
    return {i: sum((n * c - t) ** 2 for c, t in zip(x, total, strict=True)) for i, x in kept.items()}, n, mean, cov, kept


def check(spark, vectors, dtype="double", tolerance=1e-9):
    deviation, n, mean, cov, kept = plain(vectors)
    got = W.whiten(frame(spark, vectors, dtype)).collect()
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(v)[::-1]
    count = min(4, len(v))
    assert len(got) == len(kept) * count
    assert {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(1, count + 1):
        assert abs(by[min(kept), k]["explained"] / (values[k - 1] / v.trace()) - 1) < 1e-4
    for i, dev in deviation.items():
        assert by[i, 1]["deviation"] == (dev if dev < 1 << 63 else None)
    # whitened values of the fit list are uncorrelated with unit variance, and components span the leading eigenspace
    once = {tuple(x): i for i, x in kept.items()}.values()
    w = np.array([[by[i, k]["whitened"] for k in range(1, count + 1)] for i in once])
    assert np.abs(w.T @ w / n - np.eye(count)).max() < 1e-6 and np.abs(w.mean(axis=0)).max() < 1e-9
    centred = np.array([[float(c - m) for c, m in zip(kept[i], mean, strict=True)] for i in once])
    for k in range(count):
        u = centred.T @ w[:, k] / n  # the component times the root of its eigenvalue
        assert np.abs(v @ u - values[k] * u).max() <= tolerance * values[0] * np.abs(u).max()


def test_random_vectors_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [r.tolist() for r in rng.normal(size=(300, 12)) @ np.diag(np.linspace(1, 3, 12))]
    vectors += [vectors[0]] * 50 + [None, [], [1.0] * 3, [float("nan")] + [0.0] * 11, [float("inf")] * 12, [None] + [0.0] * 11, [0.0] * 12, [-0.0] * 12, [1e300] * 12]
    check(spark, [v if v != [1e300] * 12 else None for v in vectors if v is None or len(v) != 3])
    mixed = W.whiten(frame(spark, vectors))
    assert mixed.select("vec_id").distinct().count() == 352  # null, empty, short, not finite and huge ones go


def test_wide_and_graded_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    wide = rng.normal(size=(200, 6)) * np.array([1e10, 1e9, 3e8, 1e8, 1e3, 1.0])
    check(spark, [r.tolist() for r in wide])
    graded = rng.normal(size=(400, 4)) * np.array([1e6, 1.0, 2.0, 4.0])
    turned = graded @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    check(spark, [r.tolist() for r in turned], tolerance=1e-8)  # the check itself cancels eight digits


def test_single_precision_and_shifted_vectors(spark):
    rng = np.random.default_rng(3)
    check(spark, [np.float32(r).tolist() for r in rng.normal(size=(150, 5)) + 1000.0], "float")


def test_limb_products_are_exact():
    rng = np.random.default_rng(4)
    z = rng.integers(-(1 << 61), 1 << 61, size=(W.BLOCK, 3))
    want = z.astype(object).T @ z.astype(object)
    got = sum(p.astype(object) * (1 << (W.LIMB * k)) for k, p in W.limb_products(z).items())
    assert (got == want).all()
    assert W.limb_products(np.zeros((3, 2), np.int64)) == {}


def test_no_variance_and_empty_tables(spark):
    assert W.whiten(frame(spark, [[1.0, 2.0]] * 7)).count() == 0
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [None, []])).count() == 0
    flat = W.whiten(frame(spark, [[float(i), 5.0] for i in range(9)]))
    assert {r["component"] for r in flat.collect()} == {1}


def test_the_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    vectors = [r.tolist() for r in rng.normal(size=(500, 8))]
    rows = lambda parts: sorted((r["vec_id"], r["component"], r["whitened"], r["explained"]) for r in W.whiten(frame(spark, vectors).repartition(parts)).collect())
    assert rows(1) == rows(13)


def test_a_null_id_is_kept(spark):
    df = frame(spark, [[1.0, 2.0], [3.0, 1.0], [0.0, 5.0]]).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))
    assert W.whiten(df).where("vec_id is null").count() == 2
