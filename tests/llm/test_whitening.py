"""Whitening against plain linear algebra, and the eigensolver on hard spectra."""

from __future__ import annotations

from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from statutory.llm import whitening
from statutory.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
HARD = {
    "spread": np.logspace(0, -8, 40),
    "clusters": np.r_[np.ones(5), 1 + 1e-9 * np.arange(5), 1 + 1e-14 * np.arange(5), np.linspace(0.1, 0.5, 20)],
    "equal": np.ones(10),
    "rank": np.r_[np.ones(3), np.zeros(7)],
}


@pytest.mark.parametrize("name", HARD)
def test_eigenvectors_beyond_double_precision(name):
    values = HARD[name]
    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values),) * 2))[0].astype(whitening.High)
    for _ in range(4):
        basis = basis @ (3 * np.eye(len(values)) - basis.T @ basis) / 2
    a = (basis * values) @ basis.T
    a = (a + a.T) / 2
    found, vectors = whitening.eigen(a)
    assert float(np.abs(found - np.sort(values)[::-1]).max()) < 1e-16
    assert float(np.abs(vectors.T @ vectors - np.eye(len(values))).max()) < 1e-16
    assert float(np.abs(a @ vectors - vectors * found).max()) < 1e-16
    assert (np.diff(found) <= 0).all()


def test_eigenvectors_of_zeros():
    values, vectors = whitening.eigen(np.zeros((3, 3)))
    assert not values.any() and (vectors == np.eye(3)).all()


def test_whitening_of_the_smallest_table(spark):
    got = QUERIES["op12_whitening"](spark, FOLDER).toPandas().sort_values(["vec_id", "component"])
    rows = duckdb.sql(f"select embedding from '{FOLDER}/embeddings.parquet' order by vec_id").fetchall()
    x = np.floor(64 * np.array([r[0] for r in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = n * x - s
    covariance = (y / n).T @ (y / n) / n
    values, vectors = (v[..., ::-1] for v in np.linalg.eigh(covariance))
    expected = (y / n) @ vectors[:, :32] / np.sqrt(values[:32])
    whitened = got["whitened"].to_numpy().reshape(n, 32)
    signs = np.sign((whitened * expected).sum(0))
    assert np.abs(whitened - signs * expected).max() < 1e-9
    assert (got["deviation"].to_numpy().reshape(n, 32) == (y * y).sum(1)[:, None]).all()
    assert np.allclose(got["explained"].to_numpy().reshape(n, 32), values[:32] / values.sum(), rtol=1e-10)
    assert set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    assert got["component"].tolist() == list(range(1, 33)) * n


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [-0.5, 0.25]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [0.125, -2.0]), (10, [1e300, 0.0])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit("clash").alias(c) for c in ("id", "component", "n", "d", "i")])
    got = whitening.whiten_embeddings(made).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 1, 9) for c in (1, 2))
    used = [(32, 64), (32, 64), (-32, 16), (8, -128)]
    sums = [sum(v[k] for v in used) for k in (0, 1)]
    deviations = sorted(sum((4 * v[k] - sums[k]) ** 2 for k in (0, 1)) for v in used for _ in (1, 2))
    assert sorted(r.deviation for r in got) == deviations
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-12


def test_components_without_spread(spark):
    """Equal vectors have no direction to scale; a constant dimension leaves one component empty."""
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in whitening.whiten_embeddings(same).collect()} == {(None, 0.0, 0, 0.0)}
    flat = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = whitening.whiten_embeddings(flat).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-12


def test_no_vectors(spark):
    got = whitening.whiten_embeddings(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_large_entries_stay_exact(spark):
    """Squares beyond 53 bits are summed as whole numbers; deviations beyond a long are null."""
    rng = np.random.default_rng(2)
    big = rng.integers(-(1 << 33), 1 << 33, (6, 3)).astype(object)
    assert (whitening.exact_products(big.astype(np.int64)) == big.T @ big).all()
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(big.tolist())]
    got = whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    x = big * 64
    y = 6 * x - x.sum(0)
    exact = {i: (int((y[i] ** 2).sum())) for i in range(6)}
    assert all(r.deviation == (exact[r.vec_id] if exact[r.vec_id] < 1 << 63 else None) for r in got)
    trace = sum(Fraction(int(v)) for v in (y * y).sum(0))
    assert trace > 0 and got[0].identity_error < 1e-9
