"""Whitening against exact fractions, and its parts against exact sums."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[k] for r in x), n) for k in range(d)]
    c = [[r[k] - mean[k] for k in range(d)] for r in x]
    return mean, [[sum(r[i] * r[j] for r in c) / n for j in range(d)] for i in range(d)]


def test_equals_exact_fractions(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(150, 6)) * [9, 4, 1, 0.5, 0.2, 3] @ r.normal(size=(6, 6))
    rows = [(i, [float(np.float32(v)) for v in e], 1) for i, e in enumerate(base)]
    odd = [(900, None, 1), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1), (902, [math.nan] * 6, 1), (903, [math.inf] + [0.0] * 5, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [1e30] + [0.0] * 5, 1)]
    good = [*rows, (3, rows[3][1], 2), (None, rows[4][1], 2)]
    df = spark.createDataFrame(good + odd, SCHEMA).repartition(7).withColumns({c: F.lit(3) for c in ("component", "n", "id", "vector", "line")})
    got = whitening.whitened(df, most=4).collect()
    x = [[math.floor(64 * v) + 1_000_000 for v in e] for _, e, _ in good]
    mean, cov = exact_covariance(x)
    n, sums = len(x), [sum(row[k] for row in x) for k in range(6)]
    value, vector = np.linalg.eigh(np.array([[float(v) for v in row] for row in cov]))
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == 4 * n and {r.component for r in got} == {1, 2, 3, 4} and {r.n for r in got} == {n}
    by = {}
    for g in got:
        by.setdefault((g.vec_id, g.deviation), {})[g.component] = g
    for (i, _, _), row in zip(good, x, strict=True):
        cells = by[i, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))]
        centred = np.array([float(a - m) for a, m in zip(row, mean, strict=True)])
        want = centred @ vector[:, :4] / np.sqrt(value[:4])
        signs = [np.sign((vector[:, k] * v).sum()) for k, v in enumerate(_vectors(df, value))]
        for k in range(4):
            assert cells[k + 1].whitened == pytest.approx(signs[k] * want[k], abs=1e-9)
            assert cells[k + 1].explained == pytest.approx(value[k] / value.sum(), rel=1e-10)
            assert cells[k + 1].identity_error < 1e-12


def _vectors(df, value, cache={}):
    if "v" not in cache:
        rows = df.select(F.col("embedding").alias("vector"))
        n, sums = whitening._sums(rows, 64.0, 1_000_000)
        cache["v"] = whitening.components_of(*whitening._covariance(rows, 64.0, 1_000_000, n, whitening._means(n, sums)))[1].T
    return cache["v"]


def test_outer_products_are_exact_to_two_doubles():
    r = np.random.default_rng(2)
    for spread in (1.0, 1e9):
        high = r.normal(size=(2500, 5)) * np.exp2(r.integers(0, int(math.log2(spread)) + 1, (2500, 5)))
        low = high * r.normal(size=high.shape) * 2.0**-54
        h, lo = whitening.outer_products(*whitening.two_sum(high, low))
        for i in range(5):
            for j in range(5):
                want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j], strict=True))
                size = math.sqrt(float((high[:, i] ** 2).sum() * (high[:, j] ** 2).sum()))
                assert abs(float(Fraction(h[i, j]) + Fraction(lo[i, j]) - want)) <= size * 2.0**-95


def test_merged_parts_do_not_depend_on_the_split(spark):
    df = spark.range(4000).select(F.array(*[(F.xxhash64("id", F.lit(k)) % 1000 / 37).cast("double") for k in range(8)]).alias("vector"))
    n, sums = whitening._sums(df, 64.0, 10**6)
    one, many = (whitening._covariance(df.repartition(p), 64.0, 10**6, n, whitening._means(n, sums))[0] for p in (1, 13))
    assert n == 4000 and np.array_equal(one, many)


def test_close_eigenvalues_and_vectors():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(12, 12)))
    v = q * [1e6, 1e6 * (1 + 1e-7), 50, 49.9999, 1, 1, 1e-3, 1e-5, 3, 2, 7, 9] @ q.T
    value, vector = whitening.components_of((v + v.T) / 2, np.zeros_like(v))
    assert np.all(np.diff(value) <= 1e-9) and np.abs(vector.T @ vector - np.eye(12)).max() < 1e-15 * 4
    assert np.abs(v @ vector - vector * value).max() < 1e6 * 1e-14


def test_vectors_without_variance_and_empty_tables(spark):
    out = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, k, 3, 0, None, 0.0, None) for _ in range(3) for k in (1, 2)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i % 5), 2.0, 0.5 * (i % 5)], 0) for i in range(20)], SCHEMA)).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True} and all(r.identity_error < 1e-12 for r in flat)
    none = whitening.whitened(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA))
    assert none.collect() == []


def test_deviation_beyond_a_long_is_null():
    x, sums = np.array([[2**50, 0], [0, 1]]), np.array([2**50, 1])
    assert whitening._deviations(x, 2, sums) == [None, None] and whitening._deviations(x[1:], 1, np.array([0, 1])) == [0]
