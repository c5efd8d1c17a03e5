"""Whitening against exact integers and plain eigenvectors; refinement on hard spectra."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalkit.llm import whitening
from shoalkit.llm.registry import queries
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, whitened double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], SCHEMA)


def plain(rows):
    """``vec_id -> (n, deviation, coordinates)`` and shares, by integers and an ordinary solver."""
    whole = {}
    for i, v in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v):
            whole.setdefault(tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v), []).append(i)
    fit = list(whole)
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for x, c in zip(fit, centred):
        for i in whole[x]:
            out[i] = n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), c @ vectors[:, :16] / np.sqrt(np.maximum(values[:16], 1e-300))
    return out, values / np.trace(covariance)


def agree(found, rows):
    expected, shares = plain(rows)
    got = {}
    for r in found:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(expected)
    size = len(next(iter(got.values())))
    left = np.array([[got[i][k + 1].whitened for k in range(size)] for i in sorted(got)])
    right = np.array([expected[i][2][:size] for i in sorted(got)])
    sign = np.sign((left * right).sum(axis=0))
    assert np.abs(left - right * sign).max() < 1e-6
    for i, of in got.items():
        for k, r in of.items():
            assert (r.n, r.deviation) == expected[i][:2] and abs(r.explained / shares[k - 1] - 1) < 1e-9
            assert r.identity_error < 1e-9
    return size


def test_query_on_the_test_table(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    assert agree(queries()["op11_whitening"](spark, SMALL).collect(), rows) == 16


def test_copies_nulls_and_odd_values(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=6).round(3).tolist()) for i in range(80)]
    # A third of all rows is one vector, another is close enough to be the same integers.
    rows += [(100 + i, [0.25] * 6) for i in range(60)] + [(200, [0.2501] * 6)]
    bad = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5),
           (304, [-float("inf")] + [0.0] * 5), (305, [3e38] + [0.0] * 5), (306, [1.0, 2.0]), (307, [])]
    found = whitening.by_component(whitening.whiten(table(spark, rows + bad)))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert agree(found.collect(), rows) == 6
    assert found.filter("vec_id in (100, 200)").select("component", "whitened").distinct().count() == 6


def test_nothing_and_one_vector(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        assert whitening.by_component(whitening.whiten(table(spark, rows))).collect() == []
    one = whitening.whiten(table(spark, [(1, [0.5, 1.0]), (None, [0.5, 1.0]), (1, [0.5, 1.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in one] == [(1, 0, [], 0.0)] * 3
    flat = whitening.whiten(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [0.5, 4.0])])).collect()
    assert all(len(r.whitened) == 1 and r.explained == [1.0] for r in flat)


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(2 ** 40 * (i % 3)), 0.5 * i, -1e6 * i]) for i in range(7)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    fit = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*fit)]
    for r in found:
        exact = sum((7 * a - s) ** 2 for a, s in zip(fit[r.vec_id], sums))
        assert r.deviation == (exact if exact < 2 ** 63 else None)


def spectra():
    for size in (2, 9, 40):
        yield "apart", np.linspace(1, 100, size)
        yield "clusters", np.r_[5 + 1e-9 * np.arange(size // 2), 1 + 1e-6 * np.arange(size - size // 2)]
        yield "equal", np.ones(size)
        yield "without variance", np.r_[np.arange(size // 2) + 3.0, np.zeros(size - size // 2)]
        yield "wide", 10.0 ** np.linspace(-6, 3, size)


@pytest.mark.parametrize("name,values", list(spectra()))
def test_axes_are_exact_to_double_precision(name, values):
    size = len(values)
    turn, _ = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.principal_axes(matrix)
    wide = vectors.astype(np.longdouble)
    assert (np.diff(found) <= 0).all() and np.abs(wide.T @ wide - np.eye(size)).max() < 1e-15
    assert np.abs(matrix.astype(np.longdouble) @ wide - wide * found).max() < 1e-15 * max(values) * 8
    assert np.abs(np.sort(values)[::-1] - found).max() < 1e-13 * max(values)


def test_refinement_squares_the_error():
    values = np.linspace(1, 50, 30)
    turn, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(30, 30)))
    matrix = (turn * values) @ turn.T
    start = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    errors = []
    for rounds in (1, 2):
        found, vectors = whitening.refine(matrix, start, rounds)
        errors.append(np.abs(matrix @ vectors - vectors * found).max())
    assert np.abs(matrix @ start - start * found).max() > 1e-7 and errors[0] < 1e-9 and errors[1] < 1e-12


def test_second_moments_of_partial_sums(spark):
    rows = np.random.default_rng(1).integers(-50, 50, (10_000, 5))
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "x array<long>").repartition(7)
    matrix, totals = whitening._second_moments(df, lambda x: x.astype(float), 5)
    assert np.array_equal(matrix, rows.T @ rows) and np.array_equal(totals, rows.sum(axis=0))
    assert whitening._totals(df) == (10_000, rows.sum(axis=0).tolist())
    assert whitening._totals(df.filter(F.lit(False))) == (0, [])
