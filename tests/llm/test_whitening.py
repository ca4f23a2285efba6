"""Whitening against exact fractions and numpy, and rows that must not matter."""

from fractions import Fraction

import numpy as np
import pytest

from quillspar.llm import whitening

DDL = "vec_id long, embedding array<float>, label int, x array<long>"


def plain(vectors):
    """n, S, covariance (exact, then float) by the definition."""
    fit = sorted({tuple(int(np.floor(256 * np.float64(c))) for c in v) for v in vectors})
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dims)]
    cov = np.array([[float(sum(Fraction(n * v[i] - sums[i], n) * Fraction(n * v[j] - sums[j], n) for v in fit) / n) for j in range(dims)] for i in range(dims)])
    return n, sums, cov


def test_equals_exact_fractions(table):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(90, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32).tolist()
    rows = [(i, v, 1, [7]) for i, v in enumerate(vectors + vectors[:20])]
    rows += [(None, vectors[3], None, None), (900, None, 1, None), (901, [*vectors[0][:5], None], 1, None), (902, [*vectors[0][:5], float("nan")], 1, None), (903, [*vectors[0][:5], float("-inf")], 1, None)]
    got = whitening.whiten(table(rows, DDL)).collect()
    n, sums, cov = plain(vectors)
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    assert len(got) == 4 * 111 and {r.vec_id for r in got}.isdisjoint({900, 901, 902, 903})
    for comp in range(1, 5):
        of = {r.vec_id: r for r in got if r.component == comp}
        want = {i: (np.floor(256 * np.float64(v)) - np.array(sums) / n) @ directions[:, comp - 1] / np.sqrt(values[comp - 1]) for i, v in enumerate(vectors)}
        sign = np.sign(want[0] * of[0].whitened)
        for i, v in enumerate(vectors):
            assert of[i].whitened == pytest.approx(sign * want[i], rel=1e-9, abs=1e-9)
            assert of[i].n == n and of[i].deviation == sum((n * int(np.floor(256 * np.float64(c))) - s) ** 2 for c, s in zip(v, sums, strict=True))
            assert of[i].explained == pytest.approx(values[comp - 1] / values.sum(), rel=1e-12) and of[i].identity_error < 1e-9


def test_products_of_any_size_are_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 19, 20, 45, 61):
        y = rng.integers(-(1 << bits), 1 << bits, (300, 5))
        assert (whitening.product(y) == y.astype(object).T @ y.astype(object)).all()
    big = np.array([[3**60, -(5**40)], [-(2**90), 7]], object)
    assert (whitening.product(big) == big.T @ big).all()
    for v in (0, 1, -1, 2**59, -(2**59), 2**200 + 17, -(3**100)):
        assert sum(p << whitening.PIECE * k for k, p in enumerate(whitening.pieces(v))) == v
        assert all(abs(p) <= 1 << 59 for p in whitening.pieces(v))


def test_refined_vectors_are_eigenvectors():
    rng = np.random.default_rng(2)
    base = rng.integers(-50, 50, (40, 7)).astype(object)
    exact = base.T @ base
    values, vectors = whitening.eigen(exact, 3)
    assert np.abs((exact.astype(float) / 3) @ vectors - vectors * values).max() < 1e-9 * values[0]
    assert (np.diff(values) <= 0).all() and np.abs(vectors.T @ vectors - np.eye(7)).max() < 1e-14


def test_odd_tables(table):
    assert whitening.whiten(table([], DDL)).collect() == []
    assert whitening.whiten(table([(1, None, 1, None)], DDL, "b")).collect() == []
    assert whitening.whiten(table([(1, [], 1, None)], DDL, "c")).collect() == []
    assert whitening.whiten(table([(1, [0.5, 1.0], 1, None)] * 3, DDL, "d")).collect() == []  # no variance
    short = whitening.whiten(table([(1, [1.0], 1, None), (2, [1.0, 0.0], 1, None), (3, [0.0, 2.0], 1, None)], DDL, "e")).collect()
    assert {r.n for r in short} == {2} and {(r.vec_id, r.component) for r in short} == {(1, 1), (2, 1), (3, 1)}
    huge = whitening.whiten(table([(1, [3e38, 1.0], 1, None), (2, [-3e38, 0.0], 1, None), (3, [0.0, 0.0], 1, None)], DDL, "f")).collect()
    assert {r.deviation for r in huge if r.vec_id < 3} == {None} and max(r.identity_error for r in huge) < 1e-4
