"""Whitening against numpy's symmetric solver and plain exact arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidepanel.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, y int, n string, component int"


def plain_polynomial(matrix):
    """Faddeev and LeVerrier, lowest coefficient first."""
    a = np.array(matrix, object)
    d = len(a)
    out, m = [1], np.zeros((d, d), object)
    for k in range(1, d + 1):
        m = a @ m + out[-1] * np.eye(d, dtype=int).astype(object)
        out.append(-int((a @ m).trace()) // k)
    return out[::-1]


def random_scatter(d, rows, high=40, seed=0):
    y = np.random.default_rng(seed).integers(-high, high, (rows, d)).astype(object)
    return y.T @ y


@pytest.mark.parametrize("matrix", [
    [[5]], [[0]], [[2, 1], [1, 2]], np.diag([3, 3, 1, 0, 0]).tolist(), random_scatter(7, 30).tolist(), random_scatter(9, 4).tolist(),
    random_scatter(5, 9, 10**12).tolist(), [[0, 0, 1], [0, 0, 0], [1, 0, 1]],
])
def test_polynomial(spark, matrix):
    a = np.array(matrix, object)
    want = plain_polynomial(matrix)
    assert [c % 97 for c in want] == W.polynomial_mod(W._residues(a, 97), 97).tolist()
    if np.linalg.eigvalsh(a.astype(float)).min() > -1e-6 * max(1, a.max()):
        assert W.characteristic_polynomial(spark, a, int(a.trace())) == want


def test_primes():
    found = W.primes_below(1 << 31, 40)
    assert found[0] == 2**31 - 1 and found == sorted(set(found), reverse=True)
    assert all(all(p % q for q in range(2, 400)) for p in found) and W.primes_below(30, 10) == [29, 23, 19, 17, 13, 11, 7, 5, 3, 2]


def test_roots():
    poly = [1]
    for r in (1, 2, 2, 2, 50):  # times (x - r)
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0], strict=True)]
    assert [W.roots_above(poly, at) for at in (-1, 0, 1, 2, 49, 50)] == [5, 5, 4, 1, 1, 0]
    for number, root, first, many in [(1, 50, 1, 1), (2, 2, 2, 3), (3, 2, 2, 3), (4, 2, 2, 3), (5, 1, 5, 1)]:
        middle, f, m = W.isolate(poly, number, 60)
        assert (f, m) == (first, many) and abs(middle - root) < Fraction(1, 1 << 100)
    middle, _, _ = W.isolate([-2, 0, 1], 1, 3)  # the root of two
    assert abs(middle * middle - 2) < Fraction(1, 1 << 150)
    near = [(10**30) * (10**30 + 1), -(2 * 10**30 + 1), 1]  # two roots that doubles cannot tell apart
    assert W.isolate(near, 1, 2 * 10**30)[1:] == (1, 1) and W.isolate(near, 2, 2 * 10**30)[1:] == (2, 1)


def reference(vectors, count=16):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(count, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    deviations = [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    return n, deviations, ((n * x - sums).astype(float) / n) @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(spark, vectors, extra=()):
    rows = [(i, v, 1, "n", 2) for i, v in enumerate(vectors)] + [(10_000 + i, v, 1, "n", 2) for i, v in enumerate(extra)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas()
    n, deviations, white, explained = reference(vectors)
    k = white.shape[1]
    assert len(got) == len(vectors) * k and set(got.vec_id) == set(range(len(vectors))) and set(got.n) == {n}
    table = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert got.groupby("vec_id").deviation.first().sort_index().tolist() == deviations
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    return table, white


def test_against_numpy(spark):
    draw = np.random.default_rng(2)
    vectors = (draw.normal(size=(300, 20)) * np.linspace(1, 3, 20)).astype(np.float32).tolist()
    vectors += vectors[:50] + vectors[:1] * 60
    extra = [None, [None, *vectors[0][1:]], [float("nan")] * 20, [float("inf"), *vectors[0][1:]]]
    table, white = check(spark, vectors, extra)
    assert np.allclose(table * np.sign((table * white).sum(axis=0)), white, atol=1e-9)


def test_singular_and_repeated_roots(spark):
    # Equal spread along the axes: any basis will do, so distances are compared; two columns repeat others, one is constant.
    vectors = [[s * (i == j) for j in range(4)] + [s * (i == 0), 7.0] for i in range(4) for s in (1.0, -1.0)]
    table, white = check(spark, vectors)
    apart = lambda t: ((t[:, None] - t[None]) ** 2).sum(axis=2)
    assert table.shape == (8, 4) and np.allclose(apart(table), apart(white))


def test_short_huge_and_small_tables(spark):
    table, white = check(spark, [[1.0, 2.0, 3.0], [2.0, 0.5, 0.0], [4.0, 4.0, 4.0], [0.0, 0.0, 0.0], [1.5, 0.0, 2.0]])
    short = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [2.0, 0.5]), (2, [4.0] * 3), (3, []), (4, [1.5, 0.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = W.whiten(short).toPandas().pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(np.abs(got), np.abs(table)) and np.allclose(np.abs(got), np.abs(white))
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [-1e30, 0.0]), (2, [3.0, 5.0]), (None, [3.0, 5.0])], "vec_id bigint, embedding array<double>")
    got = W.whiten(huge).collect()
    assert len(got) == 8 and all(r.n == 3 and math.isfinite(r.whitened) for r in got) and {r.deviation for r in got if r.vec_id == 0} == {None}
    for rows in ([], [(1, None)], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).count() == 0
