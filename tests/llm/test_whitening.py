"""Whitening against numpy and whole numbers of any size."""

import math
import random

import numpy as np
import pytest

from weirflow.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x int, w string, n int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "w", 2) for i, v in vectors], SCHEMA)


def grid(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def check(got, vectors, components=8):
    """All columns of the result against the definition, computed on the whole list at once."""
    x = [grid(v) for _, v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array(x) - np.array(s) / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, d, int((values > values[0] * 1e-15).sum()))
    assert len(got) == n * k
    trace = sum((n * r[j] - s[j]) ** 2 for r in x for j in range(d)) / n**3
    by = {}
    for g in got:
        by.setdefault(g.vec_id, {})[g.component] = g
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = [np.sign(np.dot([by[i][c + 1].whitened for i, _ in vectors], want[:, c])) for c in range(k)]
    for row, (i, _) in enumerate(vectors):
        assert sorted(by[i]) == list(range(1, k + 1))
        for c in range(k):
            g = by[i][c + 1]
            assert g.n == n and g.deviation == sum((n * x[row][j] - s[j]) ** 2 for j in range(d)) == g.deviation_exact
            assert abs(g.whitened - signs[c] * want[row, c]) < 1e-8 and abs(g.explained - values[c] / trace) < 1e-9 and g.identity_error < 1e-9


def drawn(n, d, seed=5):
    r = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(r.normal(size=(n, d)) * np.linspace(0.05, 0.9, d) + r.normal(size=d))]


@pytest.mark.parametrize(("n", "d"), [(300, 64), (50, 5), (40, 1)])
def test_equal_to_numpy(spark, n, d):
    vectors = drawn(n, d)
    vectors += [(1000 + i, vectors[0][1]) for i in range(n)]  # one very common vector
    check(W.whiten(table(spark, vectors)).collect(), vectors)


def test_rows_that_do_not_take_part(spark):
    vectors = drawn(60, 6)
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 6), (904, [math.inf] + [0.0] * 5), (905, [1.0] * 5)]
    check(W.whiten(table(spark, vectors + odd)).collect(), vectors)


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert W.whiten(table(spark, vectors)).count() == 0


def test_a_flat_dimension_has_no_component(spark):
    vectors = [(i, [*v, 0.5, v[0]]) for i, v in drawn(80, 3)]
    got = W.whiten(table(spark, vectors)).collect()
    assert {g.component for g in got} == {1, 2, 3} and got[0].identity_error < 1e-9 and abs(sum({g.component: g.explained for g in got}.values()) - 1) < 1e-9


def test_deviations_beyond_longs(spark):
    """Large entries take decimals; what no long holds is null, and exact beside it."""
    r = random.Random(1)
    vectors = [(i, [r.choice([-1.0, 1.0]) * 2.0**20 * (1 + i % 3), r.random()]) for i in range(64)]
    got = W.whiten(table(spark, vectors)).collect()
    x = [grid(v) for _, v in vectors]
    s = [sum(c) for c in zip(*x, strict=True)]
    for g in got:
        want = sum((64 * a - b) ** 2 for a, b in zip(x[g.vec_id], s, strict=True))
        assert g.deviation_exact == want and g.deviation == (want if want < 2**63 else None)
    assert W.whiten(table(spark, [(i, [3e38, float(i)]) for i in range(5)])).count() == 5
