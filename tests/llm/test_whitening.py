import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest

from sievework.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def run(spark, rows, most=16):
    frame = spark.createDataFrame(rows, SCHEMA)
    listed, d = whitening.usable(frame, "embedding", ["vec_id"])
    model = whitening.fit(listed, d, most)
    return whitening.whiten(listed, "vec_id", model).collect(), model


def fraction_polynomial(a):
    """Faddeev-LeVerrier, in fractions."""
    d = len(a)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(0)] * d + [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][x] * m[x][j] for x in range(d)) + (c[d - k + 1] if i == j else 0) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(a[i][x] * m[x][i] for i in range(d) for x in range(d)) / k
    return [int(x) for x in c]


def scatter(rng, d, n):
    x = [[rng.randint(-30, 30) for _ in range(d)] for _ in range(n)]
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d,n", [(1, 3), (2, 1), (5, 3), (7, 20)])
def test_polynomial_equals_fractions(spark, d, n):
    a = scatter(random.Random(d), d, n)
    assert whitening.polynomial(spark, a) == fraction_polynomial(a)


def test_zero_columns_and_swaps_modulo_a_prime():
    a = [[0, 0, 5], [0, 0, 0], [5, 0, 1]]
    assert [v % 101 for v in fraction_polynomial(a)] == whitening.polynomial_mod(a, 101)


def test_roots_are_counted_and_told_apart():
    poly = [1]
    for value in (3, 3, 3, 10, 11, 0):  # (t - 3)^3 (t - 10) (t - 11) t
        poly = [(poly[k - 1] if k else 0) - value * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [whitening.beyond(poly, at) for at in (-1, 0, 2, 3, 10, 11)] == [6, 5, 5, 2, 1, 0]
    assert [whitening.root(poly, k, 40) for k in (1, 2)] == [(11, 0, 1), (10, 0, 1)]
    assert [whitening.root(poly, k, 40) for k in (3, 4, 5)] == [(3, 0, 3), (3, 1, 3), (3, 2, 3)]


def test_close_roots_have_exact_vectors():
    a = [[10**15, 1], [1, 10**15]]  # roots 10^15 - 1 and 10^15 + 1: a relative gap of 2e-15
    value, which, count = whitening.root([(10**30 - 1) << 40, -2 * 10**15 << 20, 1], 1, 10**23)
    assert value == (10**15 + 1) << 20 and (which, count) == (0, 1)
    assert [abs(float(x)) for x in whitening.null_vectors(a, value, 20, 1)[0]] == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-16)


def test_equal_roots_share_an_orthonormal_basis():
    found = whitening.null_vectors([[4, 0, 0], [0, 4, 0], [0, 0, 1]], 4, 0, 2)
    dots = [[float(sum((x * y for x, y in zip(u, v, strict=True)), Decimal(0))) for v in found] for u in found]
    assert np.allclose(dots, np.eye(2), atol=1e-15) and all(abs(v[2]) < 1e-20 for v in found)


def brute(rows, most):
    """numpy over all distinct vectors."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))), float)
    n, mean = len(fit), fit.mean(axis=0)
    e, u = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    e, u = e[::-1], u[:, ::-1]
    sums = [sum(int(v) for v in column) for column in fit.T]
    return {
        (i, k + 1): (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), abs((np.array(v) - mean) @ u[:, k]) / math.sqrt(e[k]), e[k] / e.sum())
        for i, v in x.items()
        for k in range(min(most, len(sums)))
    }, n


def test_equals_numpy(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1 + 0.2 * j) for j in range(6)]) for i in range(80)]
    rows += [(i + 500, rows[0][1]) for i in range(40)]  # a hot vector counts once
    got, model = run(spark, [(i, v, "c", "n") for i, v in rows], most=4)
    want, n = brute(rows, 4)
    assert len(got) == len(want) == 480 and {r.n for r in got} == {n}
    for r in got:
        deviation, whitened, explained = want[r.vec_id, r.component]
        assert r.deviation == deviation and abs(r.whitened) == pytest.approx(whitened, abs=1e-9) and r.explained == pytest.approx(explained, rel=1e-9)
    assert {r.identity_error for r in got} == {model.identity_error} and model.identity_error < 1e-9


def test_unusable_vectors_and_ties(spark):
    rows = [(1, [0.0, 1.0], "", ""), (2, [1.0, 0.5], "", ""), (None, [1.0, 0.5], "", ""), (3, None, "", ""), (4, [None, 1.0], "", ""), (5, [float("nan"), 1.0], "", "")]
    rows += [(6, [float("inf"), 1.0], "", ""), (7, [], "", ""), (8, [1.0, 2.0, 3.0], "", ""), (2, [1.0, 0.5], "", "")]
    got, _ = run(spark, rows)
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 2), (1, 1, 2), (2, 1, 2), (2, 1, 2)]  # two points lie on one line
    assert {round(abs(r.whitened), 12) for r in got} == {1.0}


def test_nothing_to_whiten(spark):
    assert run(spark, [])[0] == run(spark, [(1, None, "", "")])[0] == run(spark, [(1, [2.0], "", ""), (2, [2.0], "", "")])[0] == []


def test_huge_entries_stay_exact(spark):
    got, model = run(spark, [(k, [3e38 if k == 1 else 1.0, float(k)], "", "") for k in range(4)])
    assert len(got) == 8 and model.identity_error < 1e-6
    assert {r.deviation for r in got if r.vec_id == 1} == {None}  # beyond 64 bits
