import math
import random

import numpy as np
import pytest

from cpelink.llm import whitening as W

ROWS = "vec_id long, embedding array<float>, label int, n long, component int, y string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "y") for i, v in rows], ROWS)


def fine(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def by_numpy(vectors):
    """x, n, exact deviations, eigenvalues and vectors by another road."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    values, vecs = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    return x, n, ((n * x - s) ** 2).sum(axis=1), values[::-1], vecs[:, ::-1]


def check(spark, rows, most=32):
    kept = [(i, v) for i, v in rows if fine(v)]
    got = W.whitening_report(table(spark, rows)).collect()
    x, n, deviations, values, vecs = by_numpy([v for _, v in kept])
    m = min(most, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == m * len(kept) and {r.n for r in got} == {n}
    assert sorted((r.vec_id is None, r.vec_id, r.deviation) for r in got if r.component == 1) \
        == sorted((i is None, i, d) for (i, _), d in zip(kept, deviations.tolist()))
    shares = {r.component: r.explained for r in got}
    assert sorted(shares) == list(range(1, m + 1))
    assert np.allclose([shares[k + 1] for k in range(m)], values[:m] / values.sum(), rtol=1e-9)
    assert {r.identity_error for r in got} and max(r.identity_error for r in got) < 1e-9
    return got, x, values, vecs, m


def test_report_against_eigh(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * 0.3
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(mixed)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (500, None), (501, []), (502, [None] * 40), (503, [math.nan] * 40),
             (504, [math.inf] + [0.0] * 39), (505, [1.0] * 39 + [None])]
    got, x, values, vecs, m = check(spark, rows)
    centred = x - x.mean(axis=0)
    want = centred @ vecs[:, :m] / np.sqrt(values[:m])
    ids = [i for i, v in rows if fine(v)]
    for k in range(m):
        mine = {r.vec_id: r.whitened for r in got if r.component == k + 1}
        sign = np.sign(mine[ids[3]] * want[3, k])
        assert np.allclose([mine[i] for i in ids], sign * want[:, k], atol=1e-8)


def test_other_lengths_equal_eigenvalues_and_little_rank(spark):
    axes = [[float(s * (i == k)) for i in range(5)] for k in range(5) for s in (-1, 1)]
    rows = list(enumerate(axes)) + [(100, [1.0, 2.0]), (101, [1.0] * 9)]
    got = W.whitening_report(table(spark, rows)).collect()
    assert len(got) == 50 and max(abs(r.explained - 0.2) for r in got) < 1e-12 and got[0].identity_error < 1e-12
    check(spark, [(k, v) for k, v in enumerate([[1.0, 2.0, 3.0], [2.0, 4.0, 6.5], [0.5, 0.5, 0.25]])])
    check(spark, [(k, [float(k)]) for k in range(9)])


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [2.0, 3.0])], [(k, [1.0, 1.0]) for k in range(4)]):
        found = W.whitening_report(table(spark, rows))
        assert found.collect() == [] and found.columns == [c.split()[0] for c in W.SCHEMA.split(", ")]


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for top in (3, 2 ** 19, 2 ** 21, 2 ** 45, 2 ** 62):
        y = rng.integers(-top, top, (300, 4))
        assert (W.products(y) == y.astype(object).T @ y.astype(object)).all()
    y = np.array([[2 ** 62, -2 ** 62]] * 3)
    assert W._centred(y, W.Whitening(3, [0, 0], [1.0], [1.0], np.eye(2)))[1] == [None] * 3


def determinant(m):
    """Bareiss elimination over the integers."""
    m, sign, last = [list(map(int, r)) for r in m], 1, 1
    for k in range(len(m) - 1):
        if not m[k][k]:
            swap = next((i for i in range(k + 1, len(m)) if m[i][k]), None)
            if swap is None:
                return 0
            m[k], m[swap], sign = m[swap], m[k], -sign
        for i in range(k + 1, len(m)):
            for j in range(k + 1, len(m)):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // last
        last = m[k][k]
    return sign * m[-1][-1]


@pytest.mark.parametrize("d", [1, 2, 3, 6, 9])
def test_polynomial_equals_determinants(d):
    rng = np.random.default_rng(d)
    for rank in (d, max(1, d - 2)):
        b = rng.integers(-10 ** 6, 10 ** 6, (d, rank)).astype(object)
        a = b @ b.T
        e = W.symmetric_functions(a, lambda ps: dict(zip(ps, W.polynomial_modulo(a, np.array(ps)).tolist())))
        assert e[0] == 1 and e[1] == int(np.trace(a)) and e[d] == determinant(a)
        for t in (1, 7, -3):
            assert sum((-1) ** k * x * t ** (d - k) for k, x in enumerate(e)) == determinant(t * np.eye(d, dtype=object) - a)


def test_roots_of_known_polynomials():
    rnd = random.Random(2)
    for _ in range(20):
        want = sorted((rnd.choice([0, 1, 2, 3, 3, 10 ** 9, 10 ** 9 + 1, rnd.randrange(10 ** 12)]) for _ in range(8)), reverse=True)
        e = [1]
        for r in want:
            e = [a + r * b for a, b in zip([*e, 0], [0, *e])]
        found, s = W.roots(e, 8)
        flat = [x / 2 ** s for x, many in found for _ in range(many)]
        assert flat == [float(r) for r in want if r]
