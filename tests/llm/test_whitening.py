"""Whitening against fractions and NumPy over all rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from kinfold.llm.whitening import exact_products, fit_whitening, limbs, whitened_components


def _exact(vectors):
    """(integers, sums, covariance as fractions) by their definition."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = [[sum((r[i] - Fraction(s[i], n)) * (r[j] - Fraction(s[j], n)) for r in x) / n for j in range(d)] for i in range(d)]
    return x, s, cov


def _check(rows, kept, k):
    x, s, cov = _exact([v for _, v in kept])
    n = len(x)
    v = np.array([[float(c) for c in r] for r in cov])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by) == {i for i, _ in kept} and all(sorted(c) == list(range(1, k + 1)) for c in by.values())
    signs = {}
    for (i, _), xi in zip(kept, x):
        dev = sum((n * a - b) ** 2 for a, b in zip(xi, s))
        centred = np.array([float(a - Fraction(b, n)) for a, b in zip(xi, s)])
        for c, r in by[i].items():
            assert r["n"] == n and r["deviation_exact"] == str(dev) and r["deviation"] == (dev if dev < 2**63 else None)
            assert r["explained"] == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
            want = centred @ u[:, c - 1] / math.sqrt(e[c - 1])
            signs.setdefault(c, math.copysign(1, want * r["whitened"]) if abs(want) > 1e-6 else None)
            assert r["whitened"] == pytest.approx((signs[c] or 1) * want, abs=1e-8)
            assert 0 <= r["identity_error"] < 1e-6
    assert len({r["identity_error"] for r in rows}) == 1


def test_rows_against_fractions(spark):
    r = random.Random(8)
    good = [(i, [r.gauss(0, 1) * (j + 1) + 5 * j for j in range(12)]) for i in range(300)]
    bad = [(900, None), (901, [None] + [1.0] * 11), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as v", "2 as i", "3 as w", "4 as n", "5 as label").repartition(5)
    _check(whitened_components(df).collect(), good, 8)


def test_repeats_floats_and_few_dimensions(spark):
    vectors = [[0.5, -1.25, 3.0], [0.5, -1.25, 3.0], [1.5, 2.25, -3.0], [7.0, 0.0, 0.125], [0.25, 9.0, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0])] * 2, "vec_id bigint, embedding array<float>")
    rows = whitened_components(df).collect()
    assert sum(r["vec_id"] is None for r in rows) == 6
    _check(whitened_components(df.where("vec_id is not null")).collect(), list(enumerate(vectors)), 3)


def test_entries_beyond_a_long_stay_exact(spark):
    r = random.Random(2)
    good = [(i, [r.gauss(0, 1) * 1e30, r.gauss(0, 1) * 1e12, r.gauss(0, 1)]) for i in range(20)]
    df = spark.createDataFrame(good, "vec_id bigint, embedding array<double>")
    x, s, _ = _exact([v for _, v in good])
    rows = {r["vec_id"]: r for r in whitened_components(df).collect() if r["component"] == 1}
    for (i, _), xi in zip(good, x):
        assert rows[i]["deviation_exact"] == str(sum((20 * a - b) ** 2 for a, b in zip(xi, s))) and rows[i]["deviation"] is None


def test_empty_equal_and_single_rows_give_nothing(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        out = whitened_components(spark.createDataFrame(rows, schema))
        assert out.count() == 0 and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert fit_whitening(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], schema)).vectors.shape == (2, 1)


def test_products_and_limbs_are_exact():
    r = np.random.default_rng(1)
    for most in (100, 1 << 20, 1 << 29, 1 << 40):
        y = r.integers(-most, most, (300, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(4)] for i in range(4)]
        assert exact_products(y).tolist() == want
    for v in (0, 1, -1, 3 << 90, -(5 << 77) - 9):
        assert sum(x << 40 * k for k, x in enumerate(limbs(v))) == v and all(abs(x) < 1 << 40 for x in limbs(v))
