"""Neighbours among many copies of a vector, against all pairs in the order of (distance, identifier)."""

import numpy as np
import pytest

import kinfold.operators.knn as kn


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("drop_zero", [False, True])
def test_more_ties_than_any_margin(spark, metric, drop_zero):
    r = np.random.default_rng(2)
    base = r.integers(-3, 4, (12, 6)).astype(float) + 0.25
    x = np.concatenate([np.repeat(base[:3], 60, axis=0), base[3:], r.normal(size=(20, 6))])
    ids = r.permutation(len(x)) * 7
    d = spark.createDataFrame([(int(i), [float(t) for t in v]) for i, v in zip(ids, x)], "id bigint, vec array<double>")
    k, want = 5, {}
    for i, v in zip(ids, x):
        e = kn.exact_distances(x, v[None], metric)
        ok = ids != i
        order = np.lexsort((ids[ok], np.round(e[ok], 12)))[:k]
        if near := [int(j) for j, x_ in zip(ids[ok][order], e[ok][order]) if x_ > 0 or not drop_zero]:
            want[int(i)] = near
    got: dict = {}
    for row in kn.knn(d, "id", "vec", k, metric, drop_zero=drop_zero).orderBy("src", "rank").collect():
        got.setdefault(row["src"], []).append(row["dst"])
    assert got == want
