"""Exact neighbours: what is shuffled grows with the rows, and groups, blocks and chunks change nothing."""

import numpy as np
import pytest

import kinfold.operators.knn as kn


def test_rows_shuffled_grow_with_the_input(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(kn, "packed", lambda rows, groups, f=kn.packed: seen.append(groups) or f(rows, groups))
    for n in (8_000, 16_000):
        rows = spark.range(n).selectExpr("id", "array(cast(id % 977 as double), cast(id % 13 as double)) as vec")
        assert kn.knn(rows, "id", "vec", 3).count() == 3 * n
    assert seen == [kn.GROUPS] * 2


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("include_self", [False, True])
def test_streamed_blocks_equal_all_pairs(metric, include_self):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(150, 5)), np.repeat(r.normal(size=(2, 5)), 40, axis=0)])
    ids = r.permutation(len(x)) * 3
    got = kn.Nearest(ids, x, 7, metric, include_self)
    for a in range(0, len(x), 13):
        got.see(ids[a : a + 13], x[a : a + 13])
    for i in range(len(x)):
        e = kn.exact_distances(x, x[i][None], metric)
        ok = np.ones(len(x), bool) if include_self else ids != ids[i]
        order = np.lexsort((ids[ok], np.round(e[ok], 12)))[:7]
        assert list(got.near[i]) == list(ids[ok][order]) and list(got.d[i]) == list(e[ok][order])
