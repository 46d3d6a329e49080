"""Points stream past groups in the order of clusters: nothing is shuffled once for each block, and the mean equals that of all pairs."""

import numpy as np
import pytest

from kinfold.operators import knn as kn, metrics as mt


def _brute(x, lab, metric):
    d = np.array([kn.exact_distances(x, y[None], metric) for y in x])
    out = []
    for i in range(len(x)):
        same = (lab == lab[i]) & (np.arange(len(x)) != i)
        b = min((d[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]}), default=None)
        out.append(0.0 if not same.any() else (b - d[i, same].mean()) / (max(b, d[i, same].mean()) or 1))
    return np.mean(out)


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan"])
@pytest.mark.parametrize("numbers", [12, 1 << 17])
def test_silhouette_of_many_clusters(spark, monkeypatch, metric, numbers):
    monkeypatch.setattr(kn, "PACKED", numbers)  # few points in a packed row, so that clusters go on in the next
    monkeypatch.setattr(kn, "query_groups", lambda n: 3)
    monkeypatch.setattr(mt, "query_groups", lambda n: 3)
    r = np.random.default_rng(3)
    lab = np.r_[np.zeros(60, int), r.integers(1, 30, 120), [99]]
    x = r.normal(size=(len(lab), 3)) + 0.2 * lab[:, None]
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, lab))] + [(900, [0.0, 0.0, 0.0], -1)]
    got = mt.silhouette(spark.createDataFrame(rows, "id bigint, vec array<double>, label int"), "id", "label", "vec", metric).first()[0]
    assert abs(got - _brute(x, lab, metric)) < 2e-6


def test_one_cluster_is_null_and_no_pairs_of_blocks_are_made(spark, monkeypatch):
    d = spark.createDataFrame([(i, [float(i)], 1 + (i == 5)) for i in range(6)], "id bigint, vec array<double>, label int")
    assert mt.silhouette(d.where("label = 1"), "id", "label", "vec").first()[0] is None
    monkeypatch.setattr(mt, "pair_blocks", lambda *a, **k: 1 / 0)
    assert abs(mt.silhouette(d, "id", "label", "vec").first()[0] - _brute(np.arange(6.0)[:, None], np.array([1] * 5 + [2]), "euclidean")) < 2e-6
