"""Layouts in blocks against the layout of one block."""

import numpy as np

from kinfold.operators.embedding import principal_axes, umap


def trust(x, y, k=15):
    """Trustworthiness: how little the neighbours in the layout are strangers in the space."""
    n = len(x)
    rank = np.argsort(np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1), axis=1)
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over


def test_trustworthiness_of_blocks(spark):
    r = np.random.default_rng(6)
    centres = r.normal(0, 3, (12, 10))
    x = np.concatenate([c + r.normal(0, 0.7, (50, 10)) for c in centres])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    at = lambda rows: np.array([e["vector"] for e in sorted(rows, key=lambda e: e["id"])])
    one = trust(x, at(umap(d, "id", "vec", 2, metric="euclidean").collect()))
    rows = umap(d, "id", "vec", 2, metric="euclidean", block=200, rounds=8).collect()
    assert [e["id"] for e in sorted(rows, key=lambda e: e["id"])] == list(range(600))
    many = trust(x, at(rows))
    assert many > one - 0.02 and many > 0.85, (one, many)


def test_principal_axes(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1] + 7
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>").repartition(3)
    y = np.array([e["vector"] for e in principal_axes(d, "id", "vec", 2).orderBy("id").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    want = u[:, :2] * s[:2]
    want *= 10 / np.abs(want).max()
    assert np.allclose(np.abs(y), np.abs(want), atol=1e-6)
    assert principal_axes(d.limit(0), "id", "vec", 2).count() == 0
    assert len(principal_axes(d.limit(3), "id", "vec", 7).first()["vector"]) == 7
