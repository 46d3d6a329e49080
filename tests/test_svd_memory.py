"""The sparse side of the decomposition is packed, and nothing that is broadcast outlives it."""

import numpy as np
from pyspark.sql import functions as F

import kinfold.operators.embedding as em


def test_rows_are_packed_and_broadcasts_go(spark, monkeypatch):
    r = np.random.default_rng(3)
    A = np.where(r.random((90, 40)) < 0.3, r.integers(1, 9, (90, 40)), 0).astype(float)
    A[:, 7] = 0
    cells = spark.createDataFrame([(i, 5 * j, float(A[i, j])) for i in range(90) for j in range(40) if A[i, j]], "id bigint, col bigint, freq double").repartition(5)
    sent, inputs = [], []
    context, frame = type(spark.sparkContext), type(cells)
    monkeypatch.setattr(context, "broadcast", lambda self, x, g=context.broadcast: sent.append(g(self, x)) or sent[-1])
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, g=frame.mapInArrow: inputs.append(self.schema) or g(self, f, schema))
    monkeypatch.setattr(em, "SVD_CELLS", 64, raising=False)  # many packed rows
    out = em.truncated_svd(cells, 6, rounds=150)
    assert sent and not any(b._jbroadcast.isValid() for b in sent)
    assert all(t.dataType.simpleString() in ("bigint", "double", "binary") for s in inputs for t in s)  # no cell is a Python row
    got = {x["id"]: x["vector"] for x in out.collect()}
    U, S, _ = np.linalg.svd(A, full_matrices=False)
    assert np.allclose(np.abs([got[i] for i in range(90)]), np.abs(U[:, :6] * S[:6]), atol=1e-4)
    assert em.truncated_svd(cells.where(F.lit(False)), 6).count() == 0


def test_columns_are_made_orthonormal_in_blocks():
    G = np.random.default_rng(1).standard_normal((1000, 7)) @ np.diag(10.0 ** np.arange(7))
    Q = em.orthonormal(G.copy(), 128)
    assert np.allclose(Q.T @ Q, np.eye(7), atol=1e-12) and np.allclose(Q @ (Q.T @ G), G)
