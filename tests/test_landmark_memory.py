"""Landmark scaling holds the distances of a few rows at a time, whatever the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import kinfold.operators.embedding as em


def test_a_batch_is_not_compared_whole(spark, monkeypatch):
    d = spark.createDataFrame([(i, "ACDE"[i % 4] * 5 + str(i)) for i in range(400)], "id bigint, s string")
    kept = {}
    frame = type(d)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, g=frame.mapInArrow: kept.update(f=f) or g(self, f, schema))
    out = em.landmark_mds(d, "id", "s", 400, 5)
    rows = [(r["id"], "ACDE"[r["id"] % 4] * 5 + str(r["id"])) for r in d.select("id").collect()] * 20
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([s for _, s in rows])], names=["id", "s"])
    tracemalloc.start()
    (got,) = kept["f"](iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # all distances of the batch are 25.6 MB
    want = {r["id"]: r["vector"] for r in out.collect()}
    assert all(np.allclose(v, want[i], atol=1e-5) for (i, _), v in zip(rows[:50], got.column("vector").to_pylist()))
